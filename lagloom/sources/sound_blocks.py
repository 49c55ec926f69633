"""Long recordings as rows of blocks: a Python data source that reads WAV files range by range.

A folder holds `{broadcast}/{stream}.wav`, below any file system that Arrow knows. The driver lists files and their
sizes; a task seeks to its blocks and reads only these, one at a time, so that no recording is ever in one row or one task.
"""

from __future__ import annotations

import re
import wave
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lagloom.operators.long_sound import SIZE
from lagloom.sources.audio_files import samples

SCHEMA = "broadcast_key string, stream_name string, sample_rate int, channels int, block long, pcm array<double>, error string"
ARROW = pa.schema([
    ("broadcast_key", pa.string()), ("stream_name", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()),
    ("block", pa.int64()), ("pcm", pa.list_(pa.float64())), ("error", pa.string()),
])
#: Bytes of a file that a task reads, about.
RANGE = 64 << 20


class _Part(InputPartition):
    def __init__(self, stream: str, begin: int, end: int):
        self.stream, self.begin, self.end = stream, begin, end


class SoundBlocks(DataSource):
    """format("sound_blocks"), options path and size (samples of a block)."""

    @classmethod
    def name(cls) -> str:
        return "sound_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("size", SIZE))

    def _folder(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self) -> list[InputPartition]:
        """Each file in ranges of whole blocks; how long a block is in bytes only the file's header says, so that ranges count from an 8-bit sample up."""
        files, folder = self._folder()
        out: list[InputPartition] = []
        step = max(1, RANGE // (2 * self.size))
        for info in sorted(files.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True)), key=lambda i: i.path):
            if m := re.fullmatch(r"(.+/[^/]+)\.wav", info.path[len(folder) :].lstrip("/")):
                most = -(-info.size // self.size)
                out += [_Part(m[1], b, min(b + step, most)) for b in range(0, max(1, most), step)]
        return out or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.stream:
            return
        files, folder = self._folder()
        broadcast, _, stream = partition.stream.rpartition("/")
        try:
            with files.open_input_file(f"{folder}/{partition.stream}.wav") as f, wave.open(f) as w:
                rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
                for block in range(partition.begin, min(partition.end, -(-n // self.size))):
                    w.setpos(block * self.size)
                    pcm = samples(w.readframes(self.size), width, channels)
                    yield self._row(broadcast, stream, rate, channels, block, pcm, None)
        except (wave.Error, EOFError, ValueError) as e:
            if partition.begin == 0:  # a file that can't be read is one row with an error
                yield self._row(broadcast, stream, None, None, None, None, f"failed to load audio: decode: {e}")

    def _row(self, *values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, ARROW.types, strict=True)], schema=ARROW)


def read_blocks(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """broadcast_key, stream_name, sample_rate, channels, block, pcm, error of the recordings of a folder; see operators.long_sound.

    A file that can't be decoded is one row with an error and no samples; one that ends in the middle gives the blocks it has.
    A recording without samples and an empty folder give no rows.
    """
    spark.dataSource.register(SoundBlocks)
    return spark.read.format("sound_blocks").option("path", path).option("size", size).load()
