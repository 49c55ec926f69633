"""Captured segments of live streams as a stream: a Python data source that replays them by media sequence.

A folder holds `{broadcast}/{stream}/{sequence}.wav`, below any file system that Arrow knows. Segments may
turn up at any time and in any order. What is read so far is an offset, the last sequence of each
stream, which Spark keeps in the query's checkpoint: a query that starts again goes on where it stood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lagloom.sources.audio_files import decode_wav

SCHEMA = "broadcast_key string, stream_name string, sequence long, ts timestamp, sample_rate int, channels int, pcm array<double>, error string"
ARROW = pa.schema([
    ("broadcast_key", pa.string()), ("stream_name", pa.string()), ("sequence", pa.int64()), ("ts", pa.timestamp("us", "UTC")),
    ("sample_rate", pa.int32()), ("channels", pa.int32()), ("pcm", pa.list_(pa.float64())), ("error", pa.string()),
])
#: Segments of a partition, at most: a task holds one of them at a time.
SEGMENTS = 32
#: Segments that may come after a missing one before it is given up.
PATIENCE = 3


def listed(path: str) -> tuple[pyarrow.fs.FileSystem, str, dict[str, list[int]]]:
    """The file system, the folder in it, and the ascending sequences of each stream (`broadcast/stream`)."""
    files, folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found: dict[str, list[int]] = {}
    for info in files.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True, allow_not_found=True)):
        if m := re.fullmatch(r"(.+/[^/]+)/(\d+)\.wav", info.path[len(folder) :].lstrip("/")):
            found.setdefault(m[1], []).append(int(m[2]))
    return files, folder, {k: sorted(v) for k, v in found.items()}


def ready(sequences: list[int], patience: int) -> int:
    """The last sequence to be read yet: up to the first gap that isn't given up."""
    last = sequences[0]
    for s in sequences[1:]:
        if s > last + 1 and sequences[-1] - last <= patience:
            break
        last = s
    return last


class _Range(InputPartition):
    def __init__(self, stream: str, sequences: list[int]):
        self.stream, self.sequences = stream, sequences


class CapturedSegments(DataSource):
    """format("captured_segments"), options path and patience; batch and stream give the same rows."""

    @classmethod
    def name(cls) -> str:
        return "captured_segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Segments:
    def __init__(self, options: dict):
        self.path, self.patience = options["path"], int(options.get("patience", PATIENCE))

    def ranges(self, start: dict, end: dict) -> list[InputPartition]:
        """Sequences after start up to end, those of a stream in ranges."""
        found = listed(self.path)[2]
        out: list[InputPartition] = []
        for stream, last in sorted(end.items()):
            own = [s for s in found.get(stream, []) if start.get(stream, -1) < s <= last]
            out += [_Range(stream, own[i : i + SEGMENTS]) for i in range(0, len(own), SEGMENTS)]
        return out or [_Range("", [])]

    def ends(self) -> dict:
        return {stream: ready(own, self.patience) for stream, own in listed(self.path)[2].items()}

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for s in partition.sequences:
            broadcast, _, stream = partition.stream.rpartition("/")
            name = f"{folder}/{partition.stream}/{s}.wav"
            made = files.get_file_info(name).mtime
            try:
                with files.open_input_stream(name) as f:
                    pcm, rate, channels = decode_wav(f.read())
                row = (broadcast, stream, s, made, rate, channels, pcm, None)
            except Exception as e:  # a segment that can't be read is a row with an error
                row = (broadcast, stream, s, made, None, None, None, f"failed to load audio: decode: {e}")
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, ARROW.types, strict=True)], schema=ARROW)


class _Batch(_Segments, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.ranges({}, self.ends())


class _Stream(_Segments, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.ranges(start, end)

    def commit(self, end: dict) -> None:
        pass


def read_segments(spark: SparkSession, path: str, stream: bool = False, patience: int = PATIENCE) -> DataFrame:
    """broadcast_key, stream_name, sequence, ts (when the file was written), sample_rate, channels, pcm, error of the segments of a folder.

    A segment that can't be decoded has an error and no samples. A gap in a stream's sequences holds up what comes
    after it until more than patience segments have, and is then given up; an empty folder gives no rows.
    """
    spark.dataSource.register(CapturedSegments)
    source = (spark.readStream if stream else spark.read).format("captured_segments")
    return source.option("path", path).option("patience", patience).load()
