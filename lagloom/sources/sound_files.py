"""Sound as WAV files: a Python data source that tasks write through, with names alone coming to the driver.

A task encodes its rows into a staging folder of its own try. Once all tasks are done the driver moves what they
name to its place; a try that failed or was lost leaves nothing there. The folder may be on any file system that Arrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lagloom.functions.audio import pcm16
from lagloom.sources.audio_files import encode_wav


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class SoundFiles(DataSource):
    """format("sound_files"), option path; rows (file, sample_rate, pcm)."""

    @classmethod
    def name(cls) -> str:
        return "sound_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], [f.name for f in schema.fields], overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.at = [columns.index(c) for c in ("file", "sample_rate", "pcm")]
        self.run = uuid.uuid4().hex

    def _folder(self) -> tuple[pyarrow.fs.FileSystem, str]:
        files, folder = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return files, folder.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = self._folder()
        own = f"{folder}/_staging/{self.run}/{TaskContext.get().taskAttemptId()}"
        names: list[str] = []
        for batch in iterator:
            plain = zip(*[batch.column(i).to_pylist() for i in self.at[:2]], strict=True)
            for (name, rate), pcm in zip(plain, batch.column(self.at[2]), strict=True):
                if not pcm.is_valid or not rate:
                    continue
                if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                    raise ValueError(f"not a name of a sound file: {name!r}")
                files.create_dir(f"{own}/{name}".rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{own}/{name}") as f:
                    f.write(encode_wav(pcm.values.to_numpy(zero_copy_only=False), rate))
                names.append(name)
        return _Written(own, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Moves the files that tasks name to their place. A name that came twice stops it before anything is moved."""
        files, folder = self._folder()
        written = [(m.folder, name) for m in messages if m for name in m.names]
        if len({name for _, name in written}) < len(written):
            self.abort(messages)
            raise ValueError("several sounds have the same file name")
        if self.overwrite:
            keep = {name for _, name in written}
            for info in files.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True, allow_not_found=True)):
                name = info.path[len(folder) :].lstrip("/")
                if info.type == pyarrow.fs.FileType.File and name.endswith(".wav") and not name.startswith("_") and name not in keep:
                    files.delete_file(info.path)
        for own, name in written:
            files.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
            files.move(f"{own}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Takes away what this run has staged."""
        files, folder = self._folder()
        staged = f"{folder}/_staging/{self.run}"
        if files.get_file_info(staged).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(staged)


def write_sound(streams: DataFrame, path: str, mode: str = "append") -> None:
    """The samples of streams (broadcast_key, stream_name, sample_rate, pcm) as 16-bit WAVs, `{broadcast_key}_{stream_name}.wav`, or as the column file names them.

    append replaces files of the same name, so that a rerun gives the same files; overwrite also takes away other WAVs of the
    folder. Streams without samples are left out; two of one name are an error, and then no file is written.
    """
    streams.sparkSession.dataSource.register(SoundFiles)
    name = F.col("file") if "file" in streams.columns else F.concat("broadcast_key", F.lit("_"), "stream_name", F.lit(".wav"))
    rows = streams.where("size(pcm) > 0").select(name.alias("file"), F.col("sample_rate").cast("int").alias("sample_rate"), pcm16(F.transform("pcm", lambda x: F.coalesce(x, F.lit(0.0)))).alias("pcm"))
    rows.write.format("sound_files").mode(mode).option("path", path).save()
