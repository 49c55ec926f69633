"""Recordings: WAV files as rows of samples, and measured streams made from them."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.functions.audio import duration, first_seconds
from lagloom.functions.text import split_key
from lagloom.functions.urls import is_local
from lagloom.operators.validate import stream_validation


def samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples of all channels averaged, -1 to 1, of integer PCM of 8 to 32 bits."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1)


def decode_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """Samples, rate and channels of a file."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    return samples(raw, width, channels), rate, channels


def encode_wav(samples: list[int], rate: int) -> bytes:
    """A mono file of 16-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, pcm, sample_rate, channels, error) of all files of a folder; a file that can't be decoded has an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decoded(files)


def decoded(files: DataFrame) -> DataFrame:
    """What read_audio gives, of files (path, content), which may be a stream of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pcm, rate, channels = decode_wav(data)
                    rows.append((name, pcm, rate, channels, None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((name, None, None, None, f"failed to load audio: decode: {e}"))
            names, pcm, rate, channels, error = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pcm, pa.list_(pa.float64())), pa.array(rate, pa.int32()), pa.array(channels, pa.int32()), pa.array(error, pa.string())], ["path", "pcm", "sample_rate", "channels", "error"])

    # Spark bounds a batch by its bytes, so that large recordings come few at a time.
    return files.select("path", "content").mapInArrow(run, "path string, pcm array<double>, sample_rate int, channels int, error string")


def _bare(address: Column) -> Column:
    """A URL or path without scheme, query and fragment, and without ./ or slashes in front."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(address, r"[?#][\s\S]*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:/*", ""), r"^(\./|/)+", "")


def found_recordings(streams: DataFrame, audio: DataFrame, root: str = "") -> DataFrame:
    """(broadcast_key, stream_name, path, recordings, streams): the file of audio (path) that holds a stream, how many would do, and of how many streams it is taken for the sound.

    A stream that names a file (no http URL) is that very file, by its whole path or by its path below root. A
    URL is a file at its host and path, or at its path, below root, whatever comes after its own ending
    (`ti/master.m3u8.wav`). Else a capture named for the stream holds it: `{broadcast}_{stream}`, with or without its seconds and
    ending, where broadcast is the whole key or the part after the group. Only the best of these kinds counts. A path
    without its host and a broadcast without its group may be those of other streams, too: then streams counts them. A
    file that is named in full counts one stream, since several may have the very same URL.
    """
    below = F.when(F.lit(bool(root)) & F.contains(F.col("path"), F.lit(_folder(root))), F.substring_index(F.col("path"), _folder(root), -1)).otherwise(F.col("path"))
    last = F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"\.[A-Za-z0-9]{2,4}$", "")
    files = audio.select("path", F.explode(F.array_distinct(F.array(_bare(F.col("path")), _bare(below), F.regexp_replace(_bare(below), r"\.wav$", ""), F.concat(F.lit("\0"), last), F.concat(F.lit("\0"), F.regexp_replace(last, r"_\d+s$", ""))))).alias("__key"))
    url, named = F.col("url"), F.coalesce(split_key(F.col("broadcast_key"))["broadcast"], F.col("broadcast_key"))
    path = F.regexp_replace(_bare(url), r"^[^/]*/", "")
    capture = lambda b: F.concat(F.lit("\0"), b, F.lit("_"), F.col("stream_name"))
    ways = [_bare(url), F.when(~is_local(url), F.nullif(path, F.lit(""))), capture(F.col("broadcast_key")), capture(named)]
    keyed = streams.select("broadcast_key", "stream_name", F.posexplode(F.array(*ways)).alias("__kind", "__key"))
    matched = keyed.join(files, "__key").groupBy("broadcast_key", "stream_name").agg(F.min(F.struct("__kind", "path")).alias("best"), F.collect_set(F.struct("__kind", "path")).alias("all"))
    same = F.size(F.array_distinct(F.transform(F.filter("all", lambda x: x["__kind"] == F.col("best.__kind")), lambda x: x["path"])))
    # The full capture name of a broadcast without a group is its short one, too.
    loose = F.col("best.__kind").isin(1, 3)
    sharing = F.count("*").over(Window.partitionBy("best.path"))
    return matched.select("broadcast_key", "stream_name", F.col("best.path").alias("path"), same.alias("recordings"), F.when(loose, sharing).otherwise(1).alias("streams"))


def _folder(root: str) -> str:
    return root.removeprefix("file://").rstrip("/") + "/"


def measure(streams: DataFrame, audio: DataFrame, segment_s: float = 90.0, root: str = "") -> DataFrame:
    """stream_measurements of catalogue streams with the recordings of audio; streams without one, with several, or with one that other streams would have, too, have an error.

    The samples are cut to the segment, and the duration of a file counts whole seconds. How long a file took to come isn't known: both times are null.
    """
    found = found_recordings(streams, audio, root)
    joined = streams.drop("error").join(found, ["broadcast_key", "stream_name"], "left").join(audio, "path", "left")
    several, shared = F.col("recordings") > 1, F.col("streams") > 1
    cut = F.when(~several & ~shared, first_seconds(F.col("pcm"), segment_s, F.col("sample_rate")))
    address = F.coalesce("url", F.lit(""))
    wrong = F.when(several, F.concat(F.lit("failed to load audio: several recordings of "), address)).when(shared, F.concat(F.lit("failed to load audio: a recording of several streams for "), address)).when(F.col("path").isNull(), F.concat(F.lit("failed to load audio: connection: no recording of "), address))
    made = joined.withColumns({"pcm": cut, "error": F.coalesce(wrong, F.col("error"), F.when(F.col("pcm").isNull(), F.concat(F.lit("failed to load audio: connection: no sound of "), address)))}).drop("path", "recordings", "streams")
    made = made.withColumn("duration_s", duration(F.col("pcm"), F.col("sample_rate"), whole_seconds=True))
    check = stream_validation(F.col("type"), F.col("sample_rate"), F.col("channels"), F.size("pcm"), F.col("duration_s"), segment_s)
    return made.withColumns({"validation": F.when(F.col("error").isNull(), check), "ttfb_ns": F.lit(None).cast("long"), "total_ns": F.lit(None).cast("long")})


def replayed(spark: SparkSession, path: str, files_at_once: int = 10) -> DataFrame:
    """A stream of the recordings of a folder, (path, modificationTime, length, content), as they come in."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(path)
