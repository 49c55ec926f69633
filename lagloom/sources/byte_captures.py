"""Bytes as streams deliver them: sound with titles between, and frames of compressed sound, of which only headers are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = pa.schema([("stream", pa.string()), ("chunk", pa.int64()), ("kind", pa.string()), ("at", pa.int64()), ("data", pa.binary()), ("text", pa.string())])


class Splitter:
    """Splits the bytes of one stream, chunk by chunk: `every` bytes of sound, a byte that counts blocks of 16 bytes, and these."""

    def __init__(self, every: int):
        self.every, self.at = every, 0  # at: bytes of sound so far
        self.sound, self.need, self.text = every, 0, b""

    def split(self, data: bytes) -> list[tuple[str, int, bytes]]:
        """(sound or title, bytes of sound before it, bytes); a title is told once its last byte has come, an empty one never."""
        if self.every <= 0:  # a stream without titles
            self.at += len(data)
            return [("sound", self.at - len(data), data)] if data else []
        out, i = [], 0
        while i < len(data):
            if self.sound:
                part = data[i : i + self.sound]
                out.append(("sound", self.at, part))
                self.at, self.sound, i = self.at + len(part), self.sound - len(part), i + len(part)
                if not self.sound:
                    self.need = -1
            elif self.need < 0:
                self.need, self.text, i = 16 * data[i], b"", i + 1
                if not self.need:
                    self.sound = self.every
            else:
                part = data[i : i + self.need]
                self.text, self.need, i = self.text + part, self.need - len(part), i + len(part)
                if not self.need:
                    self.sound = self.every
                    if title := self.text.rstrip(b"\0"):
                        out.append(("title", self.at, title))
        return out


def icy_parts(chunks: DataFrame) -> DataFrame:
    """stream, chunk, kind, at, data, text of chunks (stream, chunk, every, data): what lies in a chunk, and how much sound of the stream came before it.

    kind is sound (data), title (text, told in the chunk where it ends) or error. Chunks count up by one from the first; after a gap, or a second chunk
    of one number with other bytes, nobody knows where titles begin, and the rest of a stream is one error. Repeated chunks count once, null
    data is empty, every is that of the first chunk (null or 0: no titles). A stream is read in order by one task, which holds one chunk and one title of at most 4080 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, now, last, held, lost = None, None, None, None, False
        for batch in batches:
            rows: list[tuple] = []
            for name, chunk, every, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = data or b""
                if now is None or name != stream:
                    stream, now, last, held, lost = name, Splitter(every or 0), chunk - 1, None, False
                if lost or chunk == last and data == held:
                    continue
                if chunk != last + 1:
                    lost = True
                    rows.append((name, chunk, "error", now.at, None, f"chunk {last + 1} is missing" if chunk > last else f"chunk {chunk} came twice"))
                    continue
                rows += [(name, chunk, kind, at, part if kind == "sound" else None, part.decode("utf-8", "replace") if kind == "title" else None) for kind, at, part in now.split(data)]
                last, held = chunk, data
            columns = zip(*rows, strict=True) if rows else [()] * len(PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PARTS.types, strict=True)], schema=PARTS)

    ordered = chunks.select(F.col("stream").cast("string"), F.col("chunk").cast("long"), F.col("every").cast("int"), F.col("data").cast("binary")).where("chunk is not null")
    ordered = ordered.repartition("stream").sortWithinPartitions("stream", "chunk", "data")
    return ordered.mapInArrow(run, "stream string, chunk long, kind string, at long, data binary, text string")


def icy_titles(parts: DataFrame) -> DataFrame:
    """stream, at, title, url of the titles among parts; an empty field is null."""
    field = lambda name: F.nullif(F.regexp_extract("text", rf"{name}='([\s\S]*?)'(?:;|$)", 1), F.lit(""))
    return parts.where("kind = 'title'").select("stream", "at", field("StreamTitle").alias("title"), field("StreamUrl").alias("url"))


# Fixed values of the standards: rates of ADTS by index; of MPEG audio, layer III, rates by version and kbit/s by version.
ADTS_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
MPEG_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
MPEG1_KBPS = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
MPEG2_KBPS = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]


def frame_at(data: bytes, i: int) -> tuple[str, int, int, int, int] | None:
    """Codec, rate, channels, samples and bytes of the frame whose header is at i; None if there is none."""
    if i + 4 > len(data) or data[i] != 0xFF or data[i + 1] & 0xE0 != 0xE0:
        return None
    a, b, c = data[i + 1], data[i + 2], data[i + 3]
    if a & 0xF6 == 0xF0:  # ADTS: twelve bits of sync, layer 0
        if i + 7 > len(data) or b >> 2 & 15 >= len(ADTS_RATES):
            return None
        size = (c & 3) << 11 | data[i + 4] << 3 | data[i + 5] >> 5
        channels = (b & 1) << 2 | c >> 6
        return ("aac", ADTS_RATES[b >> 2 & 15], 8 if channels == 7 else channels, 1024 * ((data[i + 6] & 3) + 1), size) if size >= 7 else None
    version, rate, kbps = a >> 3 & 3, b >> 2 & 3, b >> 4
    if a >> 1 & 3 != 1 or version == 1 or rate == 3 or not 0 < kbps < 15:
        return None
    hz, per = MPEG_RATES[version][rate], 144 if version == 3 else 72
    return "mp3", hz, 1 if c >> 6 == 3 else 2, 8 * per, per * 1000 * (MPEG1_KBPS if version == 3 else MPEG2_KBPS)[kbps] // hz + (b >> 1 & 1)


def scan(data: bytes) -> tuple[str | None, int | None, int | None, int, int, float, int]:
    """Codec, rate and channels of the first frame, frames, bytes in frames, seconds, and bytes that are in no frame.

    A tag in front is passed over. A frame counts if it is whole and ends at the end, at another frame, or at the rest of one.
    """
    i = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        i = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    first, frames, inside, samples = None, 0, 0, {}
    while i < len(data):
        found = frame_at(data, i)
        if found:
            end = i + found[4]
            if end == len(data) or end < len(data) and (frame_at(data, end) or len(data) - end < 7):
                first = first or found
                frames, inside, i = frames + 1, inside + found[4], end
                samples[found[1]] = samples.get(found[1], 0) + found[3]
                continue
        i = data.find(b"\xff", i + 1)
        if i < 0:
            break
    return (*(first[:3] if first else (None, None, None)), frames, inside, float(sum(n / rate for rate, n in samples.items())), len(data) - inside)


def frames(files: DataFrame, key: str = "path") -> DataFrame:
    """key, codec, sample_rate, channels, frames, bitrate (bits a second), duration_s, other_bytes of files (key, content), from headers alone.

    A file without frames, empty or null, has 0 frames and null codec, rate, channels and bitrate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x.as_py() or b"") for x in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [key, "codec", "sample_rate", "channels", "frames", "inside", "duration_s", "other_bytes"])

    kind = files.schema[key].dataType.simpleString()
    made = files.select(key, "content").mapInArrow(run, f"`{key}` {kind}, codec string, sample_rate int, channels int, frames long, inside long, duration_s double, other_bytes long")
    return made.select(key, "codec", "sample_rate", "channels", "frames", F.expr("try_divide(8 * inside, duration_s)").alias("bitrate"), "duration_s", "other_bytes")
