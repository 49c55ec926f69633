"""Titles and frames planted in bytes come out again, however the bytes are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.sources import byte_captures, playlists
from lagloom.sources.byte_captures import Splitter, frame_at, scan


def planted(rng, every, titles):
    """An interleaved stream, its sound, and (bytes of sound before it, title) of its titles."""
    out, sound, said = b"", b"", []
    for title in titles:
        part = rng.bytes(every)
        text = f"StreamTitle='{title}';".encode() if title else b""
        blocks = -(-len(text) // 16)
        sound += part
        out += part + bytes([blocks]) + text.ljust(16 * blocks, b"\0")
        if title:
            said.append((len(sound), title))
    return out + b"tail", sound + b"tail", said


TITLES = ["A - B", "", "it's", "ünï", "x" * 3000, "", "last"]


@pytest.mark.parametrize("cut", [1, 7, 16, 33, 100000])
def test_splitter(cut):
    data, sound, said = planted(np.random.default_rng(cut), 50, TITLES)
    s = Splitter(50)
    parts = [p for i in range(0, len(data), cut) for p in s.split(data[i : i + cut])]
    assert b"".join(d for k, _, d in parts if k == "sound") == sound
    assert [(at, d.decode()) for k, at, d in parts if k == "title"] == [(at, f"StreamTitle='{t}';") for at, t in said]


def test_streams(spark):
    rng = np.random.default_rng(3)
    rows, want, sounds = [], {}, {}
    for name, every, cut in (("a", 64, 10), ("b", 500, 333), ("c", 64, 4000)):
        data, sounds[name], said = planted(rng, every, TITLES)
        want[name] = [(at, t) for at, t in said]
        rows += [(name, 5 + n, every, data[i : i + cut], "x") for n, i in enumerate(range(0, len(data), cut))]
    rows += rows[:4]  # delivered twice
    rows += [("plain", 0, 0, b"abc", None), ("plain", 1, None, b"de", None), ("nothing", 0, 8, None, None), ("gap", 0, 4, b"soun", None), ("gap", 2, 4, b"dddd", None), ("gap", 3, 4, b"d", None), (None, 0, 0, b"z", None)]
    parts = byte_captures.icy_parts(spark.createDataFrame(rows, "stream string, chunk long, every int, data binary, at string").repartition(5))
    got = parts.orderBy("stream", "chunk", "at").collect()
    for name in want:
        assert b"".join(bytes(r.data) for r in got if r.stream == name and r.kind == "sound") == sounds[name]
    titles = byte_captures.icy_titles(parts).orderBy("stream", "at").collect()
    assert {n: [(r.at, r.title) for r in titles if r.stream == n] for n in want} == want
    assert [bytes(r.data) for r in got if r.stream == "plain"] == [b"abc", b"de"] and not [r for r in got if r.stream == "nothing"]
    assert [(r.kind, r.text) for r in got if r.stream == "gap"] == [("sound", None), ("error", "chunk 1 is missing")]
    assert [bytes(r.data) for r in got if r.stream is None] == [b"z"]


def adts(rate, channels, size):
    return bytes([0xFF, 0xF1, 0x40 | rate << 2 | channels >> 2, (channels & 3) << 6 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 31, 0xFC]) + bytes(size - 7)


def mp3(kbps, rate, mode, pad=0):
    size = frame_at(head := bytes([0xFF, 0xFB, kbps << 4 | rate << 2 | pad << 1, mode << 6]) + bytes(4), 0)[4]
    return head[:4] + bytes(size - 4)


def test_frames():
    assert frame_at(adts(4, 2, 371), 0) == ("aac", 44100, 2, 1024, 371) and frame_at(adts(3, 1, 8000), 0) == ("aac", 48000, 1, 1024, 8000)
    assert frame_at(mp3(9, 0, 0), 0) == ("mp3", 44100, 2, 1152, 417) and frame_at(mp3(9, 0, 3, 1), 0) == ("mp3", 44100, 1, 1152, 418)
    assert frame_at(bytes([0xFF, 0xF3, 0x80, 0, 0]), 0) == ("mp3", 22050, 2, 576, 208)
    for none in (b"", b"\xff", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", bytes(20)):
        assert frame_at(none, 0) is None
    tag = b"ID3\x04\x00\x00\x00\x00\x01\x00" + b"\xff" * 128
    assert scan(tag + mp3(9, 0, 0) * 10) == ("mp3", 44100, 2, 10, 4170, pytest.approx(11520 / 44100), 138)
    assert scan(b"junk\xff\xfb" + adts(4, 2, 200) * 3 + adts(4, 2, 200)[:5])[3:5] == (3, 600)
    assert scan(b"") == (None, None, None, 0, 0, 0.0, 0) and scan(b"\xff" * 50)[3] == 0


def test_durations_are_those_of_the_playlist(spark):
    """Segments of a playlist hold as much sound as it says, to a frame."""
    said = [5.0, 6.2, 0.5]
    files = [(f"{i}.aac", adts(4, 2, 300 + i) * round(d * 44100 / 1024), i) for i, d in enumerate(said)] + [("empty.aac", b"", 0), ("null.aac", None, 0)]
    text = "#EXTM3U\n" + "".join(f"#EXTINF:{d},\n{i}.aac\n" for i, d in enumerate(said))
    found = byte_captures.frames(spark.createDataFrame(files, "uri string, content binary, frames int"), "uri")
    listed = playlists.segments(spark.createDataFrame([("p", text)], "playlist_url string, content string"))
    rows = listed.join(found, "uri").collect()
    assert len(rows) == 3 and all(abs(r.duration - r.duration_s) <= 1024 / 44100 and r.codec == "aac" for r in rows)
    none = {r.uri: (r.frames, r.codec, r.bitrate) for r in found.where(F.col("frames") == 0).collect()}
    assert none == {"empty.aac": (0, None, None), "null.aac": (0, None, None)}
