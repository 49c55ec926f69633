"""Long recordings in blocks, and sound written by tasks."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators import alignment, long_sound
from lagloom.sources.audio_files import decode_wav, encode_wav
from lagloom.sources.sound_blocks import read_blocks
from lagloom.sources.sound_files import write_sound

PAIRS = "broadcast_key string, alignment_name string, stream1 string, stream2 string"


def noise(seed, n):
    """Noise whose loudness changes every 400 samples."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=n) * np.repeat(rng.gamma(0.5, size=n // 400 + 1), 400)[:n] * 1500


def save(folder, name, sound, rate):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(encode_wav(np.clip(sound, -32767, 32767).astype("<i2"), rate))


def test_one_hour_in_blocks(spark, tmp_path):
    """Every block is read by itself, none is larger than its size, and planted lags come out to the sample."""
    rate, size = 4000, 1 << 16
    x = noise(1, rate * 3600 + 40000)
    lags = {"near": 37, "far": 39_999, "early": -25_013}
    save(tmp_path, "g/pri.wav", x[30000 : 30000 + rate * 3600], rate)
    for name, lag in lags.items():
        save(tmp_path, f"g/{name}.wav", x[30000 - lag if lag < 30000 else 0 :][: rate * 3600] if lag < 30000 else np.r_[noise(2, lag - 30000), x][: rate * 3600], rate)
    save(tmp_path, "g/other.wav", noise(3, rate * 3600), rate)
    (tmp_path / "g" / "broken.wav").write_bytes(b"no sound")
    blocks = read_blocks(spark, str(tmp_path), size)
    counts = {r.stream_name: r for r in blocks.groupBy("stream_name").agg(F.count("*").alias("n"), F.max(F.size("pcm")).alias("most"), F.sum(F.size("pcm")).alias("all"), F.max("error").alias("error")).collect()}
    assert counts["pri"].most == size and counts["pri"].all == rate * 3600 and counts["pri"].n == -(-rate * 3600 // size)
    assert counts["broken"].n == 1 and "decode" in counts["broken"].error
    assert blocks.rdd.getNumPartitions() > 5
    named = [*lags, "other", "broken", "none"]
    pairs = spark.createDataFrame([("g", f"pri_vs_{n}", "pri", n) for n in named], PAIRS)
    got = {r.alignment_name.removeprefix("pri_vs_"): r for r in long_sound.align_blocks(pairs, blocks, 15.0, size=size).collect()}
    assert set(got) == set(named)
    for name, lag in lags.items():
        assert got[name].is_valid and got[name].latency_seconds == pytest.approx(lag / rate, abs=0.5 / rate)
    assert not got["other"].is_valid and got["other"].latency_seconds == 0
    assert (got["none"].temporal_offset, got["none"].offset_confidence, got["broken"].is_valid) == (0.0, 0.0, False)


def test_sums_of_blocks():
    """Sums over pairs of blocks are those of the whole, by lag."""
    rng = np.random.default_rng(5)
    a, b, size, most = rng.normal(size=50), rng.normal(size=43), 8, 20
    total = np.zeros((4, 2 * most + 1))
    for i in range(0, len(a), size):
        for j in range(0, len(b), size):
            low, sums = long_sound.partial_sums(a[i : i + size], b[j : j + size], j - i, most)
            total[:, low + most : low + most + sums.shape[1]] += sums
    for lag in range(-most, most + 1):
        at = [t for t in range(len(a)) if 0 <= t + lag < len(b)]
        x, y = a[at], b[[t + lag for t in at]]
        assert total[:, lag + most] == pytest.approx([x @ y, x @ x, y @ y, len(at)])


def test_blocks_agree_with_whole_rows(spark):
    """Short, empty, silent and null recordings, and a missing block, beside align_streams."""
    rate, hop, size = 800, 8, 64
    x = noise(7, 3000)
    sound = [("g", "a", x[500:2500]), ("g", "b", x[463:2463]), ("g", "short", x[500:505]), ("g", "silent", np.zeros(2000)), ("g", "empty", np.zeros(0)), ("g", "null", None), ("h", "a", x[:900]), ("h", "b", x[100:1000])]
    df = spark.createDataFrame([(k, n, None if v is None else v.tolist(), rate) for k, n, v in sound], "broadcast_key string, stream_name string, pcm array<double>, sample_rate int")
    pairs = spark.createDataFrame([("g", f"a_{n}", "a", n) for n in ("b", "short", "silent", "empty", "null", "a")] + [("h", "a_b", "a", "b")], PAIRS)
    found = long_sound.align_blocks(pairs, long_sound.cut(df, size), 0.2, hop=hop, size=size)
    got = {(r.broadcast_key, r.alignment_name): r for r in found.collect()}
    want = {(r.broadcast_key, r.alignment_name): r for r in alignment.align_streams(pairs, df, 0.2, hop=hop).collect()}
    assert len(got) == 7 and got["g", "a_b"].latency_seconds == pytest.approx(37 / rate) and got["h", "a_b"].latency_seconds == pytest.approx(-100 / rate)
    for key, r in want.items():
        assert (got[key].is_valid, got[key].latency_seconds) == (r.is_valid, pytest.approx(r.latency_seconds))
    holed = long_sound.cut(df, size).where("not (stream_name = 'a' and block = 9)")
    again = {(r.broadcast_key, r.alignment_name): r for r in long_sound.align_blocks(pairs, holed, 0.2, hop=hop, size=size).collect()}
    assert again["g", "a_b"].latency_seconds == pytest.approx(37 / rate)
    assert long_sound.align_blocks(pairs.limit(0), holed, 0.2, hop=hop, size=size).count() == 0


SOUND = "broadcast_key string, stream_name string, sample_rate int, pcm array<double>, extra string"


def files_of(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_sound_files(spark, tmp_path):
    rows = [("g_one", f"s{i}", 100, [0.0, 0.5, -0.5, 2.0, float("nan"), None], "x") for i in range(20)] + [("g_one", "null", 100, None, None), ("g_one", "empty", 100, [], None)]
    streams = spark.createDataFrame(rows, SOUND).repartition(6)
    write_sound(streams, str(tmp_path))
    first = files_of(tmp_path)
    assert set(first) == {f"g_one_s{i}.wav" for i in range(20)}
    pcm, rate, channels = decode_wav(first["g_one_s3.wav"])
    assert (rate, channels) == (100, 1) and pcm == pytest.approx([0.0, 0.5, -0.5, 1.0, 0.0, 0.0], abs=1e-4)
    write_sound(streams.repartition(3), str(tmp_path))  # a rerun
    assert files_of(tmp_path) == first
    write_sound(streams.where("stream_name = 's4'"), str(tmp_path), mode="overwrite")
    assert set(files_of(tmp_path)) == {"g_one_s4.wav"}
    write_sound(streams.limit(0), str(tmp_path))
    assert set(files_of(tmp_path)) == {"g_one_s4.wav"}


def test_failed_write_leaves_nothing(spark, tmp_path):
    streams = spark.createDataFrame([("g", f"s{i}", 100, [0.1] * 10, "x") for i in range(8)], SOUND).repartition(4)
    broken = streams.withColumn("sample_rate", F.when(F.col("stream_name") == "s5", F.raise_error(F.lit("lost")).cast("int")).otherwise(100))
    twice = streams.withColumn("file", F.when(F.col("stream_name") < "s2", "same.wav").otherwise(F.concat("stream_name", F.lit(".wav"))))
    outside = streams.withColumn("file", F.lit("../x.wav"))
    for bad in (broken, twice, outside):
        with pytest.raises(Exception, match="lost|same file name|not a name"):
            write_sound(bad, str(tmp_path / "out"))
        assert not files_of(tmp_path)


def test_written_sound_is_read_again(spark, tmp_path):
    streams = spark.createDataFrame([("g", n, 100, [0.25, -0.25] * 50, "x") for n in ("a", "b")], SOUND)
    write_sound(streams.withColumn("file", F.concat_ws("/", "broadcast_key", F.concat("stream_name", F.lit(".wav")))), str(tmp_path))
    got = read_blocks(spark, str(tmp_path), 30).orderBy("stream_name", "block").collect()
    assert [(r.stream_name, r.block, len(r.pcm)) for r in got] == [(n, i, 30 if i < 3 else 10) for n in "ab" for i in range(4)]
    assert got[0].pcm[:2] == pytest.approx([0.25, -0.25], abs=1e-4)
