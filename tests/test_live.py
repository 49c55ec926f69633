"""Streams with state: late rows, silent streams, restarts, and sound of live segments, each against the batch."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators.config import RunSettings
from lagloom.plans import benchmark
from lagloom.sources.audio_files import encode_wav
from lagloom.sources.live_segments import read_segments, ready
from lagloom.streaming.changes import changed
from lagloom.streaming.state import as_streams, follow, silences, silences_of, sound_windows

SF = "/root/testdata/sf0.001/events.parquet"
ZERO = datetime.datetime(2030, 1, 1)


def run(df, folder, files=None):
    """Runs a stream over what there is, and returns all that it has written so far."""
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    return df.sparkSession.read.parquet(f"{folder}/out")


def polls(spark, folder, batches, schema):
    """Writes a file for each batch of rows; returns the stream over them."""
    before = len(os.listdir(folder)) if os.path.isdir(folder) else 0
    for n, rows in enumerate(batches, before):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n:05d}")
        for name in os.listdir(f"{folder}/{n:05d}"):  # files are taken in order of their times
            os.utime(f"{folder}/{n:05d}/{name}", (1_900_000_000 + n, 1_900_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def second(s):
    return ZERO + datetime.timedelta(seconds=s)


def test_late_rows_give_the_batch(spark, tmp_path):
    events = spark.read.parquet(SF).select("event_id", F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("title"))
    rows = events.orderBy("ts", "event_id").collect()
    # Every file holds rows that are older than rows of the file before it.
    order = sorted(range(len(rows)), key=lambda i: (i // 50 - (i % 7 == 0)) * 50 + i % 50)
    shuffled = [rows[i] for i in order]
    batches = [shuffled[i : i + 250] for i in range(0, len(rows), 250)]
    far = (-1, 10**6, max(r.ts for r in rows) + datetime.timedelta(days=4000), "x")
    schema = events.schema
    stream = polls(spark, f"{tmp_path}/in", [[tuple(r) for r in b] for b in batches[:2]], schema)
    df = follow(stream, "stream", "ts", ["event_id"], "title", late="3000 days")
    run(df, tmp_path)
    # Started again in the middle, with the rest and a row that lets the watermark pass all others.
    polls(spark, f"{tmp_path}/in", [[tuple(r) for r in b] for b in batches[2:]] + [[far]], schema)
    got = run(follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), "stream", "ts", ["event_id"], "title", late="3000 days"), tmp_path)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in changed(events, "stream", ["ts", "event_id"], "title").collect())


def test_follow_forgets_silent_streams(spark, tmp_path):
    schema = "stream string, ts timestamp, title string, n long"
    rows = [("s", 0, "a", 1), ("s", 5, "a", 2), ("s", 7, "", 3), ("s", 9, None, 4), ("s", 100, "a", 5), ("s", 104, "b", 1 << 60), ("t", 3, "a", 7), ("t", 8, "a", 8)]
    made = [(s, second(t), v, n) for s, t, v, n in rows] + [("u", None, "no time", 9)]
    batches = [made[:2], made[6:8], made[2:5], [made[5], made[8], ("far", second(10_000), "x", 0)], [("far", second(10_001), "x", 0)]]
    got = run(follow(polls(spark, f"{tmp_path}/in", batches, schema), "stream", "ts", ["n"], "title", keep_empty=False, late="60 seconds", silent_s=30), tmp_path)
    assert sorted((r.stream, r.n) for r in got.collect()) == [("s", 1), ("s", 5), ("s", 1 << 60), ("t", 7)]
    twin = changed(spark.createDataFrame(made[:8], schema), "stream", ["ts", "n"], "title", keep_empty=False, silent_s=30)
    assert sorted((r.stream, r.n) for r in twin.collect()) == sorted((r.stream, r.n) for r in got.collect())
    # Nothing is kept of streams that are silent: two keys have had state, of which the last one alone remains.
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/ck").selectExpr("key.*")
    assert {tuple(r)[0] for r in state.collect()} <= {"far"}


def test_silences(spark, tmp_path):
    schema = "stream string, ts timestamp"
    rows = [("s", 0), ("s", 20), ("s", 75), ("s", 80), ("t", 10), ("t", 40), ("far", 500)]
    made = [(k, second(t)) for k, t in rows]
    expected = spark.createDataFrame([("s", second(0)), ("never", second(2))], "stream string, started timestamp")
    batches = [[made[1], made[0]], [made[4]], [made[5], made[2]], [made[3]], [made[6]]]
    got = run(silences(polls(spark, f"{tmp_path}/in", batches, schema), "stream", "ts", 30, late="60 seconds", expected=expected), tmp_path)
    want = [("never", second(2), second(32)), ("s", second(20), second(50)), ("s", second(80), second(110)), ("t", second(40), second(70))]
    assert sorted((r.stream, r.since, r.ts) for r in got.collect()) == want
    assert {r.error for r in got.collect()} == {"timeout: no data for 30s"}
    twin = silences_of(spark.createDataFrame(made, schema), "stream", "ts", 30, second(440), expected)
    assert sorted((r.stream, r.since, r.ts) for r in twin.where("stream != 'far'").collect()) == want


def test_gaps_are_waited_for():
    assert ready([5], 3) == 5 and ready([1, 2, 3], 3) == 3
    assert ready([1, 2, 4, 5], 3) == 2 and ready([1, 2, 4, 5, 6], 3) == 6


RATE, PART = 8000, 8000


def segments(folder, sound, first, last, stream="g_b/pri_source", skip=()):
    os.makedirs(f"{folder}/{stream}", exist_ok=True)
    for k in range(first, last):
        if k not in skip:
            with open(f"{folder}/{stream}/{k}.wav", "wb") as f:
                f.write(encode_wav(sound[(k - 1) * PART : k * PART].tolist(), RATE))


@pytest.fixture
def sound():
    rng = np.random.default_rng(3)
    loud = np.repeat(rng.uniform(500, 20_000, 200), PART // 10)
    return (rng.uniform(-1, 1, len(loud)) * loud).astype(np.int64)


def test_sound_windows_after_a_restart(spark, tmp_path, sound):
    segments(f"{tmp_path}/in", sound, 1, 5)
    segments(f"{tmp_path}/in", sound, 3, 4, "g_b/ti_hls")
    read = lambda: sound_windows(read_segments(spark, f"{tmp_path}/in", stream=True), 1.5)
    run(read(), tmp_path)
    segments(f"{tmp_path}/in", sound, 5, 9, skip=(6,))
    run(read(), tmp_path)  # 6 is missing, and is given up only once enough has come after it
    segments(f"{tmp_path}/in", sound, 6, 7)
    segments(f"{tmp_path}/in", sound, 9, 11)
    rows = run(read(), tmp_path).orderBy("window").collect()
    assert [r.window for r in rows] == list(range(6)) and all(r.error is None and r.stream_name == "pri_source" for r in rows)
    # The same as the whole recording, cut as a batch.
    for r in rows:
        assert np.array_equal(np.round(np.array(r.pcm) * 32768), sound[r.window * 12_000 : (r.window + 1) * 12_000])
    batch = read_segments(spark, f"{tmp_path}/in").where("stream_name = 'pri_source'").orderBy("sequence").collect()
    whole = np.concatenate([r.pcm for r in batch])
    assert np.array_equal(whole[: 6 * 12_000], np.concatenate([r.pcm for r in rows]))


def test_sound_with_faults(spark, tmp_path, sound):
    segments(f"{tmp_path}/in", sound, 1, 12, skip=(4,))
    with open(f"{tmp_path}/in/g_b/pri_source/8.wav", "wb") as f:
        f.write(b"junk")
    rows = run(sound_windows(read_segments(spark, f"{tmp_path}/in", stream=True), 2.0), tmp_path).orderBy("window").collect()
    assert [(r.window, r.first_sequence, r.error and r.error.split(":")[1].split(" (")[0][:24]) for r in rows] == [(0, 1, None), (1, 3, " missing segments 4 to 4"), (2, 5, None), (3, 7, " decode"), (4, 9, None)]
    assert read_segments(spark, f"{tmp_path}/nothing").count() == 0


def test_lags_of_live_sound(spark, tmp_path, sound):
    """What comes in is cut and aligned: a copy that is 800 samples late, window by window."""
    late = np.concatenate([np.zeros(800, np.int64), sound])
    segments(f"{tmp_path}/in", sound, 1, 11)
    segments(f"{tmp_path}/in", late, 1, 11, "g_b/ti_hls")
    windows = run(sound_windows(read_segments(spark, f"{tmp_path}/in", stream=True), 5.0), tmp_path)
    streams = spark.createDataFrame([("g_b", "pri_source", "source", "hls", "news", "u", True, None), ("g_b", "ti_hls", "cdn", "hls", "news", "v", True, None)], "broadcast_key string, stream_name string, role string, type string, content_type string, url string, enabled boolean, error string")
    measured = as_streams(windows, streams)
    broadcasts = measured.select("broadcast_key").distinct().withColumns({"name": F.lit("b"), "content_type": F.lit("news"), "total_s": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    found = benchmark.run(broadcasts, measured, RunSettings(max_alignment_offset=1.0).filled(), hop=64).alignments.collect()
    assert sorted((r.broadcast_key, round(r.latency_seconds, 3)) for r in found) == [("g_b@0", 0.1), ("g_b@1", 0.1)]
