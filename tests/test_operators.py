"""Operators on hand-made tables, and the rules that are easy to get wrong."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators import alignment, catalog, config, liveness, pairing, quality, segments, stats, timers, validate


def percentile(xs, p):
    xs = sorted(xs)
    at = p / 100 * (len(xs) - 1)
    low = int(at)
    return xs[low] if at == low else xs[low] * (1 - (at - low)) + xs[low + 1] * (at - low)


def test_statistics(spark):
    rnd = random.Random(1)
    series = {"a": [rnd.uniform(-5, 50) for _ in range(37)], "b": [7.0], "c": [1.0, 2.0]}
    rows = {r.k: r for r in stats.stats_by(spark.createDataFrame([(k, x) for k, xs in series.items() for x in xs], "k string, x double"), ["k"], "x").collect()}
    for k, xs in series.items():
        r = rows[k]
        want = (len(xs), statistics.fmean(xs), percentile(xs, 50), percentile(xs, 95), percentile(xs, 99), min(xs), max(xs), statistics.pstdev(xs))
        assert (r["count"], r.mean, r.median, r.p95, r.p99, r.min, r.max, r.std_dev) == pytest.approx(want)


def test_empty_series_are_zero_and_presence(spark):
    values = spark.createDataFrame([("latency_hls_ais", 1.5), ("time_to_first_byte", 3.0)], "metric string, value double")
    rows = {r.metric: r for r in stats.performance_metrics(values).collect()}
    assert rows["latency_hls_cloudfront"]["count"] == 0 and rows["latency_hls_cloudfront"].mean == 0.0
    assert rows["latency_source"]["count"] is None and rows["latency_hls_ais_from_backup"].mean is None
    rows = {r.metric: r for r in stats.performance_metrics(values.union(spark.createDataFrame([("latency_source", 2.0)], values.schema))).collect()}
    assert rows["latency_source"].mean == 2.0 and rows["latency_hls_ais_from_backup"]["count"] == 0


def test_pairs(spark):
    rows = [("b", n, r) for n, r in (("pri_source", "source"), ("bk_source", "source"), ("ti_hls", "cdn"), ("pri_copy", "cdn"), ("primary", "source"))] + [("other", "ti_mp3", "cdn")]
    names = {r.alignment_name for r in pairing.pair_streams(spark.createDataFrame(rows, "broadcast_key string, stream_name string, role string")).collect()}
    assert names == {f"{a}_vs_{b}" for a in ("pri_source", "primary") for b in ("bk_source", "ti_hls", "pri_copy")}


def test_guard(spark):
    b = spark.createDataFrame([("x", None), ("y", None), ("z", "earlier")], "broadcast_key string, error string")
    s = spark.createDataFrame([("x", None, (True,)), ("x", None, (True,)), ("y", None, (True,)), ("y", "e", (True,)), ("y", None, (False,))], "broadcast_key string, error string, validation struct<is_valid: boolean>")
    rows = {r.broadcast_key: (r.valid_streams, r.error) for r in pairing.guard(b, s).collect()}
    assert rows == {"x": (2, None), "y": (1, "insufficient valid streams (1) for alignment"), "z": (0, "earlier")}


def test_status(spark):
    rows = [
        ("pri_source_vs_ti_hls", 1.0, True, 0.9, "MATCH"), ("pri_source_vs_ss_ais_hls", -1.0, True, 0.9, "NO_ALIGNMENT"), ("pri_source_vs_ti_mp3", -1.0, True, 0.1, "NO_MATCH"),
        ("pri_source_vs_ss_ais_mp3", -0.0004, True, 0.9, "MATCH"), ("pri_source_vs_bk_source", -1.0, True, 0.9, "MATCH"),
    ]
    df = spark.createDataFrame([("b", *r[:4]) for r in rows], "broadcast_key string, alignment_name string, latency_seconds double, is_valid boolean, overall_similarity double")
    got = {r.comparison: (r.lag_seconds, r.status) for r in liveness.classify(df).collect()}
    assert [got[s][1] for s, _ in (("hls_cloudfront_lag", 0), ("hls_ais_lag", 0), ("icecast_cloudfront_lag", 0), ("icecast_ais_lag", 0), ("source_lag", 0))] == [r[4] for r in rows]
    odd = spark.createDataFrame([("b", "primary_vs_ti_hls", 1.0, True, 0.9), ("c", "pri_source_vs_bk_source", 2.0, False, 0.9), ("d", "pri_source_vs_ti_hls", 2.0, True, None), ("e", "pri_source_vs_ti_hls", 2.0, True, float("nan"))], df.schema)
    got = {r.broadcast_key: (r.lag_seconds, r.status) for r in liveness.classify(odd).collect()}
    assert got == {"c": (0.0, "NO_ALIGNMENT"), "d": (2.0, None), "e": (2.0, "MATCH")}


def test_metric_rows(spark):
    live = spark.createDataFrame([("g_x_y", "source_lag", -1.2345, "MATCH"), ("plain", "source_lag", 1.0, "MATCH")], "broadcast_key string, comparison string, lag_seconds double, status string")
    b = spark.createDataFrame([("g_x_y", "", 2.5), ("plain", "n", 1.0)], "broadcast_key string, name string, total_s double")
    rows = sorted((r.metric, r.value, tuple(r.tags)) for r in liveness.metric_rows(liveness.pivot(live), b).collect())
    assert rows == [("streaming.benchmark.duration.milliseconds", 2500, ("group:g", "broadcast:x_y")), ("streaming.latency.benchmark.ms", -1234, ("group:g", "broadcast:x_y", "comparison:pri_source_vs_bk_source", "status:MATCH"))]


def test_quality_of_nothing(spark):
    b = spark.createDataFrame([], "broadcast_key string, error string, health_score double")
    s = spark.createDataFrame([], "broadcast_key string, error string, validation struct<is_valid: boolean>, type string")
    a = spark.createDataFrame([], "broadcast_key string, error string, is_valid boolean, is_valid_match boolean")
    r = quality.quality_metrics(b, s, a, a).first()
    assert (r.stream_validity_rate, r.average_health_score, r.health_distribution) == (0.0, 0.0, {"excellent": 0, "good": 0, "fair": 0, "poor": 0})
    assert quality.reliability_metrics(b, s).first().success_rate_by_type == {}


def test_reliability(spark):
    b = spark.createDataFrame([("x", None), ("y", "insufficient streams")], "broadcast_key string, error string")
    s = spark.createDataFrame([("x", None, (True,), "hls"), ("x", None, (False,), "hls"), ("x", "dns", None, "icecast"), ("y", "dns", None, "odd")], "broadcast_key string, error string, validation struct<is_valid: boolean>, type string")
    r = quality.reliability_metrics(b, s).first()
    assert r.success_rate_by_type == {"hls": 0.5, "icecast": 0.0} and r.error_distribution == {"network": 1, "other": 1} and r.retry_rate == 0.0


def streams(spark, rows):
    from lagloom.sources.catalog_files import SCHEMA

    return spark.createDataFrame(rows, SCHEMA)


def test_catalog_inheritance(spark):
    rows = [
        ("g", "G", "news", None, "b", "B", "", None, "s1", "http://x/a.m3u8", None, "source", "", None),
        ("g", "G", "news", None, "b", "B", "", None, "s2", "http://x/stream", "", "cdn", "talk", False),
        ("off", "O", "news", False, "b", "B", "", None, "s1", "u", None, "source", "", None),
    ]
    got = {(r.group_key, r.stream_name): r for r in catalog.inherit(streams(spark, rows)).collect()}
    a, b, c = got["g", "s1"], got["g", "s2"], got["off", "s1"]
    assert (a.group_enabled, a.broadcast_enabled, a.enabled, a.content_type, a.type) == (True, True, True, "news", "hls")
    assert (b.enabled, b.content_type, b.type) == (False, "talk", None)
    assert (c.enabled, c.content_type, c.broadcast_enabled) == (None, "", None)
    # A disabled group fails its check unless its streams say that they are enabled.
    found = {(r.group_key, r.level) for r in catalog.problems(catalog.inherit(streams(spark, rows))).collect()}
    assert ("off", 1) in found and ("g", 1) in found


def test_catalog_problems(spark):
    ok = ("g", "G", "news", True, "b", "B", "", True)
    rows = [(*ok, "s", "u", "hls", "source", "", True), (*ok, "t", "u", "hls", "cdn", "opera", True), (*ok, "v", "", "hls", "cdn", "", True), (*ok, "w", "u", "hls", "relay", "", True), ("h", "", None, True) + (None,) * 10, ("i", "I", None, True, "b", None, None, True) + (None,) * 6]
    got = {(r.group_key, r.stream_name): r.problem for r in catalog.problems(streams(spark, rows)).where("level != 2").collect()}
    assert set(got) == {("g", "t"), ("g", "v"), ("g", "w"), ("h", None), ("i", None)}
    assert got["h", None] == "a group needs a name" and "opera" in got["g", "t"]
    assert catalog.problems(streams(spark, rows)).where("level = 2").first().problem == "a broadcast needs a name"


def test_catalog_lookups(spark):
    rows = [("a", "A", "", True, k, k, "", e, s, "u", "hls", role, "", on) for k, e in (("b1", None), ("b2", True), ("b3", False), ("b0", True)) for s, role, on in (("s", "source", True), ("t", "cdn", None), ("c", "cdn", True))] + [("z", "Z", "", None, "b9", "n", "", True, "s", "u", "hls", "source", "", True)]
    df = streams(spark, rows)
    assert {r.group_key for r in catalog.enabled_groups(df).collect()} == {"a"}
    assert catalog.streams_of(df, "cdn").count() == 3 and catalog.streams_of(df, "source", "icecast").count() == 0
    assert catalog.stream_of(df, "hls", "cdn").select("stream_name").distinct().collect()[0][0] == "c"
    assert catalog.enabled_broadcasts(df).first().n == 2 and catalog.first_group(df).first()[0] == "a"
    assert catalog.groups_with(df, "b9").count() == 0 and catalog.groups_with(df, "b1").count() == 1
    assert {r.broadcast_key for r in catalog.select_broadcast(df, 1).collect()} == {"b2"}
    with pytest.raises(IndexError):
        catalog.select_broadcast(df, 2)


def test_settings():
    s = config.RunSettings.read({"operation_timeout": "340s", "min_alignment_confidence": 0, "unknown": 1})
    f = s.filled()
    assert f.operation_timeout == 340_000_000_000 and f.min_alignment_confidence == 0.4 and f.validate_audio_format and f.output_format == "json"
    assert not config.RunSettings(validate_audio_format=True).filled().validate_hls_structure
    flagged = s.under_flags(timeout=1, detailed=True)
    assert flagged.benchmark_timeout == 1 and flagged.include_raw_data and flagged.max_concurrent_broadcasts == 3
    assert f.problems() == [] and config.RunSettings(min_health_score=2).problems()[-1] == "min_health_score must be between 0 and 1"
    assert config.problems(config.DEFAULTS) == []
    assert config.problems(config.DEFAULTS | {"test.retry_attempts": -1, "icecast.detection.url_patterns": []}) == ["test.retry_attempts must not be negative", "icecast.detection.url_patterns must not be empty"]
    assert config.layered({"test.timeout": 1, "output": "csv"}, {"test.timeout": None})["test.timeout"] == 1
    assert config.layered({"output": "csv"})["output_format"] == "csv"
    assert config.output_format(None, {"benchmark.output_format": "yaml"}) == "yaml" and config.output_format("csv", {}) == "csv"
    assert config.section("quality", "production")["min_bitrate"] == 256 and config.section("audio")["mel_bins"] == 128
    assert config.nest(config.DEFAULTS, "hls.")["http"]["max_redirects"] == 5
    assert config.flatten({"test": {"timeout": "2m"}, "stream": {"headers": {"a": "b"}}}) == {"test.timeout": 120 * config.S, "stream.headers": {"a": "b"}}


def test_validation(spark):
    rows = [("hls", 44100, 2, 10, 90.0), ("icecast", 0, 0, 0, 80.0), ("hls", 1, 1, 1, 95.1), ("hls", None, 1, None, None)]
    df = spark.createDataFrame(rows, "t string, r int, c int, n int, d double")
    got = [r.v for r in df.coalesce(1).select(validate.stream_validation(*[F.col(c) for c in "trcnd"], 90.0).alias("v")).collect()]
    assert got[0].is_valid and got[0].errors == [] and got[0].playlist_structure and not got[0].http_headers
    assert not got[1].is_valid and len(got[1].errors) == 4 and got[1].http_headers
    assert got[2].is_valid and got[2].errors == ["unexpected audio duration: got 95.1s, expected 90.0s"]
    assert got[3].errors[:2] == ["invalid sample rate", "no audio data"]


def test_segments(spark):
    rows = [("p", i, f"u{i}", float(i), t, False) for i, t in enumerate(["CATEGORY:a,AD_BREAK", "CATEGORY:a", "CATEGORY:,x", None, "AD_BREAK"])]
    df = spark.createDataFrame(rows, "playlist_url string, pos int, uri string, duration double, title string, discontinuity boolean")
    r = segments.segment_summary(df, 4).first()
    assert (r.segments, r.total_duration, r.average_duration, r.ad_breaks, r.categories) == (4, 6.0, 1.5, 1, {"a": 2, "": 1})
    assert segments.last_segment(df).first().uri == "u4"


def test_timers(spark):
    df = spark.createDataFrame([("a_b", 1.0), ("c", 3.0)], "event string, seconds double")
    assert {r.title: r.percent for r in timers.shares(df, 8.0).collect()} == {"A B": 12.5, "C": 37.5}
    assert timers.response_seconds(df, ["a_b", "c"]).first()[0] == 4.0


def test_large_series(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rnd.normal(size=3000)] + [("b", float(x)) for x in rnd.integers(0, 4, 2001)] + [(None, float(x)) for x in rnd.exponential(size=1000)] + [("small", 1.0), ("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(3)
    key = lambda r: str(r.k)
    want = sorted(stats.stats_by(df, ["k"], "value").collect(), key=key)
    monkeypatch.setattr(stats, "LARGE", 500)
    monkeypatch.setattr(stats, "CELLS", 20)
    got = sorted(stats.stats_by(df, ["k"], "value").collect(), key=key)
    assert [r.k for r in got] == [r.k for r in want] and all(np.allclose(g[1:], w[1:], atol=1e-12) for g, w in zip(got, want, strict=True))


def test_deadlines_stop_a_run(spark):
    rows = spark.createDataFrame([("k", 5, None), ("k", 11, None), ("k", 12, "dns failure")], "broadcast_key string, total_ns long, error string")
    assert [r.error for r in pairing.within_deadline(rows, F.col("total_ns"), 10, "it").collect()] == [None, "timeout: it took over 1e-08s", "dns failure"]
    assert pairing.within_deadline(rows, F.col("total_ns"), 0, "it") is rows


def test_planted_lags():
    rng = np.random.default_rng(0)
    for n, lag in ((500, 17), (500, -40), (3000, 1000), (64, 0)):
        x = rng.normal(size=n + abs(lag))
        a, b = (x[lag:], x[:n]) if lag >= 0 else (x[:n], x[-lag:])
        got, sure = alignment.correlate(a[:n], b, 2000)
        assert got == lag and sure > 0.99
    assert alignment.correlate(np.zeros(50), np.ones(50), 10)[1] == 0.0


def test_alignment_and_fingerprints(spark):
    rng = np.random.default_rng(3)
    rate = 8000
    x = np.repeat(rng.normal(size=1200), 100)[: 12 * rate] * np.sin(np.arange(12 * rate) / 5)
    noise = rng.normal(size=12 * rate)
    a, b = x[: 10 * rate], np.r_[rng.normal(size=rate // 2) * 0.01, x][: 10 * rate]
    pairs = spark.createDataFrame([("k", "late", a.tolist(), b.tolist(), rate), ("k", "noise", a.tolist(), noise[: 10 * rate].tolist(), rate), ("k", "none", a.tolist(), None, rate)], "broadcast_key string, alignment_name string, pcm1 array<double>, pcm2 array<double>, sample_rate int")
    got = {r.alignment_name: r for r in alignment.align(pairs, 3.0).collect()}
    assert abs(got["late"].temporal_offset - 0.5) < 0.002 and got["late"].is_valid
    assert not got["noise"].is_valid and got["noise"].latency_seconds == 0.0 and not got["none"].is_valid
    s = spark.createDataFrame([("k", n, p.tolist(), rate) for n, p in (("a", a), ("b", b), ("n", noise))] + [("k", "e", [], rate)], "broadcast_key string, stream_name string, pcm array<double>, sample_rate int")
    prints = {r.stream_name: r.fingerprint for r in alignment.fingerprints(s).collect()}
    likeness = lambda p, q: np.dot(prints[p], prints[q]) / np.linalg.norm(prints[p]) / np.linalg.norm(prints[q])
    assert likeness("a", "b") > 0.95 > likeness("a", "n") and prints["e"] is None


def test_rows_at_once_are_what_single_rows_are():
    """Lags, fine searches and fingerprints of many rows of several lengths, nulls and empty ones among them."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    rows = [None if n is None else rng.normal(size=n) for n in (300, 1500, 0, None, 300, 1500, 7, 300)]
    column = alignment.as_lists(rows)
    assert column.to_pylist() == [None if r is None else r.tolist() for r in rows]
    both = alignment.Lists(column)
    assert both.lengths.tolist() == [300, 1500, 0, 0, 300, 1500, 7, 300]
    groups = list(alignment.alike(both.lengths, values=both.lengths))
    assert sorted(i for own in groups for i in own) == list(range(8)) and all(len(set(both.lengths[own])) == 1 for own in groups)
    made = alignment.envelope_column(column.slice(1), 16).to_pylist()
    assert made == [alignment.envelope(r if r is not None else np.zeros(0), 16).tolist() for r in rows[1:]]
    a = rng.normal(size=(6, 90))
    b = np.stack([np.roll(x, s) for x, s in zip(a, (0, 3, -5, 8, 1, -1), strict=True)])[:, :70]
    lags, sure = alignment.correlate_rows(a, b, 9, -6)
    for i in range(6):
        fits = {}
        x, y = a[i] - a[i].mean(), b[i] - b[i].mean()
        for lag in range(-6, 10):
            at = [t for t in range(90) if 0 <= t + lag < 70]
            p, q = x[at], y[[t + lag for t in at]]
            fits[lag] = p @ q / np.sqrt((p @ p) * (q @ q))
        best = max(fits, key=fits.get)
        assert lags[i] == best and sure[i] == pytest.approx(fits[best])
        assert alignment.correlate(a[i], b[i], 9, -6) == (best, pytest.approx(sure[i]))
    sound = rng.normal(size=(5, 2500))
    for on in ((True, False, False), (False, True, True)):
        assert alignment.features(sound, 1024, *on) == pytest.approx(np.stack([alignment.features(x, 1024, *on) for x in sound]))


def test_pieces_of_many_pairs_are_searched_at_once(spark, monkeypatch):
    """A batch of pairs of one shape is one search, not one for each pair."""
    import pyarrow as pa

    calls = []
    rows = alignment.correlate_rows
    monkeypatch.setattr(alignment, "correlate_rows", lambda *x: calls.append(len(x[0])) or rows(*x))
    x = np.random.default_rng(3).normal(size=(40, 400))
    p, q = (alignment.Lists(alignment.as_lists(list(v))) for v in (x, np.roll(x, 5, axis=1)))
    whole = lambda n: np.full(40, n)
    offsets, sure = alignment.fine_lags(p, q, whole(0), np.zeros(40), whole(0), whole(25), whole(100), 1.0, 16)
    assert calls == [40] and set(offsets) == {0.05} and (sure > 0.9).all()
