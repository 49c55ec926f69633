"""Scalar functions against hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from lagloom.functions import audio, durations, numbers, text, urls


def one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_error_classes(spark):
    cases = {
        None: "none", "failed to load audio: connection refused": "network", "failed to load audio: bad frame": "format", "status 404": "http", "fingerprint empty": "processing",
        "invalid role": "configuration", "Timeout": "other", "insufficient valid streams (1) for alignment": "processing", "": "other",
    }
    assert one(spark, "m string", [(m,) for m in cases], text.error_class(F.col("m"))) == list(cases.values())


def test_names(spark):
    assert one(spark, "k string", [("a_b_c",), ("ab",), ("_x",), (None,)], text.split_key(F.col("k"))) == [("a", "b_c"), None, ("", "x"), None]
    assert one(spark, "t string", [("x CATEGORY:news,b",), ("CATEGORY:",), ("CATEGORY:a b",), ("none",), (None,)], text.category(F.col("t"))) == ["news", "", "a b", None, None]
    assert one(spark, "t string", [("A - B - C",), ("B",)], text.icy_title(F.col("t"))) == [("A", "B - C"), (None, "B")]
    assert one(spark, "t string", [("MUSIC",), ("x",), (None,)], text.content_type(F.col("t"))) == ["music", "news", "news"]
    assert one(spark, "t string", [("stream_detection",)], text.event_title(F.col("t"))) == ["Stream Detection"]
    headers = [({"server": "a", "x-foo": "b", "x-acme-playlist-available-duration": "9"},)]
    assert one(spark, "h map<string,string>", headers, text.shown_headers(F.col("h"))) == [{"server": "a"}]
    assert len(one(spark, "h map<string,string>", headers, text.shown_headers(F.col("h"), service="acme"))[0]) == 2


def test_rounding(spark):
    cases = [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.49999999999999994, 0, 0.0), (1.2345, 3, 1.235), (-0.0004, 3, 0.0), (1e300, 3, 1e300)]
    for x, places, want in cases:
        assert one(spark, "x double", [(x,)], numbers.round_places(F.col("x"), places)) == [pytest.approx(want, rel=1e-15)]
    assert math.isnan(one(spark, "x double", [(float("nan"),)], numbers.round_places(F.col("x"), 3))[0])


def test_nan_never_passes(spark):
    nan = [(float("nan"),)]
    assert one(spark, "x double", nan, numbers.at_least(F.col("x"), 0.4)) == [False]
    assert one(spark, "x double", nan, numbers.health_band(F.col("x"))) == ["poor"]
    assert one(spark, "x double", nan, numbers.buffer_band(F.col("x"))) == ["Poor"]
    assert one(spark, "x double", nan, numbers.finite(F.col("x"))) == [0.0]
    assert one(spark, "p array<double>", [([float("nan"), 0.0001],), ([0.5],), ([],)], audio.is_silent(F.col("p"))) == [True, False, True]


def test_bands(spark):
    xs = [(0.9,), (0.8999,), (0.7,), (0.5,), (0.1,)]
    assert one(spark, "x double", xs, numbers.health_band(F.col("x"))) == ["excellent", "good", "good", "fair", "poor"]
    assert one(spark, "x double", [(0.8,), (0.81,), (0.5,)], numbers.buffer_band(F.col("x"))) == ["Good", "Excellent", "Poor"]
    rows = [(320, 48000, "flac", True), (96, 22050, "mp3", False), (95, 22049, "wav", False), (192, 44100, "opus", True)]
    assert one(spark, "b int, r int, c string, a boolean", rows, numbers.quality_score(F.col("b"), F.col("r"), F.col("c"), F.col("a"))) == [100.0, 65.0, 50.0, 95.0]


def test_units(spark):
    assert one(spark, "x double", [(1.9999,), (-1.9999,)], numbers.seconds_to_ms(F.col("x"))) == [1999, -1999]
    assert one(spark, "x long", [(1_999_999,), (2_000_000,)], numbers.ns_to_ms(F.col("x"))) == [1, 2]
    assert one(spark, "x long", [(128_999,)], numbers.kbps(F.col("x"))) == [128]
    assert one(spark, "a long, b long", [(1, 0), (1, 4)], numbers.ratio(F.col("a"), F.col("b"))) == [0.0, 0.25]


def test_samples(spark):
    assert one(spark, "p array<double>", [([1.0, -2.0],), ([],)], audio.mean_square(F.col("p"))) == [2.5, 0.0]
    assert one(spark, "p array<double>", [([2.0, -2.0, 0.5, float("nan")],)], audio.pcm16(F.col("p"))) == [[32767, -32767, 16383, 0]]
    assert one(spark, "p array<double>", [([1.0] * 10,)], F.size(audio.first_seconds(F.col("p"), 1.5, F.lit(4)))) == [6]
    assert one(spark, "p array<double>", [([1.0] * 10,)], audio.duration(F.col("p"), F.lit(4), True)) == [2.0]
    cut = one(spark, "a array<double>, b array<double>", [([1.0, 2.0, 3.0], [9.0, 1.0, 2.0, 3.0])], audio.overlap(F.col("a"), F.col("b"), F.lit(1)))[0]
    assert cut.a == cut.b == [1.0, 2.0, 3.0]


def test_urls(spark):
    kinds = {"http://x/a.m3u8?k=1": "hls", "http://x/master.m3u8/y": "hls", "http://x:8000/live": "icecast", "http://x/LISTEN": "icecast", "http://x/other": None}
    assert one(spark, "u string", [(u,) for u in kinds], urls.stream_type(F.col("u"))) == list(kinds.values())
    assert one(spark, "c string", [("Audio/MPEG; charset=x",), ("application/x-mpegurl",), ("text/html",)], urls.stream_type_of_content(F.col("c"))) == ["icecast", "hls", None]
    assert one(spark, "u string", [("file:///a",), ("./a",), ("https://a",)], urls.is_local(F.col("u"))) == [True, True, False]
    assert one(spark, "u string", [("http://u:p@h.com:80/a/b?c=d",), ("nothing at all",)], urls.file_name(F.col("u")))[0] == "h.com_80_a_b"
    assert one(spark, "u string", [("http://aaaaaaaaaa",), ("short",)], urls.truncated(F.col("u"), 10)) == ["http://...", "short"]


def test_bypass(spark):
    rules = [urls.BypassRule(["cast.example"], [], {"premium": "true", "p": "a b"}), urls.BypassRule(["cast.example"], ["/live"], {"p": "second"})]
    cases = {
        "http://cast.example:80/x?z=1&a=%7E*&z=0": "http://cast.example:80/x?a=~%2A&p=a+b&premium=true&z=1&z=0",
        "http://cast.example/live": "http://cast.example/live?p=second&premium=true",
        "http://other.example/live?b=2&a=1": "http://other.example/live?b=2&a=1",
        "http://cast.example/x?premium=no#frag": "http://cast.example/x?p=a+b&premium=true#frag",
    }
    assert one(spark, "u string", [(u,) for u in cases], urls.with_bypass(F.col("u"), rules)) == list(cases.values())
    assert one(spark, "u string", [("http://a?b",), ("http://a",)], urls.with_suffix(F.col("u"), "x=1")) == ["http://a?b&x=1", "http://a?x=1"]


def test_durations():
    assert durations.nanoseconds("1h2m3.5s") == 3_723_500_000_000
    assert durations.nanoseconds("-1.5ms") == -1_500_000 and durations.nanoseconds("0") == 0 and durations.nanoseconds(5) == 5
    for bad in ("", "5", "1x", "s", "1s 2s"):
        with pytest.raises(ValueError):
            durations.nanoseconds(bad)
