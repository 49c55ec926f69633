"""Rules on small tables: what each finds, and what missing values do."""

import pytest

from lagloom.operators import rules

PLAYLISTS = [
    ("fine", "#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:10\n#EXTINF:9.5,a\na.ts\n#EXTINF:10.4,b\nb.ts\n#EXT-X-ENDLIST\n"),
    ("long", "#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:10\n#EXTINF:10.6,a\na.ts\n#EXT-X-ENDLIST\n"),
    ("empty", "#EXTM3U\n#EXT-X-TARGETDURATION:10\n#EXT-X-ENDLIST\n"),
    ("master", "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1000\nv.m3u8\n"),
    ("junk", "<html>"),
    ("live", "#EXTM3U\n#EXT-X-VERSION:2\n#EXT-X-TARGETDURATION:4\n#EXTINF:4,\na.ts\n#EXT-X-DISCONTINUITY\n#EXTINF:0,\na.ts\n#EXTINF:3.5,\nb.ts\n"),
]


def test_playlists(spark):
    rows = rules.playlist_rows(spark.createDataFrame(PLAYLISTS, "playlist_url string, content string"))
    found = rules.violations(rows, ["playlist_url"], rules.PLAYLIST_RULES)
    got = {(r.playlist_url, r.rule): r.found for r in found.collect()}
    assert got == {
        ("long", "over_target_duration"): 1, ("empty", "no_segments"): 0, ("junk", "no_header"): 0, ("junk", "no_segments"): 0, ("junk", "no_target_duration"): 0,
        ("live", "no_duration"): 1, ("live", "repeated_segment"): 1, ("live", "fractions_before_version_3"): 1, ("live", "short_window"): 7.5, ("live", "discontinuities"): 1,
    }
    said = {r.playlist_url: (r.is_valid, r.health) for r in rules.verdicts(rows, found, ["playlist_url"]).collect()}
    assert said == {"fine": (True, 100), "long": (False, 60), "empty": (False, 60), "master": (True, 100), "junk": (False, 0), "live": (True, 40)}


def test_sound_and_streams_with_nulls(spark):
    nan = float("nan")
    sound = [("a", [0.5, None, nan], 100, "x"), ("b", None, None, "x"), ("c", [], 100, None), ("d", [0.0] * 9, 100, None), ("e", [1.0] * 9, 100, None), ("f", [0.5], 100, None), ("f", [0.0], 200, None), ("f", [0.0], 100, None)]
    rows = rules.sound_rows(spark.createDataFrame(sound, "stream string, pcm array<double>, sample_rate int, samples string"))
    got = {(r.stream, r.rule): r.found for r in rules.violations(rows, ["stream"], rules.SOUND_RULES).collect()}
    assert got == {("a", "not_finite"): 2, ("b", "no_samples"): 0, ("b", "no_rate"): 0, ("c", "no_samples"): 0, ("d", "silent"): 0, ("e", "clipped"): 9, ("f", "rate_changes"): 100, ("f", "often_silent"): 2}
    polls = spark.createDataFrame([("n",) + (None,) * 8], "stream string, content_type string, bytes_received long, sample_rate int, channels int, bitrate int, connection_ms long, buffer_health double, title string")
    assert {r.rule for r in rules.violations(polls, ["stream"], rules.STREAM_RULES).collect()} == {"no_content_type", "no_bytes", "no_title"}
    assert rules.violations(polls.limit(0), ["stream"], rules.STREAM_RULES).count() == 0
    assert rules.violations(polls, ["stream"], []).columns == ["stream", "rule", "severity", "found"]


def test_rules_as_rows(spark):
    own = rules.from_rows([{"name": "many", "severity": "info", "broken": "count(*) > 1", "found": "count(*)"}, {"name": "big", "severity": "error", "broken": "max(x) > 5"}])
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "k int, x int")
    assert sorted(tuple(r) for r in rules.violations(df, ["k"], own).collect()) == [(1, "many", "info", 2.0), (2, "big", "error", 0.0)]
    for wrong in ([{"name": "a", "severity": "bad", "broken": "true"}], [{"name": "a", "severity": "info", "broken": "true"}] * 2):
        with pytest.raises(ValueError, match="no severity|one name"):
            rules.from_rows(wrong)


def test_one_shuffle_for_all_rules(spark):
    df = spark.range(100).selectExpr("id % 7 AS stream", "'a' AS content_type", "id AS bytes_received", "1 AS sample_rate", "1 AS channels", "100 AS bitrate", "id AS connection_ms", "0.5D AS buffer_health", "'t' AS title")
    plan = rules.violations(df, ["stream"], rules.STREAM_RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
