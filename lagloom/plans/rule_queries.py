"""Rules of protocols over the benchmark tables: events as segments and polls, vectors as sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.operators import rules
from lagloom.plans.queries import query, table


def _told(by: str, source: str, conditions: list[tuple[str, str, str, str]]) -> str:
    """SQL: of each rule (name, severity, condition, number) the subjects that break it."""
    return " UNION ALL ".join(f"SELECT {by}, '{name}' AS rule, '{severity}' AS severity, CAST({found} AS DOUBLE) AS found FROM {source} WHERE {condition}" for name, severity, condition, found in conditions)


# A user's events are the segments of a playlist. Some playlists lack their header or target duration.
_SEGMENTS = """s AS (SELECT user_id, event_id, (event_id % 700) / 10.0::DOUBLE AS d, event_type = 'error' AS cut, event_id % 3000 AS uri, 2 + user_id % 3 AS version, user_id % 2 = 0 AS live,
 CASE WHEN user_id % 19 <> 4 THEN CASE WHEN user_id % 13 = 6 THEN 5000 ELSE 66 END END AS target FROM events), p AS (SELECT user_id, bool_or(user_id % 17 = 3) AS bare, max(version) AS version, bool_or(live) AS live, max(target) AS target, sum(d) AS whole, count(*) AS n, count(DISTINCT uri) AS uris,
 count_if(round(d) > target) AS over, count_if(d <= 0) AS none, count_if(d <> floor(d)) AS parts, count_if(cut) AS cuts FROM s GROUP BY user_id)"""
_PLAYLIST_SQL = _told("user_id", "p", [
    ("no_header", "error", "bare", "0"), ("no_target_duration", "error", "target IS NULL", "0"), ("over_target_duration", "error", "over > 0", "over"), ("no_duration", "warning", "none > 0", "none"),
    ("repeated_segment", "warning", "uris < n", "n - uris"), ("fractions_before_version_3", "warning", "version < 3 AND parts > 0", "parts"), ("short_window", "warning", "live AND round(whole, 6) < 3 * target", "round(whole, 6)"), ("discontinuities", "info", "cuts > 0", "cuts"),
])


def _playlists(spark, sf_dir):
    """(playlist_url, content): the text of each user's playlist."""
    user = F.col("user_id")
    tenths = F.col("event_id") % 700
    lines = F.concat(
        F.when(F.col("event_type") == "error", "#EXT-X-DISCONTINUITY\n").otherwise(""), F.lit("#EXTINF:"), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"),
        F.lit(","), F.col("event_type"), F.lit("\n"), (F.col("event_id") % 3000).cast("string"), F.lit(".aac\n"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", lines.alias("text")))), lambda s: s["text"]), "")
    made = table(spark, sf_dir, "events").groupBy("user_id").agg(body.alias("body"))
    head = F.concat(F.when(user % 17 == 3, "#A\n").otherwise("#EXTM3U\n"), F.lit("#EXT-X-VERSION:"), (2 + user % 3).cast("string"), F.when(user % 19 == 4, "\n").when(user % 13 == 6, "\n#EXT-X-TARGETDURATION:5000\n").otherwise("\n#EXT-X-TARGETDURATION:66\n"))
    return made.select(user.alias("playlist_url"), F.concat(head, "body", F.when(user % 2 == 0, "").otherwise("#EXT-X-ENDLIST\n")).alias("content"))


@query(f"WITH {_SEGMENTS} {_PLAYLIST_SQL}")
def playlist_rules(spark, sf_dir):
    found = rules.violations(rules.playlist_rows(_playlists(spark, sf_dir)), ["playlist_url"], rules.PLAYLIST_RULES)
    return found.select(F.col("playlist_url").alias("user_id"), "rule", "severity", F.round("found", 6).alias("found"))


@query(f"""WITH {_SEGMENTS}, v AS ({_PLAYLIST_SQL}), c AS (SELECT user_id, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings FROM v GROUP BY user_id)
 SELECT p.user_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS is_valid, CAST(greatest(0, 100 - 40 * coalesce(errors, 0) - 15 * coalesce(warnings, 0)) AS INTEGER) AS health FROM p LEFT JOIN c ON c.user_id = p.user_id""")
def playlist_verdicts(spark, sf_dir):
    rows = rules.playlist_rows(_playlists(spark, sf_dir))
    found = rules.violations(rows, ["playlist_url"], rules.PLAYLIST_RULES)
    return rules.verdicts(rows, found, ["playlist_url"]).withColumnRenamed("playlist_url", "user_id")


# A user's events are polls of a stream.
_POLLS = """e AS (SELECT user_id, CASE WHEN user_id % 23 <> 5 AND event_type <> 'error' THEN 'audio/aac' END AS content_type, CASE WHEN user_id % 29 <> 7 THEN event_id ELSE 0 END AS bytes_received, CASE WHEN event_id % 900 = 0 THEN 48000 ELSE 44100 END AS sample_rate,
 event_id % 530 AS bitrate, event_id % 5003 AS connection_ms, event_id % 1000 / 1000.0::DOUBLE AS buffer_health, CASE WHEN user_id % 31 <> 9 THEN event_type END AS title FROM events),
 p AS (SELECT user_id, count(content_type) AS types, max(bytes_received) AS bytes, max(sample_rate) - min(sample_rate) AS rates, count_if(bitrate < 16 OR bitrate > 512) AS off, max(connection_ms) AS slow, count_if(buffer_health < 0.3) AS low, count(title) AS titles FROM e GROUP BY user_id)"""


@query(f"WITH {_POLLS} " + _told("user_id", "p", [
    ("no_content_type", "error", "types = 0", "0"), ("no_bytes", "error", "bytes <= 0", "0"), ("sample_rate_changes", "error", "rates > 0", "rates"), ("bitrate_out_of_band", "warning", "off > 0", "off"),
    ("slow_connection", "warning", "slow > 5000", "slow"), ("low_buffer", "warning", "low > 0", "low"), ("no_title", "info", "titles = 0", "0"),
]))
def stream_rules(spark, sf_dir):
    e, user, n = table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id")
    polls = e.select(
        "user_id", F.when((user % 23 != 5) & (F.col("event_type") != "error"), "audio/aac").alias("content_type"), F.when(user % 29 != 7, n).otherwise(0).alias("bytes_received"), F.when(n % 900 == 0, 48000).otherwise(44100).alias("sample_rate"), F.lit(2).alias("channels"),
        (n % 530).alias("bitrate"), (n % 5003).alias("connection_ms"), (n % 1000 / 1000).alias("buffer_health"), F.when(user % 31 != 9, F.col("event_type")).alias("title"),
    )
    return rules.violations(polls, ["user_id"], rules.STREAM_RULES)


# Each forty vectors are the blocks of a stream; some blocks are silent, missing or not numbers.
_SOUND = """b AS (SELECT vec_id // 40 AS stream, CASE WHEN vec_id // 40 % 9 = 2 OR vec_id % 40 > 15 + vec_id // 40 % 13 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) WHEN vec_id // 40 % 11 = 4 THEN [] ELSE list_transform(embedding, lambda x: x::DOUBLE * 5) END AS pcm,
 CASE WHEN vec_id % 97 = 5 THEN 1 ELSE 0 END AS odd, CASE WHEN vec_id % 311 = 6 THEN 8000 ELSE 16000 END AS rate FROM embeddings),
 k AS (SELECT stream, rate, odd, len(pcm) + odd AS samples, len(list_filter(pcm, lambda x: abs(x) >= 0.999)) AS clipped, len(list_filter(pcm, lambda x: abs(x) > 0.001)) = 0 AS silent FROM b),
 p AS (SELECT stream, sum(samples) AS samples, sum(odd) AS odd, bool_and(silent) AS silent, count_if(silent) AS quiet, count(*) AS n, max(rate) - min(rate) AS rates, sum(clipped) AS clipped FROM k GROUP BY stream)"""


@query(f"WITH {_SOUND} " + _told("stream", "p", [
    ("no_samples", "error", "samples = 0", "0"), ("not_finite", "error", "odd > 0", "odd"), ("silent", "error", "samples > 0 AND silent", "0"), ("rate_changes", "error", "rates > 0", "rates"),
    ("often_silent", "warning", "NOT silent AND 2 * quiet > n", "quiet"), ("clipped", "warning", "100 * clipped > samples", "clipped"),
]))
def sound_rules(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    stream = F.floor(F.col("vec_id") / 40)
    loud = F.transform("embedding", lambda x: x.cast("double") * 5)
    pcm = F.when((stream % 9 == 2) | (F.col("vec_id") % 40 > 15 + stream % 13), F.transform("embedding", lambda x: F.lit(0.0))).when(stream % 11 == 4, F.array().cast("array<double>")).otherwise(loud)
    odd = F.when(F.col("vec_id") % 97 == 5, F.array(F.lit(float("nan")))).otherwise(F.array().cast("array<double>"))
    blocks = v.select(stream.alias("stream"), F.concat(pcm, odd).alias("pcm"), F.when(F.col("vec_id") % 311 == 6, 8000).otherwise(16000).alias("sample_rate"))
    return rules.violations(rules.sound_rows(blocks), ["stream"], rules.SOUND_RULES)
