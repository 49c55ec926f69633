"""Byte captures made from the benchmark tables: events as titles in sound, parts as segments of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.plans.queries import query, table
from lagloom.sources import byte_captures

EVERY, CHUNK = 64, 100


def _chunks(spark, sf_dir):
    """A stream for each user: 64 bytes of sound, then what comes with an event, nothing for a view; in chunks of 100 bytes."""
    said = F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("StreamTitle='"), F.col("event_type"), F.lit("'s "), F.col("event_id").cast("string"), F.lit("';StreamUrl='';")))
    blocks = F.ceil(F.length("said") / 16).cast("int")
    text = F.concat(F.repeat(F.lit("a"), F.lit(EVERY)), F.char(blocks), F.col("said"), F.repeat(F.char(F.lit(0)), blocks * 16 - F.length("said")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("text")))), lambda s: s["text"]), "")
    made = table(spark, sf_dir, "events").withColumn("said", said).groupBy("user_id").agg(whole.alias("whole"))
    cut = made.select(F.col("user_id").alias("stream"), "whole", F.explode(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / CHUNK).cast("int"))).alias("chunk"))
    return cut.select("stream", "chunk", F.lit(EVERY).alias("every"), F.substring("whole", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).cast("binary").alias("data"))


@query(f"""SELECT CAST(user_id AS VARCHAR) AS stream, n * {EVERY} AS at, event_type || '''s ' || event_id AS title FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE event_type <> 'view'""")
def icy_titles(spark, sf_dir):
    return byte_captures.icy_titles(byte_captures.icy_parts(_chunks(spark, sf_dir))).drop("url")


@query(f"SELECT CAST(user_id AS VARCHAR) AS stream, count(*) * {EVERY} AS bytes, repeat('a', {EVERY}) AS first FROM events GROUP BY user_id")
def icy_sound(spark, sf_dir):
    sound = byte_captures.icy_parts(_chunks(spark, sf_dir)).where("kind = 'sound'")
    return sound.groupBy("stream").agg(F.sum(F.length("data")).alias("bytes"), F.min(F.when(F.col("at") == 0, F.col("data").cast("string"))).alias("first"))


@query("""SELECT p_partkey, 'aac' AS codec, CAST(rate AS INTEGER) AS sample_rate, CAST(1 + p_partkey % 2 AS INTEGER) AS channels, p_size::BIGINT AS frames, round(8 * p_size * (7 + p_partkey % 200) / (p_size * 1024 / rate::DOUBLE), 3) AS bitrate, round(p_size * 1024 / rate::DOUBLE, 9) AS duration_s, (p_partkey % 5)::BIGINT AS other_bytes
 FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 32000 END AS rate FROM part)""")
def segment_frames(spark, sf_dir):
    """A part is a segment of p_size frames, behind some bytes that are none."""
    key = F.col("p_partkey")
    size = (7 + key % 200).cast("int")
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    rate, channels = (3 + key % 3).cast("int"), (1 + key % 2).cast("int")
    header = F.concat(F.lit("FFF1"), byte(rate * 4 + 64), byte(channels * 64), byte(F.floor(size / 8)), byte(size % 8 * 32 + 31), F.lit("FC"))
    frame = F.concat(header, F.repeat(F.lit("00"), size - 7))
    content = F.unhex(F.concat(F.repeat(F.lit("01"), (key % 5).cast("int")), F.repeat(frame, F.col("p_size"))))
    found = byte_captures.frames(table(spark, sf_dir, "part").select("p_partkey", content.alias("content")), "p_partkey")
    return found.withColumns({"bitrate": F.round("bitrate", 3), "duration_s": F.round("duration_s", 9)})
