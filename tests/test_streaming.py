"""Streams against their batch twins on the same rows."""

from pyspark.sql import functions as F

from lagloom.streaming.changes import changed_playlists, changed_titles, lag_windows

SF = "/root/testdata/sf0.001/events.parquet"


def test_changes(spark):
    rows = [("s", 1, None, 5), ("s", 2, "a", 5), ("s", 3, "", 6), ("s", 4, "a", None), ("s", 5, "b", 6), ("t", 1, "a", -1)]
    df = spark.createDataFrame(rows, "stream string, ts long, title string, media_sequence long")
    assert sorted((r.stream, r.ts) for r in changed_titles(df).collect()) == [("s", 2), ("s", 5), ("t", 1)]
    assert sorted((r.stream, r.ts) for r in changed_playlists(df).collect()) == [("s", 1), ("s", 3), ("t", 1)]


def test_windows(spark, tmp_path):
    rows = spark.read.parquet(SF).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("comparison"), F.col("value").alias("lag_seconds"), F.lit("MATCH").alias("status"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = lag_windows(stream, "1 day", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted(map(str, spark.table("windows").select("window", "comparison", "n").collect())) == sorted(map(str, lag_windows(rows, "1 day").select("window", "comparison", "n").collect()))
