"""M3U8 playlists from text files: playlists, segments and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    """(playlist_url, content) of the files of a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("playlist_url"), F.col("value").alias("content"))


def _tag(content: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(content, rf"(?m)^#EXT-X-{name}:([^\r\n]*)", 1), F.lit(""))


def playlists(raw: DataFrame) -> DataFrame:
    """playlist_url, is_valid, is_master, is_live, version, target_duration, media_sequence.

    A playlist is valid if it begins with #EXTM3U. It is live if it has segments and no end mark. The version is 1 if not told.
    """
    c = F.col("content")
    master = c.rlike(r"(?m)^#EXT-X-STREAM-INF")
    return raw.select(
        "playlist_url",
        c.rlike(r"^﻿?#EXTM3U").alias("is_valid"),
        master.alias("is_master"),
        (~master & ~c.rlike(r"(?m)^#EXT-X-ENDLIST")).alias("is_live"),
        F.coalesce(_tag(c, "VERSION").try_cast("int"), F.lit(1)).alias("version"),
        _tag(c, "TARGETDURATION").try_cast("double").alias("target_duration"),
        F.coalesce(_tag(c, "MEDIA-SEQUENCE").try_cast("long"), F.lit(0)).alias("media_sequence"),
    )


def _lines(raw: DataFrame) -> DataFrame:
    """Lines with those that are no comment numbered: a segment or variant is what leads up to its address."""
    lines = raw.select("playlist_url", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line")).where("trim(line) != ''")
    is_uri = ~F.startswith("line", F.lit("#"))
    before = Window.partitionBy("playlist_url").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("uri", F.when(is_uri, F.col("line"))).withColumn("pos", F.coalesce(F.count("uri").over(before), F.lit(0)).cast("int"))


def _of(pattern: str) -> Column:
    """The last line of a group that begins with a pattern."""
    return F.max_by(F.when(F.col("line").rlike(pattern), F.col("line")), F.when(F.col("line").rlike(pattern), F.col("at")))


def segments(raw: DataFrame) -> DataFrame:
    """playlist_url, pos, uri, duration, title, discontinuity."""
    found = _lines(raw).groupBy("playlist_url", "pos").agg(F.max("uri").alias("uri"), _of("^#EXTINF:").alias("inf"), F.bool_or(F.col("line").rlike("^#EXT-X-DISCONTINUITY\\s*$")).alias("discontinuity"))
    return found.where("uri is not null and inf is not null").select(
        "playlist_url", "pos", "uri", F.coalesce(F.regexp_extract("inf", r"^#EXTINF:\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.0)).alias("duration"), F.regexp_extract("inf", r"^#EXTINF:[^,]*,(.*)$", 1).alias("title"), "discontinuity"
    )


def variants(raw: DataFrame) -> DataFrame:
    """playlist_url, pos, uri, bandwidth, codecs, resolution."""
    found = _lines(raw).groupBy("playlist_url", "pos").agg(F.max("uri").alias("uri"), _of("^#EXT-X-STREAM-INF:").alias("inf"))
    part = lambda p: F.nullif(F.regexp_extract("inf", p, 1), F.lit(""))
    return found.where("uri is not null and inf is not null").select(
        "playlist_url", "pos", "uri", part(r"(?:^#EXT-X-STREAM-INF:|,)BANDWIDTH=(\d+)").try_cast("long").alias("bandwidth"), part(r'CODECS="([^"]*)"').alias("codecs"), part(r"RESOLUTION=(\d+x\d+)").alias("resolution")
    )
