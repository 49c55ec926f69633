"""Playlists: what their segments and variants add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.numbers import kbps, ratio
from lagloom.functions.text import category, has_ad_break


def first_segments(segments: DataFrame, n: int, key: str = "playlist_url", order: str = "pos") -> DataFrame:
    """The first n segments of every playlist."""
    w = Window.partitionBy(key).orderBy(order)
    return segments.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def last_segment(segments: DataFrame, key: str = "playlist_url", order: str = "pos") -> DataFrame:
    rest = [c for c in segments.columns if c != key]
    return segments.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def segment_summary(segments: DataFrame, n: int = 10, key: str = "playlist_url") -> DataFrame:
    """Over the first n segments of each playlist: number, total and mean duration, ad breaks, segments by category."""
    first = first_segments(segments, n, key).withColumn("category", category(F.col("title")))
    by = first.groupBy(key, "category").agg(F.count("*").alias("n"), F.sum("duration").alias("d"), F.count_if(has_ad_break(F.col("title"))).alias("ads"))
    counted = F.filter(F.array_sort(F.collect_list(F.struct("category", F.col("n").alias("c")))), lambda x: x["category"].isNotNull())
    return by.groupBy(key).agg(
        F.sum("n").alias("segments"),
        F.sum("d").alias("total_duration"),
        ratio(F.sum("d"), F.sum("n")).alias("average_duration"),
        F.sum("ads").alias("ad_breaks"),
        F.map_from_entries(counted).alias("categories"),
    )


def playlist_analysis(playlists: DataFrame, segments: DataFrame, variants: DataFrame) -> DataFrame:
    """A row for each playlist: segment durations, ads, discontinuities, categories, and the spread of variants."""
    key = "playlist_url"
    a = segments.groupBy(key).agg(
        F.count("*").alias("segment_count"), F.avg("duration").alias("average_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"),
        F.bool_or(has_ad_break(F.col("title"))).alias("has_ads"), F.bool_or("discontinuity").alias("has_discontinuity"), F.count_distinct(category(F.col("title"))).alias("category_count"),
    )
    b = variants.groupBy(key).agg(F.count("*").alias("variant_count"), F.min(kbps(F.col("bandwidth"))).alias("min_kbps"), F.max(kbps(F.col("bandwidth"))).alias("max_kbps"), F.avg("bandwidth").alias("average_bandwidth"))

    def histogram(column: str) -> DataFrame:
        return variants.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"{column}_counts"))

    return playlists.join(a, key, "left").join(b, key, "left").join(histogram("codecs"), key, "left").join(histogram("resolution"), key, "left")


def playlist_json(playlists: DataFrame, segments: DataFrame, pretty: bool = True) -> DataFrame:
    """(playlist_url, document): a playlist and its segments in order, as JSON."""
    parts = segments.groupBy("playlist_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "uri", "duration", "title"))), lambda s: s.dropFields("pos")).alias("segments"))
    rest = [c for c in playlists.columns if c != "playlist_url"]
    return playlists.join(parts, "playlist_url", "left").select("playlist_url", F.to_json(F.struct(*rest, "segments"), {"pretty": str(pretty).lower()}).alias("document"))
