"""From aligned pairs to the lag of each kind of delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions.numbers import below, round_places, seconds_to_ms
from lagloom.functions.text import display_name, split_key

# A pair goes to the first slot all of whose words are in its name.
SLOTS = [
    ("hls_cloudfront_lag", ["pri_source", "hls", "ti"]),
    ("hls_ais_lag", ["pri_source", "hls", "ss_ais"]),
    ("icecast_cloudfront_lag", ["pri_source", "mp3", "ti"]),
    ("icecast_ais_lag", ["pri_source", "mp3", "ss_ais"]),
    ("source_lag", ["pri_source", "bk_source"]),
]
#: What a slot is called in metrics. The last four are never filled.
COMPARISONS = {
    "hls_cloudfront_lag": "pri_source_vs_ti_hls",
    "icecast_cloudfront_lag": "pri_source_vs_ti_mp3",
    "hls_ais_lag": "pri_source_vs_ss_ais_hls",
    "icecast_ais_lag": "pri_source_vs_ss_ais_mp3",
    "source_lag": "pri_source_vs_bk_source",
    "hls_cloudfront_lag_from_backup": "bk_source_vs_ti_hls",
    "icecast_cloudfront_lag_from_backup": "bk_source_vs_ti_mp3",
    "hls_ais_lag_from_backup": "bk_source_vs_ss_ais_hls",
    "icecast_ais_lag_from_backup": "bk_source_vs_ss_ais_mp3",
}


def slot_of(name: Column) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for slot, words in SLOTS:
        fits = F.lit(True)
        for w in words:
            fits = fits & F.contains(name, F.lit(w))
        found = found.when(fits, slot)
    return found


def copy_status(lag: Column, is_valid: Column, similarity: Column, least: float) -> Column:
    """Status of a delivered copy by its rounded lag. Too little likeness outranks a missing alignment; null if there is no similarity."""
    return F.when(similarity.isNull(), None).when(below(similarity, least), "NO_MATCH").when(below(lag, 0) | ~is_valid, "NO_ALIGNMENT").otherwise("MATCH")


def source_status(is_valid: Column, similarity: Column, least: float) -> Column:
    """Status of the other source, which may be ahead."""
    return F.when(similarity.isNull(), None).when(below(similarity, least), "NO_MATCH").when(~is_valid, "NO_ALIGNMENT").otherwise("MATCH")


def classify(pairs: DataFrame, least_similarity: float = 0.6, places: int = 3) -> DataFrame:
    """(broadcast_key, comparison, lag_seconds, status) of pairs that belong in a slot.

    pairs: broadcast_key, alignment_name, latency_seconds, is_valid, overall_similarity. Of several
    pairs for one slot the one with the lowest name counts.
    """
    lag = round_places(F.col("latency_seconds"), places)
    source = F.col("comparison") == "source_lag"
    made = (
        pairs.withColumn("comparison", slot_of(F.col("alignment_name")))
        .where("comparison is not null")
        .withColumn("lag_seconds", F.when(source & ~F.col("is_valid"), 0.0).otherwise(lag))
        .withColumn("status", F.when(source, source_status(F.col("is_valid"), F.col("overall_similarity"), least_similarity)).otherwise(copy_status(lag, F.col("is_valid"), F.col("overall_similarity"), least_similarity)))
    )
    one = made.groupBy("broadcast_key", "comparison").agg(F.min_by(F.struct("lag_seconds", "status"), "alignment_name").alias("first"))
    return one.select("broadcast_key", "comparison", "first.lag_seconds", "first.status")


def pivot(liveness: DataFrame) -> DataFrame:
    """A row for each broadcast with a struct(lag_seconds, status) for every slot, null where nothing is known."""
    known = [s for s, _ in SLOTS]
    wide = liveness.groupBy("broadcast_key").pivot("comparison", known).agg(F.first(F.struct("lag_seconds", "status")))
    return wide.withColumns({s: F.lit(None).cast("struct<lag_seconds: double, status: string>") for s in COMPARISONS if s not in known})


def unpivot(wide: DataFrame) -> DataFrame:
    """(broadcast_key, comparison, lag_ms, status) of the filled slots, lags in whole milliseconds."""
    long = wide.unpivot(["broadcast_key"], list(COMPARISONS), "slot", "value").where("value is not null")
    names = F.create_map(*[F.lit(x) for pair in COMPARISONS.items() for x in pair])
    return long.select("broadcast_key", F.element_at(names, F.col("slot")).alias("comparison"), seconds_to_ms(F.col("value.lag_seconds")).alias("lag_ms"), F.col("value.status").alias("status"))


def metric_rows(wide: DataFrame, broadcasts: DataFrame) -> DataFrame:
    """(metric, value, tags): a gauge for each filled slot, and the run time of each broadcast that has one.

    Keys without an underscore give no rows. The group is what stands before the first.
    """
    named = broadcasts.withColumn("__k", split_key(F.col("broadcast_key"))).where("__k is not null")
    base = named.select("broadcast_key", "total_s", F.array(F.concat(F.lit("group:"), "__k.group"), F.concat(F.lit("broadcast:"), display_name(F.col("name"), F.col("__k.broadcast")))).alias("base"))
    lags = unpivot(wide).join(base, "broadcast_key").select(F.lit("streaming.latency.benchmark.ms").alias("metric"), F.col("lag_ms").alias("value"), F.concat("base", F.array(F.concat(F.lit("comparison:"), "comparison"), F.concat(F.lit("status:"), "status"))).alias("tags"))
    times = base.join(wide, "broadcast_key", "left_semi").where("total_s > 0").select(F.lit("streaming.benchmark.duration.milliseconds").alias("metric"), seconds_to_ms(F.col("total_s")).alias("value"), F.col("base").alias("tags"))
    return lags.unionByName(times)
