"""Ratios, histograms and error classes of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.numbers import HEALTH_BANDS, health_band, ratio
from lagloom.functions.text import error_class


def health_histogram(score, measured=None):
    """Aggregate: a map of all four bands to their counts; rows without a score aren't counted."""
    band = health_band(score)
    known = score.isNotNull() if measured is None else measured & score.isNotNull()
    bands = [b for _, b in HEALTH_BANDS] + ["poor"]
    return F.create_map(*[x for b in bands for x in (F.lit(b), F.count_if(known & (band == b)))])


def quality_metrics(broadcasts: DataFrame, streams: DataFrame, alignments: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row: rates of valid streams, successful alignments and matches, average health, health histogram.

    Only broadcasts without an error count. Average health divides by all of them, scored or not.
    """
    good = broadcasts.where("error is null")

    def share(df: DataFrame, fine, name: str) -> DataFrame:
        own = df.join(good.select("broadcast_key"), "broadcast_key", "left_semi")
        return own.agg(ratio(F.count_if(fine), F.count("*")).alias(name))

    a = share(streams, F.expr("error is null and validation.is_valid"), "stream_validity_rate")
    b = share(alignments, F.expr("error is null and is_valid"), "alignment_success_rate")
    c = share(comparisons, F.expr("error is null and is_valid_match"), "fingerprint_match_rate")
    d = good.agg(ratio(F.sum(F.coalesce("health_score", F.lit(0.0))), F.count("*")).alias("average_health_score"), health_histogram(F.col("health_score")).alias("health_distribution"))
    return a.join(b).join(c).join(d)  # four single rows


def success_by_type(streams: DataFrame) -> DataFrame:
    """(type, rate) for each type of stream seen: the share without error and valid."""
    fine = F.col("error").isNull() & F.coalesce(F.col("validation.is_valid"), F.lit(False))
    return streams.groupBy("type").agg(ratio(F.count_if(fine), F.count("*")).alias("rate"))


def error_counts(broadcasts: DataFrame, streams: DataFrame) -> DataFrame:
    """(error_class, n) over the errors of broadcasts, and of streams whose broadcast has none."""
    failed = broadcasts.where("error is not null").select("error")
    fine = broadcasts.where("error is null").select("broadcast_key")
    parts = streams.where("error is not null").join(fine, "broadcast_key", "left_semi").select("error")
    return failed.unionByName(parts).groupBy(error_class(F.col("error")).alias("error_class")).agg(F.count("*").alias("n"))


def reliability_metrics(broadcasts: DataFrame, streams: DataFrame) -> DataFrame:
    """One row of maps and rates. overall_success_rate and retry_rate are always 0: nothing measures them."""
    good = broadcasts.where("error is null").select("broadcast_key")
    rates = success_by_type(streams.join(good, "broadcast_key", "left_semi")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "rate")))).alias("success_rate_by_type"))
    errors = error_counts(broadcasts, streams).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_class", "n")))).alias("error_distribution"))
    return rates.join(errors).withColumns({"overall_success_rate": F.lit(0.0), "retry_rate": F.lit(0.0)})


def run_counts(broadcasts: DataFrame, streams: DataFrame) -> DataFrame:
    """One row: broadcasts that went well and that failed, and streams measured."""
    a = broadcasts.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return a.join(streams.agg(F.count("*").alias("streams")))
