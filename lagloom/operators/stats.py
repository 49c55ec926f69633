"""Descriptive statistics of measurement series, and the metrics of a whole run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.numbers import finite, ns_to_ms

FIELDS = ["count", "mean", "median", "p95", "p99", "min", "max", "std_dev"]

# Names of the report's series.
#: Slots of the lag report, by comparison; the last four start from the backup source and stay empty.
LAG_SERIES = {
    "hls_cloudfront_lag": "latency_hls_cloudfront",
    "hls_ais_lag": "latency_hls_ais",
    "icecast_cloudfront_lag": "latency_icecast_cloudfront",
    "icecast_ais_lag": "latency_icecast_ais",
    "source_lag": "latency_source",
    "hls_cloudfront_lag_from_backup": "latency_hls_cloudfront_from_backup",
    "hls_ais_lag_from_backup": "latency_hls_ais_from_backup",
    "icecast_cloudfront_lag_from_backup": "latency_icecast_cloudfront_from_backup",
    "icecast_ais_lag_from_backup": "latency_icecast_ais_from_backup",
}
OTHER_SERIES = ["time_to_first_byte", "total_processing_time", "alignment_confidence", "fingerprint_similarity"]
#: Series that are null, not zero, in a report without a single source lag.
WITH_SOURCE = ["latency_source", *[s for s in LAG_SERIES.values() if s.endswith("_from_backup")]]


def describe(value: Column) -> list[Column]:
    """Aggregates: exact percentiles with linear interpolation, population deviation; zeros for an empty series.

    Nulls are not part of the series. Values that come out as NaN or infinite become 0.
    """
    x = value.cast("double")
    p = F.percentile(x, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    made = {"mean": F.avg(x), "median": p[0], "p95": p[1], "p99": p[2], "min": F.min(x), "max": F.max(x), "std_dev": F.stddev_pop(x)}
    return [F.count(x).alias("count")] + [F.coalesce(finite(c), F.lit(0.0)).alias(n) for n, c in made.items()]


#: Series with more values, and more than a thousandth of all, have their percentiles picked by rank.
LARGE = 1_000_000
CELLS = 1000
_AT = {"median": 0.5, "p95": 0.95, "p99": 0.99}


def stats_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """describe() for each group of keys.

    The exact percentiles of a series come from all of its values in one task, which does up to
    LARGE. Of the larger series, a thousand at most, see ranked_percentiles().
    """
    counts = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    if total <= LARGE:
        return df.groupBy(*keys).agg(*describe(F.col(value)))
    large = counts.where((F.col("__n") > LARGE) & (F.col("__n") * CELLS > total)).select(*[F.col(k).alias(f"__{k}") for k in keys], "__n")
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(large[f"__{k}"])
    rest = df.join(F.broadcast(large), same, "left_anti").groupBy(*keys).agg(*describe(F.col(value)))
    hot = df.join(F.broadcast(large), same).select(*keys, F.col(value).cast("double").alias("__x"), "__n").where("__x is not null")
    plain = {"count": F.count("__x"), "mean": F.avg("__x"), "min": F.min("__x"), "max": F.max("__x"), "std_dev": F.stddev_pop("__x")}
    parts = [hot.groupBy(*keys).agg(*[c.alias(n) for n, c in plain.items()]), ranked_percentiles(hot, keys, large, _AT)]
    # One row of each part for a group, of which each knows its own columns.
    whole = parts[0].unionByName(parts[1], allowMissingColumns=True).groupBy(*keys).agg(*[F.max(c).alias(c) for c in FIELDS])
    return rest.unionByName(whole.select(*keys, "count", *[F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in FIELDS[1:]]))


def ranked_percentiles(rows: DataFrame, keys: list[str], groups: DataFrame, at: dict[str, float]) -> DataFrame:
    """keys and a column for each of at: exact percentiles of __x, with linear interpolation between ranks.

    rows: keys, __x and __n, the number of rows of the group; groups: the few groups there are. Approximate cuts
    part a group into CELLS; cells are counted, and only of those that hold a rank that is asked for are the
    values sorted, each cell by a task that may spill.
    """
    marks = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("__x", marks, 10 * CELLS).alias("__cuts"))
    named = cuts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.array_distinct("__cuts").alias("__cuts"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(named[f"__k{i}"])
    # As many cuts as are at most x: a search by halves over the sorted cuts.
    steps = F.array(*[F.lit(1 << b) for b in range(CELLS.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size("__cuts")) & (F.get("__cuts", n + s - 1) <= F.col("__x")), n + s).otherwise(n))
    celled = rows.join(F.broadcast(named), same).select(*keys, "__x", "__n", found.alias("__cell"))
    below = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = celled.groupBy(*keys, "__n", "__cell").agg(F.count("*").alias("__here")).withColumn("__below", F.coalesce(F.sum("__here").over(below), F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank"), w.alias("weight")) for name, p in at.items() for r, w in _ranks(p)])
    wanted = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__cell").alias("__c"), "__below", "__here", F.explode(ranks).alias("__r"))
    wanted = wanted.where("__r.rank >= __below and __r.rank < __below + __here").groupBy(*[f"__k{i}" for i in range(len(keys))], "__c", "__below").agg(F.collect_list("__r").alias("__ranks"))
    same = celled["__cell"] == wanted["__c"]
    for i, k in enumerate(keys):
        same = same & celled[k].eqNullSafe(wanted[f"__k{i}"])
    order = Window.partitionBy(*keys, "__cell").orderBy("__x")
    placed = celled.join(F.broadcast(wanted), same).withColumn("__rank", F.col("__below") + F.row_number().over(order) - 1)
    picked = placed.select(*keys, "__x", F.explode(F.filter("__ranks", lambda r: r["rank"] == F.col("__rank"))).alias("r"))
    return picked.groupBy(*keys).agg(*[F.sum(F.when(F.col("r.name") == n, F.col("__x") * F.col("r.weight"))).alias(n) for n in at])


def _ranks(p: float) -> list[tuple]:
    """The ranks, from 0, around the place p of __n sorted values, and what each weighs; both are the same rank where the place is whole."""
    place = F.lit(p) * (F.col("__n") - 1)
    return [(F.floor(place), 1 - (place - F.floor(place))), (F.floor(place) + 1, place - F.floor(place))]


def zero_filled(stats: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    """A row of stats for every key of spine (unique), zeros where stats has none."""
    joined = spine.select(key).join(stats, key, "left")
    return joined.select(key, F.coalesce("count", F.lit(0)).cast("long").alias("count"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FIELDS[1:]])


def metric_values(broadcasts: DataFrame, streams: DataFrame, alignments: DataFrame, comparisons: DataFrame, liveness: DataFrame) -> DataFrame:
    """(metric, value) of all that a run measured, from what went well only.

    Lags count by their size and only where the status is MATCH. Everything of a broadcast with an error is
    left out, and every stream, alignment and comparison with one. Times are whole milliseconds.
    """
    good = broadcasts.where("error is null").select("broadcast_key")

    def of_good(df: DataFrame) -> DataFrame:
        return df.join(good, "broadcast_key", "left_semi")

    names = F.create_map(*[F.lit(x) for pair in LAG_SERIES.items() for x in pair])
    lags = of_good(liveness).where("status = 'MATCH'").select(F.element_at(names, F.col("comparison")).alias("metric"), F.abs("lag_seconds").alias("value")).where("metric is not null")
    timed = of_good(streams).where("error is null").select(F.explode(F.create_map(F.lit("time_to_first_byte"), ns_to_ms(F.col("ttfb_ns")).cast("double"), F.lit("total_processing_time"), ns_to_ms(F.col("total_ns")).cast("double"))).alias("metric", "value")).where("value is not null")
    sure = of_good(alignments).where("error is null").select(F.lit("alignment_confidence").alias("metric"), F.col("offset_confidence").alias("value"))
    alike = of_good(comparisons).where("error is null").select(F.lit("fingerprint_similarity").alias("metric"), F.col("overall_similarity").alias("value"))
    return lags.unionByName(timed).unionByName(sure).unionByName(alike)


def performance_metrics(values: DataFrame) -> DataFrame:
    """A row of statistics for each series of a run; null statistics for WITH_SOURCE if no source lag was measured."""
    spine = values.sparkSession.createDataFrame([(m,) for m in [*LAG_SERIES.values(), *OTHER_SERIES]], "metric string")
    return with_presence(zero_filled(stats_by(values, ["metric"], "value"), F.broadcast(spine), "metric"))


def with_presence(stats: DataFrame, source: str = "latency_source", bound: list[str] | None = None, key: str = "metric") -> DataFrame:
    """stats with nulls in the rows of bound unless the row of source counts something."""
    bound = WITH_SOURCE if bound is None else bound
    n = stats.where(F.col(key) == source).agg(F.coalesce(F.max("count"), F.lit(0)).alias("__n"))
    shown = ~F.col(key).isin(bound) | (F.col("__n") > 0)
    return stats.join(F.broadcast(n)).select(key, *[F.when(shown, F.col(c)).alias(c) for c in FIELDS])
