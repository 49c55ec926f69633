"""Live polls of streams: rows where something changed since the last poll."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(df: DataFrame, key: str, order: list[str], value: str, keep_empty: bool = True, silent_s: float | None = None) -> DataFrame:
    """Rows whose value differs from the one before of the same key, the first row included. state.follow() is the same on a stream.

    Without keep_empty, null and empty values are passed over as if they weren't there. With silent_s a row
    counts as a first one if the one before it is older than that; the first column of order is then its time.
    """
    rows = df if keep_empty else df.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    if silent_s is not None:
        gap = F.col(order[0]).cast("timestamp").cast("double") - F.lag(F.col(order[0]).cast("timestamp").cast("double")).over(w)
        first |= F.coalesce(gap > silent_s, F.lit(False))
    return rows.withColumn("__new", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("__new").drop("__new")


def changed_titles(captures: DataFrame) -> DataFrame:
    return changed(captures, "stream", ["ts"], "title", keep_empty=False)


def changed_playlists(captures: DataFrame) -> DataFrame:
    return changed(captures.where("media_sequence is not null"), "stream", ["ts"], "media_sequence")


def lag_windows(liveness: DataFrame, size: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Mean, largest and number of lags by comparison and window of event time; later rows than late are dropped by a stream.

    liveness: ts, comparison, lag_seconds, status; only matches count.
    """
    rows = liveness.where("status = 'MATCH'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window: Column = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window, "comparison").agg(F.avg(F.abs("lag_seconds")).alias("mean_lag"), F.max(F.abs("lag_seconds")).alias("max_lag"), F.count("*").alias("n"))
