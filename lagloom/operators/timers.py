"""Named events of a run: how long they took, and what share of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.numbers import ratio
from lagloom.functions.text import event_title


def durations(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds between the first and the last mark (column ts) of each event."""
    seconds = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    return marks.groupBy(*keys).agg(seconds.alias("seconds"))


def shares(events: DataFrame, total: float | None = None, value: str = "seconds") -> DataFrame:
    """events with title and percent of the total: a wall time if given, else the sum."""
    whole = events.agg(F.sum(value).alias("__whole")) if total is None else events.sparkSession.createDataFrame([(float(total),)], "__whole double")
    return events.join(F.broadcast(whole)).withColumns({"title": event_title(F.col("event")), "percent": ratio(F.col(value), F.col("__whole")) * 100}).drop("__whole")


def response_seconds(events: DataFrame, names: list[str]) -> DataFrame:
    """The sum of several named events, one row."""
    return events.where(F.col("event").isin(names)).agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
