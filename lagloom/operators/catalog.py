"""The catalogue of broadcasts as a flat table of streams: inheritance, checks, lookups, selection.

streams: group_key, group_name, group_content_type, group_enabled, broadcast_key, broadcast_name,
broadcast_content_type, broadcast_enabled, stream_name, url, type, role, content_type, enabled.
A group without broadcasts, or a broadcast without streams, has a row with nulls below it.
Unset flags are null; the functions below say what an unset flag counts as, which differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.text import CONTENT_TYPES
from lagloom.functions.urls import stream_type

ROLES = ["source", "cdn"]


def given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def inherit(streams: DataFrame, detect: bool = True) -> DataFrame:
    """Content types from stream, broadcast or group, the first that is given; unset flags become true.

    The rows of a disabled group stay as they are, those of a disabled broadcast don't. With detect,
    an enabled stream without a type gets one by its URL.
    """
    live = F.coalesce("group_enabled", F.lit(True))
    enabled = F.coalesce("enabled", F.lit(True))
    from_broadcast = F.coalesce(given("broadcast_content_type"), given("group_content_type"))
    kind = F.coalesce(given("type"), F.when(enabled & F.lit(detect), stream_type(F.col("url"))))
    changes = {
        "group_enabled": live,
        "broadcast_content_type": from_broadcast,
        "broadcast_enabled": F.coalesce("broadcast_enabled", F.lit(True)),
        "content_type": F.coalesce(given("content_type"), from_broadcast),
        "enabled": enabled,
        "type": kind,
    }
    return streams.withColumn("__live", live).withColumns({c: F.when(F.col("__live"), e).otherwise(F.col(c)) for c, e in changes.items()}).drop("__live")


def enabled_groups(streams: DataFrame) -> DataFrame:
    """Rows of groups that are enabled; unset counts as disabled."""
    return streams.where("group_enabled")


def streams_of(streams: DataFrame, role: str, kind: str | None = None) -> DataFrame:
    """Enabled streams of a role, and of a type if given. An unset flag counts as enabled for a broadcast, not for a stream."""
    found = streams.where(F.coalesce("broadcast_enabled", F.lit(True)) & F.col("enabled") & (F.col("role") == role))
    return found if kind is None else found.where(F.col("type") == kind)


def stream_of(streams: DataFrame, kind: str, role: str) -> DataFrame:
    """For each broadcast the first enabled stream, by name, of a type and role."""
    w = Window.partitionBy("group_key", "broadcast_key").orderBy("stream_name")
    found = streams.where(F.col("enabled") & (F.col("type") == kind) & (F.col("role") == role))
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def has_required_roles(streams: DataFrame, key: str = "group_key") -> DataFrame:
    """(key, complete): whether there is an enabled source and an enabled copy."""
    on = F.coalesce("broadcast_enabled", F.lit(True)) & F.coalesce("enabled", F.lit(False))
    has = [F.coalesce(F.bool_or(on & (F.col("role") == r)), F.lit(False)) for r in ROLES]
    return streams.groupBy(key).agg((has[0] & has[1]).alias("complete"))


def groups_with(streams: DataFrame, broadcast_key: str) -> DataFrame:
    """Enabled groups that hold a broadcast."""
    return enabled_groups(streams).where(F.col("broadcast_key") == broadcast_key).select("group_key", "group_name").distinct()


def first_group(streams: DataFrame) -> DataFrame:
    """The enabled group of the lowest key, one row."""
    return enabled_groups(streams).agg(F.min("group_key").alias("group_key"))


def enabled_broadcasts(streams: DataFrame) -> DataFrame:
    """One row: how many broadcasts are enabled in enabled groups; an unset flag of a broadcast counts as disabled."""
    return enabled_groups(streams).where("broadcast_enabled").agg(F.count_distinct("group_key", "broadcast_key").alias("n"))


def select_by_index(df: DataFrame, group: list[str], order: str, index: int) -> DataFrame:
    """The row of each group that comes at an index (from 0) in the order of a unique key; none if the index is out of range."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w) - 1).where(F.col("__n") == index).drop("__n")


def select_broadcast(streams: DataFrame, index: int) -> DataFrame:
    """The streams of the broadcast at an index among the enabled ones of the first group; out of range is an error."""
    rows = enabled_groups(streams).where("broadcast_enabled").join(F.broadcast(first_group(streams)), "group_key", "left_semi")
    keys = rows.select("group_key", "broadcast_key").distinct()
    n = keys.count()
    if not 0 <= index < n:
        raise IndexError(f"broadcast index {index} is out of range: there are {n} enabled broadcasts")
    return rows.join(select_by_index(keys, ["group_key"], "broadcast_key", index), ["group_key", "broadcast_key"], "left_semi")


def problems(streams: DataFrame) -> DataFrame:
    """(group_key, broadcast_key, stream_name, level, problem): all that is wrong with a catalogue, in the order of checks by level.

    The first row by level and keys is what a loader that stops at the first problem would report.
    """
    none = F.lit(None).cast("string")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    named = streams.groupBy("group_key").agg(F.max(given("group_name")).alias("name"), F.count("broadcast_key").alias("broadcasts")).join(has_required_roles(streams), "group_key")
    groups = named.select("group_key", none.alias("broadcast_key"), none.alias("stream_name"), F.lit(1).alias("level"), F.when(F.col("name").isNull(), "a group needs a name").when(F.col("broadcasts") == 0, "a group needs a broadcast").when(~F.col("complete"), "a group needs an enabled source and an enabled copy").alias("problem"))
    inner = streams.where("broadcast_key is not null").groupBy("group_key", "broadcast_key").agg(F.max(given("broadcast_name")).alias("name"), F.count("stream_name").alias("streams"))
    broadcasts = inner.select("group_key", "broadcast_key", none.alias("stream_name"), F.lit(2).alias("level"), F.when(F.col("name").isNull(), "a broadcast needs a name").when(F.col("streams") == 0, "a broadcast needs a stream").alias("problem"))
    kind = F.coalesce(given("content_type"), given("broadcast_content_type"), given("group_content_type"))
    fault = (
        F.when(empty("url"), "a stream needs a URL")
        .when(~F.coalesce("role", F.lit("")).isin(ROLES), F.concat(F.lit("a role must be source or cdn, not "), F.coalesce("role", F.lit(""))))
        .when(kind.isNull(), "a stream, its broadcast or its group needs a content type")
        .when(~kind.isin(CONTENT_TYPES), F.concat(F.lit(f"a content type must be one of {', '.join(CONTENT_TYPES)}, not "), kind))
    )
    parts = streams.where("stream_name is not null").select("group_key", "broadcast_key", "stream_name", F.lit(3).alias("level"), fault.alias("problem"))
    return groups.unionByName(broadcasts).unionByName(parts).where("problem is not null")
