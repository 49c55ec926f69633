"""Which streams of a broadcast are compared with which, and the tables that result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.functions.text import fingerprint_name, pair_name

#: Parts that a broadcast's copies are dealt into at least, if there are as many; sources and copies of a part at most, on average; tasks for each core that pair them.
PARTS, SIDE, TASKS = 64, 4096, 4


def tasks_of(spark: SparkSession, n: int, few: int, many: int) -> int:
    """How many tasks n rows are dealt to: TASKS for each core, fewer if that leaves less than `few` rows to a task, more if more than `many`."""
    most = TASKS * spark.sparkContext.defaultParallelism
    return max(1, min(most, -(-n // few)), -(-n // many))


def tasks_for(df: DataFrame, few: int, many: int) -> int:
    """How many tasks df's rows are dealt to, as tasks_of their number."""
    return tasks_of(df.sparkSession, df.count(), few, many)


def measurable(streams: DataFrame) -> DataFrame:
    """Streams to be measured: all but those that are disabled; unset counts as enabled."""
    return streams.where(F.coalesce("enabled", F.lit(True)))


def without_errors(df: DataFrame) -> DataFrame:
    return df.where("error is null")


def valid_alignments(alignments: DataFrame) -> DataFrame:
    return alignments.where("error is null and is_valid")


def pair_streams(streams: DataFrame, few: int = 0, many: int = 0) -> DataFrame:
    """Every primary source with each copy and each other source of its broadcast.

    streams: broadcast_key, stream_name, role and others. A primary source has `pri` in its name.
    The join is on the broadcast, so that it never goes beyond one. Few broadcasts may have very many streams: sources and copies
    are dealt into parts by their names, and each part of the sources meets each part of the copies in a cell of its own, so that
    no broadcast is one task and no large one is held whole. Streams of one name stay in one part.
    few, many: pairs of a task, as in tasks_of; the streams are counted for them. Without them there are TASKS for each core.
    """
    primary, copy = F.expr("role = 'source' and contains(stream_name, 'pri')"), F.expr("role = 'cdn' or (role = 'source' and not contains(stream_name, 'pri'))")
    sizes = streams.groupBy("broadcast_key").agg(F.count_if(primary).alias("__sources"), F.count_if(copy).alias("__copies")).where("__sources > 0 and __copies > 0")
    # A number of tasks of its own: the rows that go in are few bytes, which Spark would bring together, but the pairs that come out are many.
    if many:
        pairs = sizes.agg(F.sum(F.col("__sources") * F.col("__copies"))).first()[0] or 0
        tasks = tasks_of(streams.sparkSession, pairs, few, many)
    else:
        tasks = TASKS * streams.sparkSession.sparkContext.defaultParallelism
    parts = lambda n: F.ceil(F.col(n) / SIDE)
    cut = sizes.select("broadcast_key", parts("__sources").cast("int").alias("__rows"), F.greatest(F.least("__copies", F.lit(PARTS)), parts("__copies")).cast("int").alias("__columns"))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = streams.where(primary).select("broadcast_key", F.col("stream_name").alias("stream1")).join(cut, "broadcast_key")
    left = left.select("broadcast_key", "stream1", own("stream1", "__rows").alias("__row"), each("__columns").alias("__column"))
    right = streams.where(copy).select("broadcast_key", F.col("stream_name").alias("stream2"), F.col("role").alias("role2")).join(cut, "broadcast_key")
    right = right.select("broadcast_key", "stream2", "role2", each("__rows").alias("__row"), own("stream2", "__columns").alias("__column"))
    keys = ["broadcast_key", "__row", "__column"]
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("shuffle_hash"), keys)
    return met.select("broadcast_key", "stream1", "stream2", "role2").withColumn("alignment_name", pair_name(F.col("stream1"), F.col("stream2")))


def with_fingerprints(alignments: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Valid alignments with the comparison of the same pair; pairs without one are dropped."""
    named = comparisons.select("broadcast_key", F.col("alignment_name").alias("__name"), "overall_similarity", F.col("error").alias("comparison_error"))
    found = valid_alignments(alignments).withColumn("__name", fingerprint_name(F.col("alignment_name")))
    return found.join(named, ["broadcast_key", "__name"]).drop("__name")


def within_deadline(df: DataFrame, took_ns, most_ns: int, what: str) -> DataFrame:
    """df with an error for what took longer than most_ns; 0 is no limit. An earlier error stays."""
    if not most_ns:
        return df
    late = F.lit(f"timeout: {what} took over {most_ns / 1e9:g}s")
    return df.withColumn("error", F.coalesce("error", F.when(took_ns > most_ns, late)))


def start_spread(streams: DataFrame, started: str, most_ms: float = 100.0) -> DataFrame:
    """(broadcast_key, spread_ms, together): how far the starts of a broadcast's measurements lie apart, and whether no more than most_ms."""
    ms = F.col(started).cast("timestamp").cast("double") * 1000
    spread = F.max(ms) - F.min(ms)
    return streams.groupBy("broadcast_key").agg(spread.alias("spread_ms"), (spread <= most_ms).alias("together"))


def guard(broadcasts: DataFrame, streams: DataFrame, least: int = 2) -> DataFrame:
    """broadcasts with valid_streams and, below the least number, an error unless they have one."""
    counted = streams.where("error is null and validation.is_valid").groupBy("broadcast_key").agg(F.count("*").alias("valid_streams"))
    n = F.coalesce("valid_streams", F.lit(0))
    message = F.concat(F.lit("insufficient valid streams ("), n, F.lit(") for alignment"))
    return broadcasts.join(counted, "broadcast_key", "left").withColumn("valid_streams", n).withColumn("error", F.coalesce("error", F.when(n < least, message)))


def passing(df: DataFrame, guarded: DataFrame) -> DataFrame:
    """The rows of df whose broadcast has no error."""
    return df.join(guarded.where("error is null"), "broadcast_key", "left_semi")
