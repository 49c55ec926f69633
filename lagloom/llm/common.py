"""What several of the corpus operators share: the shared folder, skew-safe joins,
prefix sums over a whole table, and a distributed connected-components loop."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: White space as the contracts of this package define it.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Keys with over 1/HOT_KEYS of the rows are handled apart; there are at most HOT_KEYS of them.
HOT_KEYS = 1024
#: Keys with fewer rows are never handled apart.
FEW = 256


#: Bytes of an Arrow batch between Spark and a Python worker, where the session allows more.
BATCH = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes: whole texts may be very long, and both sides hold a batch."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # as Spark has it
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


_HELD: dict = {}


def held(name: str, make=None):
    """What a Python worker keeps from task to task for one operator, made if it isn't there.

    Workers are used for one stage after another. Another operator's tables and caches are given
    back to the system first, so that a worker's memory is that of one operator.
    """
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)
        _HELD[name] = make() if make else None
    return _HELD[name]


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Where that is unset, a temporary folder is
    taken in local mode, and anything else is refused: executors would not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lagloom-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever Spark can reach it."""
    files, at = _files(spark, path)
    files.delete(at, True)


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def file_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    files, at = _files(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    files, at = _files(spark, path)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, which is there whole or not at all."""
    files, at = _files(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not files.rename(draft, at):
        raise OSError(f"can't write {path}")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that df has for a column already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_key(column: str = "doc_id"):
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of left with right, which has one row for each key of left.

    count is a column of right: how many rows of left have the key; total is their sum.
    Keys with more than total / HOT_KEYS rows, at most HOT_KEYS, are broadcast, so that the
    rows of a hot key stay where they are; the rest is an ordinary shuffle join.
    """
    is_hot = F.col(count) * F.lit(HOT_KEYS) > F.lit(total)
    hot, cold = right.where(is_hot), right.where(~is_hot)
    near = left.join(F.broadcast(hot), key)
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def join_salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of left with right, which has one row for each key of left.

    Keys with more than 1 / HOT_KEYS of left's rows, at most HOT_KEYS, are dealt to several tasks, into
    parts of about so many rows; right's row of such a key goes to each. left is read once more to count.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") * HOT_KEYS > total).where(F.col("n") > FEW).collect()
    if not hot:
        return left.join(right, key)
    parts = left.sparkSession.createDataFrame([(r[key], min(HOT_KEYS, -(-r.n // max(FEW, total // HOT_KEYS)))) for r in hot], left.select(key).schema.add("__parts", "integer"))
    salted = left.join(F.broadcast(parts), key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__parts")), F.lit(0)).cast("int"))
    copies = right.join(F.broadcast(parts), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return salted.drop("__parts").join(copies.drop("__parts"), [key, "__salt"]).drop("__salt")


def quantile_cuts(df: DataFrame, columns: dict, parts: int, accuracy: int = 10_000) -> dict:
    """Up to parts - 1 ascending cut points for each named numeric expression, in one pass.

    percentile_approx keeps a sketch of bounded size in each task; the driver gets one row.
    """
    if parts < 2:
        return {name: [] for name in columns}
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    row = df.agg(*[F.percentile_approx(e, at, accuracy).alias(n) for n, e in columns.items()]).first()
    return {n: sorted({x for x in (row[n] or []) if x is not None}) for n in columns}


def cell(value, cuts: list):
    """How many of the ascending cuts are at most value; 0 for null."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value)), F.lit(0))


def sample_rows(df: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """At most `most` rows of df, the ones with the smallest hashes of all their columns, with the hash as `at`; equal rows count once.

    by: at most `most` for each value of that column, so that a rare value gets its rows, too. Only hashes
    are compared; the texts of rows that aren't chosen go nowhere. The chosen hashes are broadcast, 8 bytes each.
    """
    keyed = df.withColumn("at", F.xxhash64(*df.columns))
    if by is None:
        chosen = keyed.select("at").orderBy("at").limit(most).distinct()
    else:
        first = F.row_number().over(Window.partitionBy(by).orderBy("at"))
        chosen = keyed.select("at", by).withColumn("__n", first).where(F.col("__n") <= most).select("at").distinct()
    return keyed.join(F.broadcast(chosen), "at").dropDuplicates(["at"])


def prefix_sums(df: DataFrame, order: str, sums: dict, parts: int, ties: tuple = ()) -> DataFrame:
    """df with new columns: for each name in sums, the sum of its column over all rows before this one.

    Rows are ordered by order (numeric, null first), then ties. They are dealt into ranges of
    order by approximate quantiles; a window sums within each range, and the sums of the
    ranges, parts rows at most, are summed once more and joined by broadcast. No task sees more
    than one range.
    """
    cuts = quantile_cuts(df, {"at": F.col(order)}, parts)["at"]
    dealt = df.withColumn("__range", cell(F.col(order), cuts))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__{n}").over(before), zero).alias(f"__{n}") for n in sums])
    return (
        dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), zero) for n, c in sums.items()})
        .join(F.broadcast(offsets), "__range")
        .withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums})
        .drop("__range", *[f"__{n}" for n in sums])
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable.

    Alternates large-star and small-star steps: each replaces edges by edges to smaller nodes,
    with minima that Spark combines before the shuffle, until nothing changes. The edges of the
    centre of a large star are dealt to several tasks. Every step is checkpointed. Nothing but
    counts, a checksum and the centres of at most HOT_KEYS stars gets to the driver.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")
    now = cut(pairs.distinct())
    seen = None
    while True:
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = cut(join_salted(now, least.select(F.col("u").alias("b"), "m"), "b").select("a", F.col("m").alias("b")).where("a > b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_salted(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(low.select("a", F.col("m").alias("b")))
        now = cut(small.distinct())
        row = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if seen == tuple(row):
            break
        seen = tuple(row)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
