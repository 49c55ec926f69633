"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised at its quantiles, the cells are put in the order in which a Hilbert
curve visits them, and the ordered rows are cut into runs. Rows of a shard are then near each
other in all dimensions at once, so that filters on any of them can skip most files. Only ids,
sizes and curve positions are shuffled; DataFrame functions do everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagloom.llm.common import cell, cut, fresh, quantile_cuts


def as_number(df: DataFrame, column: str):
    """A number in the order of a column that isn't a string's."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return F.col(column).cast("timestamp").cast("double") if not isinstance(kind, T.BooleanType) else F.col(column).cast("double")
    return F.col(column).cast("double")


def string_cuts(df: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 ascending values that cut a string column into cells of about equal counts, by the values' whole order.

    The distinct values are counted and ranged; the driver gets the first value of each cell. Null is before the first.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("part").agg(F.sum("n").alias("sum"))
    offsets = sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    total = sums.agg(F.sum("sum")).first()[0]
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), "part")
    of = F.expr(f"(offset + inside) * {parts - 1} div {max(total or 0, 1)}")
    return sorted((r.value for r in placed.groupBy(of.alias("cell")).agg(F.min("value").alias("value")).collect()), key=lambda v: v.encode())


def hilbert_index(cells: list, bits: int):
    """The place on the Hilbert curve of a cell, given by integer columns of so many bits each.

    The axes are rotated and reflected bit by bit from the top, Gray-coded, and their bits
    interleaved. bits * len(cells) must be below 63.
    """
    n = len(cells)
    if bits * n > 62:
        raise ValueError("too many bits for a long")
    axes = F.array(*[c.cast("long") for c in cells])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x, step):
        low, i = step["q"] - 1, step["i"]
        own, first = F.get(x, i), F.get(x, F.lit(0))
        on = own.bitwiseAND(step["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        # Where the bit is set, the first axis is reflected; else the low bits of both axes trade places.
        return F.transform(
            x,
            lambda v, k: F.when(on, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v),
        )

    if bits > 1:
        axes = F.aggregate(steps, axes, turn)

    # Gray code: each axis takes in the one before it, and all take in what the last one's bits call for.
    gray = F.aggregate(axes, F.array().cast("array<long>"), lambda done, v: F.concat(done, F.array(F.when(F.size(done) > 0, F.element_at(done, -1).bitwiseXOR(v)).otherwise(v))))
    gather = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<long>")

    def weave(x):
        last = F.element_at(x, -1)
        flip = F.aggregate(gather, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.transform(
            F.array(flip),
            lambda f: F.aggregate(places, F.lit(0).cast("long"), lambda h, p: h * 2 + F.call_function("shiftright", F.get(x, p["i"]).bitwiseXOR(f), p["b"]).bitwiseAND(F.lit(1).cast("long"))),
        )[0]

    # Bound once by a transform over one element, lest every use computes the arrays again.
    return F.transform(F.array(gray), weave)[0]


def curve_order(df: DataFrame, dimensions: list[str], bits: int = 5):
    """The column of df's curve positions, after a pass over the numbers for their quantiles and one over each string dimension. Null comes first."""
    strings = {c for c in dimensions if isinstance(df.schema[c].dataType, T.StringType)}
    numbers = {f"d{i}": as_number(df, c) for i, c in enumerate(dimensions) if c not in strings}
    cuts = quantile_cuts(df, numbers, 1 << bits) if numbers else {}

    def spread(value, at: list):
        """The cells, few or many, over the whole axis: else a dimension of few values would decide nothing but the last turns of the curve."""
        return F.floor(cell(value, at) * F.lit(1 << bits) / F.lit(len(at) + 1))

    cells = [spread(F.col(c), string_cuts(df, c, 1 << bits)) if c in strings else spread(numbers[f"d{i}"], cuts[f"d{i}"]) for i, c in enumerate(dimensions)]
    return hilbert_index(cells, bits)


def shard_by_curve(docs: DataFrame, dimensions: list[str], shards: int = 24, bits: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot: every row of docs in one of the shards.

    Rows are ordered by place on the curve, then by checksum of the text, so that equal texts of
    a cell are neighbours, then by doc_id. Shards are runs of that order whose counts differ by one at most;
    slot counts from 0 in each shard. size is the text's UTF-8 bytes plus 8. A null text has 8
    bytes and the checksum of the empty text; null dimensions and ids come first. Repeated
    rows have a slot each; a table of fewer rows than shards leaves shards empty. Other columns
    are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    # Small rows, kept: the range bounds are drawn from them without reading texts again.
    curve = curve_order(docs.select(*dimensions), dimensions, bits).alias("curve")
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), curve))
    keys = ["curve", "text_crc32", "doc_id", "size"]
    # Range partitions of the order, and in each the place within: kept, since another run may choose other bounds.
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    total = placed.count()
    # One row for each partition: a few for each file read.
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    return ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, dimensions: list[str], shards: int = 24, bits: int = 5) -> None:
    """Writes docs with all their columns, a folder for each shard, rows in slot order.

    The columns shard and slot are added, with underscores before their names where docs has them. Every
    row is written once: rows that repeat doc_id and text are numbered, and may trade places. Null ids come
    first; an empty table writes no shard.
    """
    id_, size, crc, n, shard, slot = names = fresh(docs, "__id", "__size", "__crc", "__n", "shard", "slot")
    keys = names[:3]
    placed = cut(shard_by_curve(docs, dimensions, shards, bits).select(*[F.col(a).alias(b) for a, b in zip(["doc_id", "size", "text_crc32", "shard", "slot"], [*keys, shard, slot], strict=True)]))
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.withColumns({id_: F.col("doc_id"), size: (F.octet_length(text) + 8).cast("long"), crc: F.crc32(text)})
    if placed.groupBy(*keys).count().where("count > 1").isEmpty():
        named, placed = named.withColumn(n, F.lit(1)), placed.withColumn(n, F.lit(1))
    else:
        same = Window.partitionBy(*keys)
        kinds = [c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]
        named = named.withColumn(n, F.row_number().over(same.orderBy(F.xxhash64(*kinds))))
        placed = placed.withColumn(n, F.row_number().over(same.orderBy(shard, slot)))
    other = placed.select(*[F.col(k).alias(f"{k}_") for k in [*keys, n]], shard, slot)
    same_row = named[id_].eqNullSafe(other[f"{id_}_"])
    for k in [size, crc, n]:
        same_row &= named[k] == other[f"{k}_"]
    joined = named.join(other, same_row).drop(*keys, n, *[f"{k}_" for k in [*keys, n]])
    joined.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard_by_curve(docs, ["lang", "source", "n_chars"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
