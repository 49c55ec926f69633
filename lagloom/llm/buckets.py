"""Links between the members of buckets, found in tiles whose bytes are bounded.

A bucket's members are dealt into tiles by their bytes. First each tile is compared inside and with the
bucket's first member. Of the buckets that this leaves in several components all pairs of tiles are
compared: large buckets cost more tasks, not larger ones. A tile gives the edges of a spanning
forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import components, cut, join_counted

#: Bytes of what is compared in a tile, about; one member may have more.
TILE_BYTES = 8_000_000


def shared_buckets(rows: DataFrame, total: int, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """key, node, first, tiles of rows (node, key, size) whose key several have; total: rows' count.

    Buckets of the same members are taken once.
    """
    hashed = F.xxhash64("node")
    # The sums of both halves of the hashes tell buckets with other members apart.
    sizes = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("first"), F.sum("size").alias("bytes"),
        F.sum(F.shiftright(hashed, 32)).alias("high"), F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
    )
    once = sizes.where("n > 1").groupBy("n", "first", "bytes", "high", "low").agg(F.min("key").alias("key"))
    buckets = cut(once.select("key", "n", "first", F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("bytes") / tile_bytes))).cast("int").alias("tiles")))
    return cut(join_counted(rows.select("key", "node"), buckets, "key", "n", total).drop("n"))


def _linked(dealt: DataFrame, payloads: DataFrame, link: Callable) -> DataFrame:
    """Edges (a, b) of the groups (key, x, y) of dealt (key, x, y, node)."""
    kind = payloads.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(held: list, node_type) -> pa.RecordBatch:
            links = link([p for _, p in held]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[ij[side]][0] for ij in links], node_type) for side in (0, 1)], ["a", "b"])

        group, held, type_ = None, [], None
        for batch in batches:
            type_ = batch.column(3).type
            keys = zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)
            for key, node, data in zip(keys, batch.column(3).to_pylist(), batch.column(4), strict=True):
                if key != group:
                    if held:
                        yield joined(held, type_)
                    group, held = key, []
                held.append((node, data.as_py()))
        if held:
            yield joined(held, type_)

    keys = ["key", "x", "y"]
    moved = dealt.distinct().join(payloads, "node").select(*keys, "node", "payload").repartition(*keys).sortWithinPartitions(*keys)
    return moved.mapInArrow(run, f"a {kind}, b {kind}")


def forest_edges(members: DataFrame, payloads: DataFrame, link: Callable) -> DataFrame:
    """Edges (a, b) that connect exactly the members of a bucket that links connect.

    members: from shared_buckets. payloads: node, payload (bytes). link: from a list of payloads pairs (i, j) of
    indices, enough to connect whatever its links connect.
    """
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    all_ = F.sequence(F.lit(0), F.col("tiles") - 1)
    inside = members.select("key", "node", F.explode(F.when(F.col("node") == F.col("first"), all_).otherwise(F.array(mine))).alias("x")).withColumn("y", F.col("x"))
    edges = cut(_linked(inside, payloads, link))
    large = members.where("tiles > 1")
    if large.isEmpty():
        return edges
    found = components(edges)
    of = F.coalesce("component", large["node"])
    open_ = large.join(found, large["node"] == found["node"], "left").groupBy("key").agg(F.min(of).alias("a"), F.max(of).alias("b")).where("a != b").select("key")
    pairs = large.join(open_, "key", "left_semi").withColumn("mine", mine).withColumn("other", F.explode(all_))
    across = pairs.select("key", "node", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    return cut(edges.unionByName(_linked(across, payloads, link)))
