"""Merkle manifest of a dataset: a root over all rows, and a proof for each.

Leaves are numbered within their source. Level by level, the index divided by the fanout groups nodes
into runs, whose sorted digests are hashed into parents, until a source has one node left, its subroot.
The subroots are the leaves of one more tree, whose last node is the root. Proofs are made on the way
back down: each level's runs are joined with the proofs of their own nodes, and each child of a run gets
its siblings before them. The joins get smaller by the fanout from level to level, and only digests move.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.common import cut, join_counted, text_key

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def hexed(digest):
    return F.lower(F.hex(digest))


def hashed(text):
    """The digest of a text, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def leaf(fields: list):
    """The digest of a row: each field is `-` if null, else its UTF-8 byte count, `:` and its value."""
    texts = [f.cast("string") for f in fields]
    return hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def indexed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, the place from 0 among the rows of the same group (not null), and n, how many these are.

    Rows are ranged by group and order, so that a large group lies in many partitions; the places
    within partitions, the partitions' counts and the groups' first places give the index.
    """
    placed = cut(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    # One row for each partition.
    offsets = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    ranked = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("__rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    groups = cut(ranked.groupBy(group).agg(F.min("__rank").alias("__first"), F.count("*").alias("n")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_counted(ranked, groups, group, "n", total).withColumn("idx", F.col("__rank") - F.col("__first")).drop("__at", "__part", "__before", "__rank", "__first")


def climb(nodes: DataFrame, fanout: int, extra: list[str]) -> list[DataFrame]:
    """The levels of runs over nodes (key, idx, n, digest and extra columns, which the lowest runs keep).

    A level has key, idx, n, digest (of the run) and children (in order). Only keys that have several nodes
    below have a run; a key's last level has n = 1.
    """
    levels: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        child = F.struct("idx", "digest", *(extra if not levels else []))
        runs = nodes.where("n > 1").groupBy("key", F.expr(f"idx div {fanout}").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"))
        runs = runs.agg(F.sort_array(F.collect_list(child)).alias("children"))
        nodes = cut(runs.withColumn("digest", hashed(F.array_join(F.transform("children", lambda c: hexed(c["digest"])), ""))))
        levels.append(nodes)
        most = math.ceil(most / fanout)
    return levels


def ends(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """key and digest of the node that remains of each key."""
    found = nodes.where("n = 1").select("key", "digest")
    for level in levels:
        found = found.unionByName(level.where("n = 1").select("key", "digest"))
    return found


def prove(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, extra: list[str]) -> DataFrame:
    """digest, path, the extra columns and those of tops (key, path and others), a row for each node.

    path holds, from a node's own level up, what lies left and right of it in its run: siblings' digests,
    one after another. The path of a key's last node is what tops has for it.
    """
    carried = [c for c in tops.columns if c != "key"]
    before = lambda d, at: F.array_join(F.transform(F.slice(d, F.lit(1), at), lambda x: F.hex(x["digest"])), "")
    after = lambda d, at: F.array_join(F.transform(F.slice(d, at + 2, F.size(d)), lambda x: F.hex(x["digest"])), "")
    paths = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth].drop("digest")
        known = level.where("n = 1").join(tops, "key")
        if paths is not None:
            known = known.unionByName(level.where("n > 1").join(paths.drop("digest"), ["key", "idx"]))
        rows = known.select("key", *carried, "children", F.posexplode("children").alias("at", "child"))
        step = F.struct(F.unhex(before(F.col("children"), F.col("at"))).alias("left"), F.unhex(after(F.col("children"), F.col("at"))).alias("right"))
        paths = rows.withColumn("path", F.concat(F.array(step), "path")).select("key", *carried, "child.*")
    lone = nodes.where("n = 1").join(tops, "key").select("key", *carried, "idx", "digest", *extra)
    return (paths.unionByName(lone) if paths is not None else lone).drop("key", "idx")


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "source", order: str = "doc_id", fanout: int = FANOUT, extra: dict | None = None) -> DataFrame:
    """order (by its name), leaf, subroot, root, path and the extra columns (name: expression over docs), a row for each row of docs.

    Digests are 32 bytes; path as in prove, up to the root. Leaves of a group ascend by order, null first, and
    rows that repeat an order by their digest; groups ascend by their UTF-8 bytes, null first, a null and an empty
    one being two. A null or empty text is a field like any other. A lone leaf is its subroot, a lone
    subroot the root; both paths are then empty. An empty table gives no rows. Columns of docs that aren't named are
    not read. The number of levels is the logarithm of the largest group; each is kept in the shared folder.
    """
    extra = extra or {}
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    leaves = cut(docs.select(key.alias("key"), F.col(order).alias("order"), leaf([F.col(f) for f in fields]).alias("digest"), *[e.alias(f"x{i}") for i, e in enumerate(extra.values())]))
    own = ["order", *[f"x{i}" for i in range(len(extra))]]
    nodes = cut(indexed(leaves, "key", ["order", "digest"]))
    levels = climb(nodes, fanout, own)
    roots = cut(indexed(ends(nodes, levels).select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), "key", ["group"]))
    over = climb(roots, fanout, ["group"])
    root = ends(roots, over).first()
    top = docs.sparkSession.createDataFrame([("", [])], "key string, path array<struct<left: binary, right: binary>>")
    tops = prove(roots, over, top, ["group"]).select(F.col("group").alias("key"), F.col("digest").alias("subroot"), "path")
    named = [F.col(f"x{i}").alias(name) for i, name in enumerate(extra)]
    proven = prove(nodes, levels, cut(tops), own)
    return proven.select(F.col("order").alias(order), F.col("digest").alias("leaf"), "subroot", F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"), "path", *named)


def folded(digest, path):
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda h, p: hashed(F.concat(hexed(p["left"]), hexed(h), hexed(p["right"]))))


def siblings(path):
    """The digests of a path as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(hexed(p["left"]), hexed(p["right"]))), "")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = [F.translate("text", "\n", "") if f == "text" else F.col(f) for f in FIELDS]
    # Null where the row's own leaf stands: nothing is tampered with, or there is nothing to delete.
    other = F.when((text_key() % 2 == 0) & F.contains("text", F.lit("\n")), leaf(tampered))
    rows = manifest(docs, extra={"other": other})
    rows = rows.withColumn("folded", folded(F.coalesce("other", "leaf"), F.col("path")))
    return rows.select(
        "doc_id",
        *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _sql(levels: int = 24, over: int = 8) -> str:
    """The same by windows and grouping, level after level, for up to 3**levels rows of a source and 3**over sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = " || ".join(field(c) for c in FIELDS[:-1])
    # The remainder of unsigned crc32 by 2, byte by byte and bit by bit.
    crc = (
        "list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, CAST(4294967295 AS BIGINT))"
    )
    out = [
        f"d AS (SELECT doc_id, source, {row} AS head, text, xor({crc}, CAST(4294967295 AS BIGINT)) % 2 = 0 AS hit FROM documents)",
        f"a0 AS (SELECT doc_id, coalesce('+' || source, '') AS k, sha256(head || {field('text')}) AS h, "
        f"sha256(head || CASE WHEN hit THEN {field("replace(text, chr(10), '')")} ELSE {field('text')} END) AS t, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "r0 AS (SELECT k, i, n, h, CAST([] AS VARCHAR[]) AS hs FROM a0)",
    ]
    for x in range(1, levels + 1):
        out.append(f"r{x} AS MATERIALIZED (SELECT k, i // 3 AS i, (n + 2) // 3 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS hs FROM r{x - 1} WHERE n > 1 GROUP BY k, i // 3, n)")
    out.append("s AS (" + " UNION ALL ".join(f"SELECT k, h FROM r{x} WHERE n = 1" for x in range(levels + 1)) + ")")
    out.append("s0 AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM s)")
    out.append("u0 AS (SELECT i, n, h, CAST([] AS VARCHAR[]) AS hs FROM s0)")
    for x in range(1, over + 1):
        out.append(f"u{x} AS MATERIALIZED (SELECT i // 3 AS i, (n + 2) // 3 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS hs FROM u{x - 1} WHERE n > 1 GROUP BY i // 3, n)")
    out.append("root AS (" + " UNION ALL ".join(f"SELECT h FROM u{x} WHERE n = 1" for x in range(over + 1)) + ")")
    out.append("p0 AS (SELECT a0.doc_id, a0.k, a0.i, s0.i AS j, a0.h AS leaf, s0.h AS subroot, a0.t AS f, '' AS p FROM a0 JOIN s0 USING (k))")
    last = "p0"
    steps = [(f"r{x}", f"r.k = p.k AND r.i = p.i // {3**x}", f"p.i // {3 ** (x - 1)} % 3") for x in range(1, levels + 1)]
    steps += [(f"u{x}", f"r.i = p.j // {3**x}", f"p.j // {3 ** (x - 1)} % 3") for x in range(1, over + 1)]
    for x, (table, on, at) in enumerate(steps, 1):
        left, right = f"array_to_string(r.hs[1:{at}], '')", f"array_to_string(r.hs[{at} + 2:], '')"
        out.append(
            f"p{x} AS MATERIALIZED (SELECT p.* EXCLUDE (f, p), CASE WHEN r.hs IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, "
            f"CASE WHEN r.hs IS NULL THEN p ELSE p || {left} || {right} END AS p FROM {last} p LEFT JOIN {table} r ON {on})"
        )
        last = f"p{x}"
    return f"WITH {',\n'.join(out)}\nSELECT doc_id, leaf, subroot, root.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM {last}, root"


OP12_SQL = _sql()
