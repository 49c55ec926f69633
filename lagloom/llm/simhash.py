"""SimHash near-duplicates: fingerprints, and their links by a self-join of binary tries.

Equal fingerprints are folded first. The rest is dealt by the pigeonhole rule: of the
max_bits + exact_blocks blocks of a fingerprint, two fingerprints within max_bits agree on
exact_blocks whole ones. There is a table for each choice of such blocks, and fingerprints
that agree on them share a bucket. In each bucket a binary trie over the fingerprints is
joined with itself: pairs of nodes go down together, count the bits in which they differ,
and end where the count is over max_bits. A bucket gives the edges of a spanning forest of its
links, not the pairs, and a distributed pass finds the components. Buckets over a size are cut
into tiles, and every pair of tiles is joined: large buckets cost more tasks, not larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.common import components, cut, fresh, held, join_counted, small_batches

#: Rows of text worked on at once.
ROWS = 256
#: Squares of bucket sizes that one traversal takes on, which bounds its memory.
PAIRS = 4_000_000


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles, repeats included.

    Words are runs of other than ASCII white space, with A-Z lower-cased. A text of fewer words
    than a shingle has one shingle, the whole sequence; one without words has fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(data, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - shingle].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(data[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    n = len(hashes) // 8
    rows, count = np.frombuffer(hashes, np.uint8).reshape(n, 8), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        count += np.unpackbits(rows[at : at + 8192], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and bits (the fingerprint as a signed long), one row for each row of docs."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                bits = np.array([fingerprint(x, shingle, seed) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits long")


def trie_pairs(group: np.ndarray, bits: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of one group whose bits differ in at most max_bits places.

    Rows must be sorted by group, then bits (unsigned), without repeats. A trie node is a run of
    rows with the same leading bits; all pairs of nodes of a level go down at once.
    """
    n = len(bits)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n]
    keep = ends - starts > 1
    left = np.stack([starts[keep], ends[keep], starts[keep], ends[keep], np.zeros(keep.sum(), np.int64)])
    found = [np.zeros((2, 0), np.int64)]
    for depth in range(63, -1, -1):
        if not left.shape[1]:
            break
        ones = np.r_[0, np.cumsum((bits >> np.uint64(depth)) & np.uint64(1)).astype(np.int64)]
        a0, a2, b0, b2, off = left
        a1, b1 = a2 - (ones[a2] - ones[a0]), b2 - (ones[b2] - ones[b0])
        same = a0 == b0
        go = [
            np.stack([a0, a1, b0, b1, off]),
            np.stack([a1, a2, b1, b2, off]),
            np.stack([a0, a1, b1, b2, off + 1]),
            np.stack([a1, a2, b0, b1, off + 1])[:, ~same],
        ]
        left = np.concatenate(go, axis=1)
        wide_a, wide_b = left[1] - left[0], left[3] - left[2]
        own = left[0] == left[2]
        left = left[:, (wide_a > 0) & (wide_b > 0) & (left[4] <= max_bits) & ~(own & (wide_a == 1))]
        single = (left[1] - left[0] == 1) & (left[3] - left[2] == 1)
        if single.any():
            i, j = left[0, single], left[2, single]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
            found.append(np.stack([i[near], j[near]]))
            left = left[:, ~single]
    i, j = np.concatenate(found, axis=1)
    return np.minimum(i, j), np.maximum(i, j)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the first row that it is linked to, over any number of the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        if (root == before).all():
            break
    return root


def blocks_for(n: int, max_bits: int, most: int = 256) -> int:
    """How many blocks a bucket's fingerprints should agree on, so that evenly spread fingerprints, n in all, leave about `most` in a bucket."""
    exact = 2
    while exact < 6 and n >> (64 * exact // (max_bits + exact)) > most:
        exact += 1
    return exact


def table_masks(max_bits: int, exact_blocks: int) -> list[int]:
    """The bits on which two fingerprints of a bucket agree, for each table; signed."""
    blocks = np.array_split(np.arange(64), max_bits + exact_blocks)
    masks = [sum(1 << int(b) for k in chosen for b in blocks[k]) for chosen in combinations(range(len(blocks)), exact_blocks)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def forest_edges(nodes: DataFrame, max_bits: int = 4, exact_blocks: int = 2, tile: int = 1024) -> DataFrame:
    """Edges (a, b) between nodes (rep, bits; bits without repeats) that join exactly the nodes linked.

    Not all links, but enough to connect whatever links connect.
    """
    masks = table_masks(max_bits, exact_blocks)
    rows = nodes.select("rep", "bits", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("b")).select("rep", "bits", "b.*")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    dealt = rows.join(sizes.drop("n"), ["t", "key"])
    mine = F.pmod(F.xxhash64("bits"), F.col("tiles")).cast("int")
    # A bucket of one tile gives one pair of tiles, (0, 0).
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.withColumn("mine", mine).withColumn("other", other).select("t", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "bits", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(cols: list[np.ndarray]) -> pa.RecordBatch:
            t, key, x, y, bits, rep = cols
            bits = bits.view(np.uint64)
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            group = np.cumsum(new)
            order = np.lexsort((bits, group))
            bits, rep, group = bits[order], rep[order], group[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            work = np.cumsum(np.diff(np.r_[first, len(group)]).astype(np.int64) ** 2) // PAIRS
            a, b = [], []
            for part in np.unique(work):
                at = first[work == part]
                lo = at[0]
                hi = first[np.searchsorted(first, at[-1]) + 1] if at[-1] != first[-1] else len(group)
                i, j = trie_pairs(group[lo:hi], bits[lo:hi], max_bits)
                root = forest(i, j, hi - lo)
                linked = np.flatnonzero(root != np.arange(hi - lo))
                a.append(rep[lo:hi][linked])
                b.append(rep[lo:hi][root[linked]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            t, key, x, y = cols[:4]
            last = np.flatnonzero((t != t[-1]) | (key != key[-1]) | (x != x[-1]) | (y != y[-1]))
            end = last[-1] + 1 if len(last) else 0
            if end:
                yield joined([c[:end] for c in cols])
            held = [c[end:] for c in cols]
        if held and len(held[0]):
            yield joined(held)

    keys = ["t", "key", "x", "y"]
    kind = nodes.schema["rep"].dataType.simpleString()
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, max_bits: int = 4, exact_blocks: int | None = None, tile: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of docs.

    component_id is the smallest doc_id that links of at most max_bits differing bits reach.
    Texts that are null, empty or white space have fingerprint 0, which links like any other.
    A row with a null doc_id belongs to the component of the rows with its fingerprint, null if
    there is none with a doc_id, and links nothing else. Rows that repeat a doc_id have a row
    each and are one node: what any of them reaches, all reach. Other columns are not read; an
    empty table gives an empty result.

    exact_blocks: more gives more tables and smaller buckets (2: 15 tables by about 21 bits, 3: 35 by 27, 4: 70
    by 32); as many as the number of fingerprints asks for, if None.
    tile: a bucket with more rows is cut into tiles of about so many.
    """
    rows = cut(fingerprints(docs, shingle, seed))
    total = rows.count()
    # Each fingerprint is named by its smallest doc_id. One doc_id may have several fingerprints if it is repeated.
    classes = cut(rows.groupBy("bits").agg(F.min("doc_id").alias("rep"), F.count("*").alias("here")))
    exact_blocks = exact_blocks or blocks_for(classes.count(), max_bits)
    edges = forest_edges(classes.where("rep is not null").select("rep", "bits"), max_bits, exact_blocks, tile)
    # What a doc_id's fingerprints are named by is linked through the doc_id.
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("bits").alias("low"), F.max("bits").alias("high")).where("low != high").select("doc_id")
    own = rows.join(several, "doc_id").distinct().join(classes, "bits").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(own))
    named = classes.join(found, classes.rep == found.node, "left").select("bits", "here", F.coalesce("component", "rep").alias("component_id"))
    return join_counted(rows, named, "bits", "here", total).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose doc_id is that of their component, with all their columns; one for each component.

    Of rows that repeat that doc_id the least stays, by text, then by the other columns. Rows without a doc_id stay.
    """
    id_, n = fresh(docs, "__id", "__n")
    kept = near_duplicates(docs, **parameters).where("doc_id = component_id").select(F.col("doc_id").alias(id_)).distinct()
    ordered = [docs[c] for c in docs.columns if c != "text" and docs.schema[c].dataType.typeName() not in ("map", "variant")]
    once = Window.partitionBy(id_).orderBy(docs["text"], *ordered)
    named = docs.join(kept, docs["doc_id"] == kept[id_]).withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).drop(id_, n)
    return named.unionByName(docs.where("doc_id is null"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
