"""Near copies by SimHash, checked exactly by the Jaccard similarity of word shingles.

Documents that links of few differing bits of their fingerprints connect (simhash.py) share a bucket. At a similarity
of 0.8 fingerprints differ in 4 to 14 bits, so that MinHash bands add the near copies that such links miss; texts
as alike as asked for share one of BANDS bands but for (1 - s**4) ** BANDS of the pairs, 3 in 100,000 at 0.8. In a
bucket the sets of shingles themselves are compared, in tiles of bounded bytes (buckets.py), by lists of the
sets that hold a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm import simhash
from lagloom.llm.buckets import TILE_BYTES, forest_edges, shared_buckets
from lagloom.llm.common import components, cut, fresh, held, small_batches

ROWS = 256
BANDS, BAND_ROWS = 20, 4
_RANDOM = np.random.default_rng(8).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Ascending 64-bit hashes of the different shingles of a text.

    Words are those of simhash.fingerprint. A text of fewer words than a shingle has one shingle, the whole sequence.
    """
    words = (text or "").encode().lower().split()
    runs = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.array([xxhash.xxh64_intdigest(r) for r in runs], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed number for each band; two sets share that of a band with about their similarity to the power BAND_ROWS."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[at : at + 2048] ^ _RANDOM[0]) * _RANDOM[1]).min(1))
    width = 8 * BAND_ROWS
    data = low.tobytes()
    keys = [xxhash.xxh64_intdigest(data[b * width : b * width + width], b) for b in range(BANDS)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) between sets of at least that similarity, enough to connect whatever all links connect."""
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # For each value the sets that hold it, one list after another.
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(at, kind="stable")]
    first = np.cumsum(often) - often
    left, links = np.arange(1, len(sets)), []
    queue, next_ = [0], 0
    while len(left):
        if next_ == len(queue):
            queue.append(int(left[0]))
            left = left[1:]
            continue
        i = queue[next_]
        next_ += 1
        own = at[ends[i] - size[i] : ends[i]]
        own = own[often[own] > 1]
        lengths = often[own]
        listed = np.repeat(first[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(holders[listed], minlength=len(sets))[left]
        near = shared >= similarity * (size[i] + size[left] - shared) - 1e-9
        links += [(i, int(j)) for j in left[near]]
        queue += left[near].tolist()
        left = left[~near]
    return links


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tile_bytes: int = TILE_BYTES, together: DataFrame | None = None) -> DataFrame:
    """node, component of the documents (node, text) that links of at least that similarity connect with others.

    component is the smallest node. Null, empty and white texts have the same one shingle, the empty sequence. A node
    is to come once. An empty table, and one without near copies, gives no rows. Very long texts count
    whole; a tile holds one of them, or several up to tile_bytes of their hashes.

    together: (node, key), once each; nodes of one key are compared, too, beside those that share a MinHash band.
    """
    small_batches(docs.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near copies")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                keys, sizes = [band_keys(s) for s in sets], [8 * len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["node", "keys", "size"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingle_set(t, shingle).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "payload"])

    docs = docs.select("node", "text")
    dealt = cut(docs.mapInArrow(keyed, "node binary, keys array<long>, size long"))
    total = dealt.count() * (BANDS + (together is not None))
    rows = dealt.select("node", "size", F.explode("keys").alias("key"))
    if together is not None:
        rows = rows.unionByName(dealt.select("node", "size").join(together, "node").select("node", "size", "key"))
    members = shared_buckets(rows, total, tile_bytes)
    sets = cut(docs.join(members.select("node").distinct(), "node", "left_semi").mapInArrow(listed, "node binary, payload binary"))
    return components(forest_edges(members, sets, lambda found: forest([np.frombuffer(p, np.uint64) for p in found], similarity)))


def alike_bits(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, key) of the documents (doc_id, text), one row for each doc_id that SimHash links connect with another text; key: a hash of the component."""
    found = simhash.near_duplicates(docs, shingle)
    alike = found.groupBy("doc_id").agg(F.first("component_id").alias("component"))  # all rows of a doc_id are of one component
    large = found.groupBy(F.col("component_id").alias("component")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return alike.join(large, "component").select("doc_id", F.xxhash64(F.lit("simhash"), "component").alias("key"))


def keep_one(docs: DataFrame, shingle: int = 5, **parameters) -> DataFrame:
    """The rows of docs but those that a near copy with a smaller doc_id (of equal doc_ids, another text) stands for.

    A document is a doc_id with a text: rows that repeat both stay or go together, and rows that
    repeat only the doc_id are documents of their own. Rows without a doc_id stay. Texts without words are
    near copies of each other, and so are null and empty ones. An empty table gives an empty one.
    """
    (node,) = fresh(docs, "__node")
    # Sixteen bytes, in the order of doc_id.
    half = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    name = F.concat(half(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), half(F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("node"), "text")
    together = cut(known.select("doc_id", "node").distinct().join(alike_bits(known.select("doc_id", "text"), shingle), "doc_id").select("node", "key"))
    found = near_copies(known.select("node", "text"), shingle, together=together, **parameters)
    gone = found.where("node != component").select(F.col("node").alias(node))
    named = docs.withColumn(node, name)
    return named.join(gone, node, "left_anti").drop(node)
