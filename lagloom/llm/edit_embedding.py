"""Document fingerprints by a randomised edit embedding, and near copies found with them.

A walk goes through a text step by step. Each step writes down the character it stands at, and goes on to
the next one or stays, as a pseudorandom bit says that belongs to the step and the character. The bits are
shared by all texts, so that walks over texts of a small edit distance fall in step again after each edit,
and what they write down differs in few places: edit distance becomes Hamming distance. A fingerprint samples
fixed places of what is written, SAMPLES from each doubling of the walk's length, a hex digit each.

Near copies are found by bands of sampled places that fingerprints have in common, and verified
by their likeness, the share of equal places of the whole walk that the samples estimate.
"""

from __future__ import annotations

import hashlib
import math
import random
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.buckets import TILE_BYTES, forest_edges, shared_buckets
from lagloom.llm.common import components, cut, held, join_counted, quantile_cuts, small_batches

#: Samples of each doubling of a walk, the first of which has as many steps.
SAMPLES = 64
#: Samples of a band, and how many of the last whole doublings are dealt into bands.
BAND, DOUBLINGS = 8, 2
#: Steps after which the walk's random bits repeat.
PERIOD = 64
#: Doublings that have samples: walks of up to SAMPLES * 2**(OCTAVES - 1) steps.
OCTAVES = 40
#: Characters of a text walked at once; pieces of the walk that a worker remembers, and their length.
STRETCH, PIECES, LONGEST = 1 << 18, 400_000, 40
#: Characters that a worker remembers.
CHARACTERS = 50_000
ROWS = 256


def _places() -> list[int]:
    found = list(range(SAMPLES))
    for o in range(1, OCTAVES):
        low = SAMPLES << (o - 1)
        found += sorted(random.Random(o).sample(range(low, 2 * low), SAMPLES))
    return found


#: The sampled steps, and how many steps each stands for.
PLACES = _places()
WEIGHTS = np.array([1.0] * SAMPLES + [2.0 ** (o - 1) for o in range(1, OCTAVES) for _ in range(SAMPLES)])


class Walker:
    """Walks over texts; a worker keeps one, with what it remembers of pieces of text met before."""

    def __init__(self):
        self.stays: dict[str, tuple] = {}
        self.digits: dict[str, str] = {}
        # For each state the pieces met in it, with what the walk writes over them and the space that follows.
        self.pieces: list[dict[str, str]] = [{} for _ in range(PERIOD)]
        self.known = 0

    def stay(self, c: str) -> tuple:
        """For each state how many steps the walk stays at the character."""
        found = self.stays.get(c)
        if found is None:
            if len(self.stays) >= CHARACTERS:
                self.stays.clear()
            bits = xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass"), 11) | 1
            goes = [bits >> s & 1 for s in range(PERIOD)]
            found = self.stays[c] = tuple(1 + next(d for d in range(PERIOD) if goes[(s + d) % PERIOD]) for s in range(PERIOD))
        return found

    def write(self, text: str, step: int) -> str:
        """What the walk writes over the text from that step on, character by character."""
        out = []
        for c in text:
            n = (self.stays.get(c) or self.stay(c))[step % PERIOD]
            out.append(c * n)
            step += n
        return "".join(out)

    def walk(self, text: str, step: int) -> str:
        """The same, by pieces between spaces."""
        out, words = [], text.split(" ")
        last = words.pop()
        pieces = self.pieces
        for word in words:
            found = pieces[step % PERIOD].get(word)
            if found is None:
                found = self.write(word + " ", step)
                if len(word) <= LONGEST:
                    if self.known >= PIECES:
                        for p in pieces:
                            p.clear()
                        self.known = 0
                    self.known += 1
                    pieces[step % PERIOD][word] = found
            out.append(found)
            step += len(found)
        out.append(self.write(last, step))
        return "".join(out)

    def sample(self, text: str, step: int = 0) -> tuple[str, int]:
        """The digits of the sampled places that the walk over the text passes from that step on, and the step after the last."""
        digits, out = self.digits, []
        for at in range(0, len(text), STRETCH):
            written = self.walk(text[at : at + STRETCH], step)
            end = step + len(written)
            for place in PLACES[bisect_left(PLACES, step) : bisect_left(PLACES, end)]:
                c = written[place - step]
                d = digits.get(c)
                if d is None:
                    if len(digits) >= CHARACTERS:
                        digits.clear()
                    d = digits[c] = f"{xxhash.xxh64_intdigest(c.encode('utf-8', 'surrogatepass'), 12) & 15:x}"
                out.append(d)
            step = end
        return "".join(out), step


def walker() -> Walker:
    return held("edit embedding", Walker)


def fingerprint(text: str | None) -> str:
    """Hex digits, SAMPLES for each doubling of the walk; none for a null or empty text. Equal texts have equal ones."""
    return walker().sample(text or "")[0]


def likeness(a: str, b: str) -> float:
    """The share of the longer walk's places at which both have written the same, as the samples show it: 1 for equal fingerprints."""
    if len(a) < len(b):
        a, b = b, a
    if a == b:
        return 1.0
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in (a, b))
    weights = WEIGHTS[: len(a)]
    return float(weights[: len(b)][x[: len(b)] == y].sum() / weights.sum())


def bands(print_: str) -> list[int]:
    """Signed keys of bands: runs of a random order of the samples of the last whole doublings, and of a text too short for one, its whole fingerprint."""
    whole = len(print_) // SAMPLES
    if not whole:
        keys = [xxhash.xxh64_intdigest(f"- {print_}")]
    else:
        keys = []
        for o in range(max(0, whole - DOUBLINGS), whole):
            own = print_[o * SAMPLES : (o + 1) * SAMPLES]
            keys += [xxhash.xxh64_intdigest(f"{o} {b} {own[b :: SAMPLES // BAND]}") for b in range(SAMPLES // BAND)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and fingerprint of each row of docs (key, text). Null and empty texts have the empty one. Other columns are not read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t) for t in part.column(1).to_pylist()], pa.string())], [key, "fingerprint"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fingerprint string")


def place_among(value, cuts: list):
    """How many of the ascending cuts are at most value, found in two steps; 0 for null."""
    wide = max(1, math.isqrt(len(cuts)))
    count = lambda array: F.coalesce(F.size(F.filter(array, lambda c: c <= value)), F.lit(0))
    if not cuts:
        return F.lit(0)
    whole = F.array(*[F.lit(c) for c in cuts])
    coarse = count(F.array(*[F.lit(c) for c in cuts[wide - 1 :: wide]])) * wide
    return F.when(value.isNull(), 0).otherwise(coarse + count(F.slice(whole, coarse + 1, F.lit(wide))))


def in_order(docs: DataFrame) -> DataFrame:
    """part, turn, doc_id, text of docs, in partitions by part, each sorted by turn, then by descending doc_id, null last, and by text.

    A part is a range of doc_ids, the largest first; turn 0 are its own rows. With turn 1 come the rows of the first
    doc_id of the next part, in the last part those of the first one, so that a task sees what follows its last row.
    Parts are cut by approximate quantiles of the ids, which alone are read for that; the driver gets one
    id a part. Texts move once.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = quantile_cuts(docs, {"at": F.col("doc_id")}, int(spark.conf.get("spark.sql.shuffle.partitions")))["at"]
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - place_among(F.col("doc_id"), cuts)).cast("int")
    firsts = [tuple(r) for r in docs.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id")).orderBy("part").collect()]
    follows = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    # One row for each part.
    copies = F.broadcast(spark.createDataFrame(follows, f"first {kind}, also int"))
    rows = docs.select("doc_id", "text", part.alias("part")).join(copies, F.col("doc_id").eqNullSafe(F.col("first")), "left")
    turns = F.array(F.struct("part", F.lit(0).alias("turn")), F.struct(F.col("also").alias("part"), F.lit(1).alias("turn")))
    rows = rows.select(F.explode(F.when(F.col("also").isNull(), F.slice(turns, 1, 1)).otherwise(turns)).alias("go"), "doc_id", "text").select("go.*", "doc_id", "text")
    return rows.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", "turn", F.desc_nulls_last("doc_id"), "text")


def edited_prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each row of docs, its text as edited, and the next one.

    The next row is that of the next smaller doc_id; after the last comes the first. A null doc_id is the last, rows that repeat
    a doc_id go by text. The edited text has the first half of the text's characters (the middle one, too), and the
    first of the next text, as many as the other half had, or all. A null text is empty; the fingerprint
    of an empty text is empty, too, and its likeness 1 to an empty one, 0 to others. A single row is its own next. An empty
    table gives no rows. Other columns are not read; texts of any length count whole.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, out, types = walker(), None, [], None

        def ready() -> pa.RecordBatch:
            kinds = [types, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            found = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return found

        for batch in batches:
            types = batch.column(2).type
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for number, turn, id_, text in zip(*[part.column(c).to_pylist() for c in range(4)], strict=True):
                    if turn and (last is None or last[0] != number):
                        continue  # the part's last row has been met with the first of these
                    text = text or ""
                    half = len(text) // 2
                    stays = text[: len(text) - half]
                    begun, step = own.sample(stays)
                    whole = begun + own.sample(text[len(stays) :], step)[0]
                    if last is not None and last[0] == number:
                        _, before, n, kept, first, there, mark = last
                        added = text[: n - len(kept)]
                        edited = first + own.sample(added, there)[0]
                        digest = hashlib.sha256((kept + added).encode()).hexdigest()
                        out.append((before, n, digest, mark, edited, likeness(mark, edited), likeness(mark, whole)))
                        if len(out) >= ROWS:
                            yield ready()
                    last = None if turn else (number, id_, len(text), stays, begun, step, whole)
        if out:
            yield ready()

    return in_order(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def like_forest(prints: list[bytes], alike: float) -> list[tuple[int, int]]:
    """Links (i, j) between fingerprints of at least that likeness, enough to connect whatever all links connect."""
    length = np.array([len(p) for p in prints])
    digits = np.zeros((len(prints), length.max(initial=0)), np.uint8)
    for row, p in zip(digits, prints, strict=True):
        row[: len(p)] = np.frombuffer(p, np.uint8)
    weights = WEIGHTS[: digits.shape[1]]
    whole = np.r_[0.0, np.cumsum(weights)]
    left, links, queue, next_ = np.arange(1, len(prints)), [], [0], 0
    while len(left):
        if next_ == len(queue):
            queue.append(int(left[0]))
            left = left[1:]
            continue
        i = queue[next_]
        next_ += 1
        n = length[i]
        same = (digits[left, :n] == digits[i, :n]) @ weights[:n]
        near = same >= alike * whole[np.maximum(length[left], n)] - 1e-9
        links += [(i, int(j)) for j in left[near]]
        queue += left[near].tolist()
        left = left[~near]
    return links


def edit_classes(docs: DataFrame, alike: float = 0.8, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """doc_id, fingerprint and class_id, one row for each row of docs: the smallest doc_id that links reach.

    Texts are linked if their fingerprints share a band and are alike enough; two texts at that likeness share none of 16 bands
    with a chance of (1 - alike**8) ** 16, 5% at 0.8 and less than 1 in 10,000 at 0.9. Equal fingerprints, those of
    null and empty texts among them, are folded first. A row with a null doc_id is in the class of the rows with its
    fingerprint, null if none has a doc_id, and links nothing else. Rows that repeat a doc_id have a row each and are one node.
    An empty table gives no rows. Fingerprints move to the buckets that they share, texts nowhere.
    """
    rows = cut(fingerprints(docs))
    total = rows.count()
    classes = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("here")))
    named = classes.where("node is not null").select("node", "fingerprint")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(m) for m in marks], pa.int64()), pa.array([bands(m) for m in marks], pa.list_(pa.int64()))], ["node", "size", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = cut(named.mapInArrow(keyed, f"node {kind}, size long, keys array<long>").select("node", "size", F.explode("keys").alias("key")))
    members = shared_buckets(dealt, dealt.count(), tile_bytes)
    edges = forest_edges(members, named.select("node", F.col("fingerprint").cast("binary").alias("payload")), lambda found: like_forest(found, alike))
    # What a doc_id's fingerprints are named by is linked through the doc_id.
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).where("low != high").select("doc_id")
    own = rows.join(several, "doc_id").distinct().join(classes, "fingerprint").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(edges.unionByName(own)).withColumnRenamed("node", "of")
    reached = classes.join(found, classes["node"] == found["of"], "left").select("fingerprint", "here", F.coalesce("component", "node").alias("class_id"))
    return join_counted(rows, reached, "fingerprint", "here", total).select("doc_id", "fingerprint", "class_id")


def op11_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_prints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
