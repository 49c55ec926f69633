"""Ranked lexical search over a bit-sliced impact index.

Documents lie in blocks of bounded size. For each term of a block there is an impact for each document
that holds it, and the impacts' bits lie in slices: bitmaps over the block's documents, one for each bit, of
which only words that hold a document are kept. A question adds its terms' slices by bitwise carry
arithmetic, a full adder for all documents at once. Its best documents are found from the most significant slice of
the sums down: documents with the bit come before those without it, until as many as asked for are left.

Tasks read documents where they lie and emit postings of the terms that are asked for. Counts of terms and
documents are sums over postings. Postings move once, to groups of blocks; questions are copied to each
group. A group gives its best documents of each question, and a window ranks those of all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.common import cut, small_batches

#: A block has at most so many documents, and is closed once it has so many postings.
BLOCK, POSTINGS = 8192, 2_000_000
#: Questions that a group of blocks answers at once, at most.
QUESTIONS = 1024
#: Bytes of the terms asked for up to which tasks get them all; beyond, postings of all terms are made and joined with them.
VOCABULARY = 32_000_000
#: Rows of text worked on at once.
ROWS = 1024

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32
_BYTES[65:91] += 32

_WORD_BITS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, code, terms): the row and the code of each term in the texts, in order, and the term of each code.

    Terms are runs of ASCII letters and digits and of all that isn't ASCII, with A-Z lower-cased.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)]) if data is not None and data.size else pa.py_buffer(b"")
    # Spaces are the only white space left, and no byte of another character is one.
    lists = pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), offsets, folded, offset=texts.offset), " ")
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    coded = lists.flatten().dictionary_encode()
    code, terms = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    filled = np.array([t != "" for t in terms], bool)[code] if terms else np.zeros(0, bool)
    return row[filled], code[filled].astype(np.int64), terms


class _Block:
    """Postings of the documents that a task has read since its last block."""

    def __init__(self, wanted: dict[str, int] | None):
        self.wanted = wanted
        self.number = 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.parts, self.docs, self.postings = [], [], [], 0, 0
        # Without wanted terms, all are numbered as they come.
        self.numbers = self.wanted if self.wanted is not None else {}

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        row, code, terms = terms_of(texts)
        self.ids.append(ids)
        self.lengths.append(np.bincount(row, minlength=len(texts)))
        if self.wanted is None:
            number = np.array([self.numbers.setdefault(t, len(self.numbers)) for t in terms], np.int64)
        else:
            number = np.array([self.wanted.get(t, -1) for t in terms], np.int64)
        if len(terms):
            of = number[code]
            row, of = row[of >= 0], of[of >= 0]
            both, times = np.unique(of * len(texts) + row, return_counts=True)
            self.parts.append((both // len(texts), both % len(texts) + self.docs, times))
            self.postings += len(both)
        self.docs += len(texts)

    def rows(self, partition: int) -> Iterator[pa.RecordBatch]:
        """block, term, at, tf, ids, n: a row for the documents, with a null term, and one for each term."""
        if not self.docs:
            return
        block = (partition << 32) + self.number
        ids = pa.concat_arrays(self.ids)
        n = np.concatenate(self.lengths)
        yield _batch([block], [None], pa.array([0, 0]), [[], []], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([n], pa.list_(pa.int64())))
        if self.parts:
            term, at, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.lexsort((at, term))
            term, at, times = term[order], at[order], times[order]
            names = list(self.numbers)  # numbered in their order
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(term)]
            for a in range(0, len(starts), ROWS):
                lo, hi = starts[a], ends[min(a + ROWS, len(starts)) - 1]
                offsets = pa.array(np.r_[starts[a : a + ROWS], hi] - lo, pa.int32())
                count = len(offsets) - 1
                nothing = lambda kind: pa.array([None] * count, pa.list_(kind))
                yield _batch([block] * count, [names[t] for t in term[starts[a : a + ROWS]].tolist()], offsets, [at[lo:hi], times[lo:hi]], nothing(ids.type), nothing(pa.int64()))
        self.number += 1
        self.clear()


def _batch(block: list, term: list, offsets: pa.Array, lists: list, ids: pa.Array, n: pa.Array) -> pa.RecordBatch:
    at, tf = (pa.ListArray.from_arrays(offsets.cast(pa.int32()), pa.array(x, k)) for x, k in zip(lists, (pa.int32(), pa.int64()), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(term, pa.string()), at, tf, ids, n], ["block", "term", "at", "tf", "ids", "n"])


def postings(docs: DataFrame, wanted: list[str] | None, most: int = BLOCK) -> DataFrame:
    """block, term, at, tf for each term of a block: which of its documents hold it, and how often.

    The row of a block whose term is null has ids and n instead: its documents' ids, and how many terms each has.
    wanted: the terms that count, all if None. most: documents of a block. Blocks are made where the documents lie; nothing is shuffled.
    """
    numbers = None if wanted is None else {t: i for i, t in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, partition, rows = _Block(numbers), TaskContext.get().partitionId(), min(ROWS, most)
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                block.add(part.column(0), part.column(1))
                if block.docs > most - rows or block.postings >= POSTINGS:
                    yield from block.rows(partition)
        yield from block.rows(partition)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"block long, term string, at array<int>, tf array<long>, ids array<{kind}>, n array<long>")


def question_terms(items: DataFrame, key: str) -> DataFrame:
    """key, term, times: how often each term comes in an item. Rows that repeat a key are one item, with the terms of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                row, code, terms = terms_of(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(terms, pa.string()).take(pa.array(code))], ["key", "term"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, "text").mapInArrow(run, f"key {kind}, term string").groupBy("key", "term").agg(F.count("*").alias("times"))


class BlockIndex:
    """The slices of one block: for each term the words that hold a document of it, and in each word the bits of the impacts."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, m: np.ndarray):
        self.ids, self.null, self.n, self.m = ids, null, n, m
        self.words = -(-len(n) // 64)
        self.parts: list[tuple] = []
        self.terms: dict[int, tuple] = {}

    def add(self, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray) -> None:
        """Postings of several terms (numbers), of so many documents each."""
        impact = np.repeat(weights, sizes) * ((1_000_000_000 * tf) // (1000 * tf + 12 * self.m[at]))
        self.parts.append((np.repeat(terms, sizes), at.astype(np.int64), impact))

    def slice_up(self) -> None:
        """Makes the slices of all postings, a word after another."""
        if not self.parts:
            return
        term, at, impact = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        place = term * self.words + (at >> 6)
        if (place[1:] < place[:-1]).any():
            order = np.argsort(place, kind="stable")
            term, at, impact, place = term[order], at[order], impact[order], place[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        bit = _WORD_BITS[at & 63]
        width = max(1, int(impact.max()).bit_length())
        slices = np.empty((len(starts), width), np.uint64)
        for b in range(width):
            slices[:, b] = np.bitwise_or.reduceat(np.where((impact >> b) & 1, bit, np.uint64(0)), starts)
        of, word = term[starts], at[starts] >> 6
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
            own = slices[a:z]
            used = np.flatnonzero(own.any(0))
            own = own[:, : used[-1] + 1] if len(used) else own[:, :0]
            self.terms[int(of[a])] = (word[a:z], own)

    def sums(self, terms: list[tuple[int, int]]) -> np.ndarray | None:
        """Slices of the scores, a row for each bit from the lowest, of a question's (term, times); None if no document has a term."""
        found = [(*self.terms[t], times) for t, times in terms if t in self.terms]
        if not found:
            return None
        width = sum((1 << s.shape[1]) * times for _, s, times in found).bit_length()
        # Sums without their carries, and the carries, a row for each word.
        total, carry = (np.zeros((self.words, width), np.uint64) for _ in range(2))
        for word, own, times in found:
            for e in range(times.bit_length()):
                if times >> e & 1 and own.shape[1]:
                    x = np.zeros((len(word), width), np.uint64)
                    x[:, e : e + own.shape[1]] = own
                    s, c = total[word], carry[word]
                    half = s ^ c
                    total[word] = half ^ x
                    up = (s & c) | (half & x)
                    carry[word, 1:] = up[:, :-1]
                    carry[word, 0] = 0
        total, carry = np.ascontiguousarray(total.T), np.ascontiguousarray(carry.T)
        through = np.zeros(self.words, np.uint64)
        for b in range(width):
            s, c = total[b], carry[b]
            half = s ^ c
            total[b], through = half ^ through, (s & c) | (half & through)
        return total

    def best(self, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best of this block with a score above 0; of equal scores those of the smallest ids."""
        sure, open_ = np.zeros(self.words, np.uint64), np.bitwise_or.reduce(sums, axis=0)
        for s in sums[::-1]:
            with_ = open_ & s
            n = int(np.bitwise_count(sure | with_).sum())
            if n > k:
                open_ = with_
            else:
                sure, open_ = sure | with_, open_ & ~s
                if n == k:
                    open_ = np.zeros_like(open_)
                    break
        docs, ties = self._documents(sure), self._documents(open_)
        # What is open now has one score: all bits are compared.
        if len(ties):
            order = np.lexsort((self.ids[ties], ~self.null[ties]))
            docs = np.concatenate([docs, ties[order[: k - len(docs)]]])
        word, bit = docs >> 6, (docs & 63).astype(np.uint64)
        scores = np.zeros(len(docs), np.int64)
        for b, s in enumerate(sums):
            scores |= ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << b
        return docs, scores

    def _documents(self, mask: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(mask.astype("<u8").view(np.uint8), bitorder="little"))


class _Group:
    """The questions that a group of blocks answers, and their best documents so far."""

    def __init__(self, k: int, n: int, terms: int):
        self.k, self.n, self.total = k, n, max(terms, 1)
        self.numbers: dict[str, int] = {}
        self.weights: list[int] = []
        self.questions: list[tuple] = []
        self.found: list[list] = []
        self.block = None

    def ask(self, key, terms: list[str], times: list[int], weights: list[int]) -> None:
        own = []
        for term, q, w in zip(terms, times, weights, strict=True):
            t = self.numbers.setdefault(term, len(self.weights))
            if t == len(self.weights):
                self.weights.append(w)
            own.append((t, q))
        self.questions.append((key, own))
        self.found.append([])

    def open(self, ids: pa.Array, n: np.ndarray) -> None:
        self.close()
        null = np.asarray(ids.is_null())
        m = 100 - 25 + (25 * n * self.n) // self.total
        self.block = BlockIndex(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null, n, m)

    def add(self, terms: list[str], at: pa.ListArray, tf: pa.ListArray) -> None:
        number = np.array([self.numbers.get(t, -1) for t in terms], np.int64)
        known = np.flatnonzero(number >= 0)
        if len(known):
            mask = pa.array(known)
            at, tf = at.take(mask), tf.take(mask)
            weights = np.array(self.weights, np.int64)[number[known]]
            self.block.add(number[known], weights, np.asarray(at.value_lengths()), np.asarray(at.flatten()), np.asarray(tf.flatten()))

    def close(self) -> None:
        """Asks the open block all questions."""
        if self.block is None:
            return
        block, self.block = self.block, None
        block.slice_up()
        for (_, terms), found in zip(self.questions, self.found, strict=True):
            sums = block.sums(terms)
            if sums is not None:
                docs, scores = block.best(sums, self.k)
                found.append((block.ids[docs], block.null[docs], scores))
                if len(found) > 16:
                    found[:] = [self.best(found)]

    def best(self, found: list) -> tuple:
        ids, null, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, ~null, -scores))[: self.k]
        return ids[order], null[order], scores[order]

    def answers(self, kinds: list[pa.DataType]) -> pa.RecordBatch:
        self.close()
        rows = [(key, *self.best(found)) for (key, _), found in zip(self.questions, self.found, strict=True) if found]
        keys = pa.array([r[0] for r in rows for _ in r[1]], kinds[0])
        ids, null, scores = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, t) for i, t in ((1, np.int64), (2, bool), (3, np.int64)))
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, mask=null).cast(kinds[1]), pa.array(scores)], ["key", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, key: str = "item_id", k: int = 20, block: int = BLOCK) -> DataFrame:
    """key, rank (from 1), doc_id, score: for each item its k best documents with a score above 0.

    docs: doc_id (a whole number), text; items: key, text. A document's score sums over the item's terms, repeats
    included, w * ((1000000000 tf) div (1000 tf + 12 m)): w falls with the documents that hold the term, m
    grows with the document's length. Equal scores go by ascending doc_id, null first. An item with fewer
    such documents has fewer rows, one without terms (null or empty text) has none. Rows that repeat a doc_id are
    documents of their own; rows that repeat an item's key are one item. Empty tables give no rows. Other columns
    aren't read. Texts of any length count whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = cut(question_terms(items, key))
    count = asked.groupBy("term").count().agg(F.coalesce(F.sum(F.octet_length("term") + 60), F.lit(0)), F.count("*")).first()
    wanted = [r.term for r in asked.select("term").distinct().collect()] if count[0] <= VOCABULARY else None
    rows = postings(docs, wanted, block)
    if wanted is None:
        rows = rows.join(asked.select(F.col("term").alias("_t")).distinct(), F.col("term") == F.col("_t"), "left").where("term is null or _t is not null").drop("_t")
    rows = cut(rows)

    sums = rows.where("term is null").select(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"), F.size(F.filter("n", lambda x: x > 0)).alias("some"))
    n, total, blocks = sums.agg(F.coalesce(F.sum("some"), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0)), F.count("*")).first()
    df = rows.where("term is not null").groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df.select("term", weight.alias("w")), "term")
    questions = cut(weighted.groupBy("key").agg(F.collect_list(F.struct("term", "times", "w")).alias("terms")))
    chunks = max(1, -(-questions.count() // QUESTIONS))
    groups = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    chunk = F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")
    # Blocks are numbered within the task that made them: so dealt, groups have about as many each.
    group = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)) * 7919, F.lit(groups)).cast("int")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    key_kind = items.schema[key].dataType.simpleString()

    no = lambda name, kind: F.lit(None).cast(kind).alias(name)
    ask = questions.select(
        chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("kind"), "key",
        F.col("terms.term").alias("terms"), F.col("terms.times").alias("times"), F.col("terms.w").alias("w"), no("term", "string"), no("at", "array<int>"), no("tf", "array<long>"), no("ids", f"array<{id_kind}>"), no("n", "array<long>"),
    )
    if chunks == 1:
        dealt = rows.withColumn("chunk", F.lit(0))
    else:
        terms = questions.select(chunk.alias("chunk"), F.explode("terms.term").alias("_t")).distinct()
        held_ = rows.where("term is not null").join(terms, F.col("term") == F.col("_t")).drop("_t")
        dealt = held_.unionByName(rows.where("term is null").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    tell = dealt.select(
        "chunk", group.alias("group"), "block", F.when(F.col("term").isNull(), 1).otherwise(2).alias("kind"), no("key", key_kind),
        no("terms", "array<string>"), no("times", "array<long>"), no("w", "array<long>"), "term", "at", "tf", "ids", "n",
    )
    order = ["chunk", "group", "block", "kind"]
    moved = ask.unionByName(tell).repartitionById(chunks * groups, F.col("chunk") * groups + F.col("group")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here, types = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(4).type, batch.column(11).type.value_type]
            places = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(4)])
            new = np.r_[True, (places[:, 1:] != places[:, :-1]).any(0)]
            new |= places[3] < 2  # questions and documents come one by one
            starts = np.flatnonzero(new).tolist()
            for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                own, kind = tuple(places[:2, a].tolist()), places[3, a]
                if own != at:
                    if here:
                        yield here.answers(types)
                    at, here = own, _Group(k, n, total)
                if kind == 0:
                    here.ask(*[batch.column(c)[a].as_py() for c in range(4, 8)])
                elif kind == 1:
                    here.open(batch.column(11)[a].values, np.asarray(batch.column(12)[a].values))
                else:
                    part = batch.slice(a, z - a)
                    here.add(part.column(8).to_pylist(), part.column(9), part.column(10))
        if here:
            yield here.answers(types)

    found = moved.mapInArrow(run, f"key {key_kind}, doc_id {id_kind}, score long")
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("key").alias(key), "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
), c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, big_n
), s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
