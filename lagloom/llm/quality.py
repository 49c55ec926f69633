"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is read in two ways: as its words (lower-cased) and as their shapes (letters in lower
case, upper case or mixed, numbers, signs by their kind, and whether a word repeats the one
before). N-grams of both are hashed into buckets; the value of a bucket is its share of the
text's n-grams. A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.byte_bpe import slices
from lagloom.llm.common import held, sample_rows, small_batches, text_key

#: Bytes of text worked on at once.
SLICE = 1_000_000
#: Entries of the cache of word hashes of a Python worker; a full cache is emptied.
CACHE = 100_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word to (hash of the word << 32 | hash of its shape)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        if word.isalpha():
            shape = "x" if word.islower() else "X" if word.isupper() else "Xx" if word[1:].islower() else "xX"
        elif word[0].isalnum() or word[0] == "_":
            shape = "9" if word.isdigit() else "a9"
        else:
            shape = word[:4]
        value = zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(shape.encode())
        if len(word) <= 64:
            self[word] = value
        return value




def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list of texts: buckets, values and, for each text, where its own begin (one more at the end).

    Words and pairs of words, pairs and triples of shapes; a text's values add up to 1. Long texts
    are read whole. A text without words has no buckets.
    """
    known = held("quality words", _Words)
    words = [_TOKEN.findall(t) if t else [] for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.r_[0, np.cumsum(n)]
    both = np.fromiter((v for w in words for v in map(known.__getitem__, w)), np.uint64, first[-1])
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    starts = np.zeros(len(both) + 1, bool)
    starts[first] = True
    starts = starts[:-1]
    before = np.r_[np.uint64(0), word[:-1]][: len(word)]
    before[starts] = 0
    shape = shape * np.uint64(2) + (word == before).astype(np.uint64)
    shape1 = np.r_[np.uint64(1), shape[:-1]][: len(shape)]
    shape1[starts] = 1
    shape2 = np.r_[np.uint64(1), shape1[:-1]][: len(shape)]
    shape2[starts] = 1
    with np.errstate(over="ignore"):
        pair = (word + np.uint64(7)) * _MIX + before
        shapes = (shape + np.uint64(11)) * _MIX + shape1
        grams = [word + np.uint64(1 << 40), pair, shapes, (shapes + np.uint64(13)) * _MIX + shape2]
        buckets = np.stack([(g * _MIX) >> np.uint64(64 - bits) for g in grams], axis=1).reshape(-1)
    values = np.repeat(1.0 / np.maximum(n, 1) / len(grams), n * len(grams))
    return buckets.astype(np.int64), values, first * len(grams)


@dataclass
class FTRL:
    """Per-coordinate follow-the-regularised-leader for logistic loss. scale multiplies all values."""

    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    scale: float = 40.0
    z: np.ndarray = field(default=None, repr=False)
    n: np.ndarray = field(default=None, repr=False)

    def __post_init__(self):
        # The last coordinate is the constant.
        self.z = np.zeros((1 << self.bits) + 1)
        self.n = np.zeros((1 << self.bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        """One step. buckets without repeats."""
        at, x = np.r_[buckets, len(self.z) - 1], np.r_[values * self.scale, 1.0]
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


@dataclass
class Model:
    bits: int
    scale: float
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        """From 0 to 1, each text summed by itself, so that its neighbours have no say. A null or empty text gets the score of the constant alone."""
        buckets, values, first = features(texts, self.bits)
        first = np.asarray(first, np.int64)
        some = first[1:] > first[:-1]
        sums = np.zeros(len(some))
        if some.any():
            sums[some] = np.add.reduceat(self.weights[buckets] * values, first[:-1][some])
        return 1 / (1 + np.exp(-np.clip(sums * self.scale + self.weights[-1], -35, 35)))


def train(labelled: DataFrame, most: int = 6000, epochs: int = 4, bits: int = 18) -> Model:
    """A model from labelled (doc_id, text, label 0 or 1), from at most `most` different rows, those with the smallest hashes.

    Rows with a null label are left out; with no rows at all every score is 0.5.
    """
    return learn_from(sample_rows(labelled.where("label is not null").select("doc_id", "text", "label"), most), epochs, bits)


def learn_from(chosen: DataFrame, epochs: int = 4, bits: int = 18) -> Model:
    """A model from all rows of chosen (at, text, label), of which there must be a bounded number.

    Features are computed where the rows are; one task learns from them in the order of `at`, and the
    driver gets the 2**bits weights.
    """

    small_batches(chosen.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(1), SLICE):
                part = batch.slice(at, end - at)
                buckets, values, first = features(part.column(1).to_pylist(), bits)
                ids, weights = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own, counts = np.unique(buckets[a:b], return_counts=True)
                    ids.append(own.astype(np.int32))
                    weights.append((counts * (values[a] if b > a else 0)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], ["at", "label", "buckets", "values"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i in range(batch.num_rows):
                rows.append((batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy(), batch.column(1)[i].as_py()))
        model = FTRL(bits)
        for _ in range(epochs):
            for buckets, values, label in rows:
                model.learn(buckets, values, label)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["bucket", "weight"])

    found = chosen.select("at", "text", F.col("label").cast("int").alias("label")).mapInArrow(extract, "at long, label int, buckets array<int>, values array<float>")
    got = found.repartition(1).sortWithinPartitions("at", "label").mapInArrow(learn, "bucket int, weight double").toPandas()
    weights = np.zeros((1 << bits) + 1)
    weights[got["bucket"].to_numpy(dtype=np.int64)] = got["weight"].to_numpy(dtype=float)
    return Model(bits, FTRL.scale, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs, repeated ones too; other columns are not read.

    A null text is scored like an empty one, a null doc_id stays null; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(1), SLICE):
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def score_column(model: Model, spark: SparkSession):
    """A function from a text column to its score, for use beside other columns."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.concat_arrays([pa.array(shared.value.score(part.slice(at, end - at).to_pylist())) for at, end in slices(part, SLICE)] or [pa.array([], pa.float64())])

    return scored


#: A text passes from this score on.
THRESHOLD = 0.3


def held_out(column: str = "doc_id"):
    return text_key(column) % 5 == 0


def train_quality(spark: SparkSession, sf_dir: str, most: int = 6000) -> Model:
    """Learns labels.quality from the documents table, but for the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where(~held_out()).where("label is not null")
    # Ids are chosen before any text is read. At most `most` rows, so the join may broadcast them.
    few = labels.select(F.xxhash64("doc_id").alias("at"), "doc_id", "label").orderBy("at", "doc_id", "label").limit(most).groupBy("at", "doc_id").agg(F.min("label").alias("label"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Of rows that repeat a doc_id the lowest text counts.
    return learn_from(docs.join(F.broadcast(few), "doc_id").groupBy("at", "doc_id", "label").agg(F.min("text").alias("text")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train_quality(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
