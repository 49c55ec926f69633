"""Language of texts and of their parts.

Each word gets a score for each language, the log-likelihood of its character n-grams; the
script of the word narrows the languages that compete. The Viterbi algorithm finds the labels
of all words that score best together, with a penalty for each switch of language, and so
splits texts of mixed languages into spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.common import held, sample_rows, small_batches, text_key

ROWS = 256
#: Words whose scores a Python worker keeps; a full cache is emptied.
CACHE = 200_000
#: Characters of a word that are scored at once; longer words are scored piece by piece, whole.
PIECE = 100_000
NONE = "und"

# First code points of script ranges. Between them stands no script (0).
SCRIPTS = [
    (0x0041, "Latin"), (0x0250, "IPA"), (0x0300, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C00, ""), (0x3040, "Kana"),
    (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"), (0xA000, "Yi"), (0xA4D0, ""),
    (0xAC00, "Hangul"), (0xD800, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, ""), (0xFB50, "Arabic"),
    (0xFE00, ""), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x323B0, ""),
]
_NAMES = ["", *sorted({n for _, n in SCRIPTS if n})]
_FROM = np.array([a for a, _ in SCRIPTS])
_CODE = np.array([0, *[_NAMES.index(n) for _, n in SCRIPTS]])

_WORD = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3, 4)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower())


def scripts_of(words: list[str]) -> np.ndarray:
    """The number of the script of each word's first letter."""
    return _CODE[np.searchsorted(_FROM, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), "right")]


def grams_of(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, by order and place; which of them count; and where words begin.

    Words stand between marks, which belong to their n-grams.
    """
    joined = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(joined == 2)
    lengths = np.diff(np.r_[starts, len(joined)])
    room = np.repeat(starts + lengths, lengths) - np.arange(len(joined))
    hashed, buckets, counts = np.zeros(len(joined), np.uint64), [], []
    for order in range(1, max(ORDERS) + 1):
        moved = np.r_[joined[order - 1 :], np.zeros(min(order - 1, len(joined)), np.uint32)][: len(joined)].astype(np.uint64)
        hashed = (hashed + moved + np.uint64(order)) * _MULTIPLIER
        hashed ^= hashed >> np.uint64(31)
        if order in ORDERS:
            buckets.append((hashed >> np.uint64(64 - bits)).astype(np.int64))
            counts.append((room >= order) & ((joined > 3) if order == 1 else True))
    return np.stack(buckets), np.stack(counts), starts


@dataclass
class Model:
    """languages in code-point order; weights: log-likelihood of a bucket for each; uses: which script may be which language's."""

    languages: list[str]
    bits: int
    weights: np.ndarray
    uses: np.ndarray
    penalty: float = 12.0
    known: dict = field(default_factory=dict, repr=False)
    scores: np.ndarray = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "scores": None}

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log-likelihood by language, far less for languages that its script rules out."""
        rows, at = [], 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= PIECE):
                size += len(words[end])
                end += 1
            buckets, counts, starts = grams_of(words[at:end], self.bits)
            total = np.zeros((buckets.shape[1], len(self.languages)))
            for b, c in zip(buckets, counts, strict=True):
                total += self.weights[b] * c[:, None]
            rows.append(np.add.reduceat(total, starts, axis=0))
            at = end
        scores = np.concatenate(rows) / len(ORDERS)
        may = self.uses[scripts_of(words)]
        may[~may.any(1)] = True
        low = np.where(may, scores, np.inf).min(1, keepdims=True) - 2 * self.penalty
        return np.where(may, scores, np.minimum(scores, low))

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Scores of words, by the cache."""
        new = list(set(words) - self.known.keys())
        if self.scores is None or len(self.known) + len(new) > CACHE:
            new = list(set(words))
            self.known.clear()
            self.scores = np.zeros((max(CACHE, len(new)), len(self.languages)))
        if new:
            self.scores[len(self.known) : len(self.known) + len(new)] = self.score_words(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best labels of a run of words: most score, less a penalty for each switch."""
        best = int(scores.sum(0).argmax())
        # A path with k spans of other languages has k - 1 switches at least, k if it visits the best
        # language. If no span gains more than half a penalty over the best language, none pays.
        total = np.cumsum(np.r_[np.zeros((1, scores.shape[1])), scores - scores[:, best : best + 1]], axis=0)
        if (total - np.minimum.accumulate(total, axis=0)).max() <= self.penalty / 2:
            return np.full(len(scores), best)
        return self.viterbi(scores)

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        back, came = [], np.zeros(len(scores), np.int64)
        now = [0.0] * scores.shape[1]
        for row in scores.tolist():
            top = max(now)
            leader, floor = now.index(top), top - self.penalty
            back.append((leader, [v < floor for v in now]))
            now = [(v if v >= floor else floor) + s for v, s in zip(now, row, strict=True)]
        label = now.index(max(now))
        for t in range(len(scores) - 1, -1, -1):
            came[t] = label
            leader, switched = back[t]
            if switched[label]:
                label = leader
        return came

    def read(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text its language, the share of its letters that are in it, and its spans (start, end, language).

        Spans cover the text from the first character to the last. A text that is null or without
        letters has language `und`, score 0 and no spans. Of languages with as many letters, the
        first in code-point order is taken.
        """
        words = [words_of(t) if t and self.languages else [] for t in texts]
        words = [w if all(map(str.isalpha, w)) else [x for x in w if any(map(str.isalpha, x))] for w in words]
        ends = np.cumsum([len(w) for w in words])
        scores = self.rows_of([x for w in words for x in w])
        out = []
        for text, own, end in zip(texts, words, ends.tolist(), strict=True):
            if not own:
                out.append((NONE, 0.0, []))
                continue
            label = self.path(scores[end - len(own) : end])
            letters = np.bincount(label, np.fromiter(map(len, own), np.float64, len(own)), len(self.languages))
            best = int(letters.argmax())
            turns = np.flatnonzero(label[1:] != label[:-1]) + 1
            spans = [(0, len(text), self.languages[label[0]])]
            if len(turns):
                places = [m.start() for m in _WORD.finditer(text) if any(map(str.isalpha, m[0]))]
                if len(places) == len(own):  # lower-casing may part words, seldom
                    cuts = [0, *[places[t] for t in turns], len(text)]
                    spans = [(a, b, self.languages[label[t]]) for a, b, t in zip(cuts[:-1], cuts[1:], [0, *turns], strict=True)]
            out.append((self.languages[best], float(letters[best] / letters.sum()), spans))
        return out


def train(labelled: DataFrame, most: int = 1000, bits: int = 16, penalty: float = 12.0) -> Model:
    """A model from labelled (doc_id, text, lang).

    It learns from at most `most` different rows of each language with a text, those with the smallest
    hashes. Without any rows it knows no language, and every text is `und`. N-grams are counted where the rows are and summed by Spark; the driver gets one number for
    each language and bucket, and for each language and script.
    """
    chosen = sample_rows(labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang"), most, "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.setdefault(lang, []).extend(words_of(text))
            for lang, words in rows.items():
                found = np.zeros((1 << bits) + len(_NAMES), np.int64)
                for at in range(0, len(words), 20_000):
                    part = words[at : at + 20_000]
                    buckets, counts, _ = grams_of(part, bits)
                    found[: 1 << bits] += np.bincount(buckets[counts], minlength=1 << bits)
                    found[1 << bits :] += np.bincount(scripts_of(part), minlength=len(_NAMES))
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(found[at])], ["lang", "bucket", "n"])

    got = chosen.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(got["lang"]))
    table = np.zeros(((1 << bits) + len(_NAMES), max(1, len(languages))))
    for i, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        table[own["bucket"].to_numpy(dtype=np.int64), i] = own["n"].to_numpy(dtype=float)
    grams, scripts = table[: 1 << bits] + 0.5, table[1 << bits :]
    uses = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    return Model(languages, bits, np.log(grams / grams.sum(0)), uses, penalty)


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans (array of start, end, lang, in characters) of every row of docs.

    Whole texts are read; no column but doc_id and text is. Repeated rows have a row each; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = shared.value.read(part.column(1).to_pylist())
                spans = [[{"start": a, "end": b, "lang": x} for a, b, x in s] for _, _, s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")


def held_out(column: str = "doc_id"):
    return text_key(column) % 4 == 2


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return label_spans(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
