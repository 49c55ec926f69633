"""Exact top-k search by inner product: columnar branch and bound.

Candidates lie dimension by dimension. Scores grow block by block of dimensions; after each
block, what is left of a candidate and of the query bounds what their score can still become,
candidates that cannot reach the k best any more are dropped, and the rest moves together.
Components are whole numbers, floor(256 x), so that sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.common import small_batches

#: Candidates of a block in memory, and dimensions of a step.
BLOCK, STEP = 8192, 8
#: Queries that one task holds, about, and of those the ones that are scored at once.
QUERIES, AT_ONCE = 32_768, 1024
#: Candidates that one task reads, about; they pass by in blocks, and what is held doesn't grow with them.
CANDIDATES = 4_000_000
#: Sums up to here are exact as doubles.
EXACT = 1 << 53


def quantised(column: str):
    """Components as whole numbers; null for vectors that take no part: null, or holding null, NaN or infinity. Components beyond a long become the nearest long."""
    v = F.col(column)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.lit(-(2.0**63)), F.least(F.lit(2.0**63 - 1024), x.cast("double") * 256)))
    return F.when(fine, F.transform(v, whole))


def to_matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), width)


def exact(a: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of a with each column, beyond what a double holds; what a long can't hold becomes the nearest long."""
    ends = np.iinfo(np.int64)
    sums = [sum(x * y for x, y in zip(a.tolist(), c.tolist(), strict=True)) for c in columns.T]
    return np.array([min(max(s, ends.min), ends.max) for s in sums], np.int64)


def best_of(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of at most k best candidates for each query.

    q: a query a row. c: a dimension a row, a candidate a column. Both whole. floor: for each query a score
    that k candidates of other blocks reach already; it is raised in place. Ties go to the smaller id.
    """
    n_dim = len(q[0])
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    # left[d]: the norm of what lies from dimension d on. Rounded up, since it bounds.
    c_left = np.sqrt(np.r_[np.cumsum((cf * cf)[::-1], axis=0)[::-1], np.zeros((1, c.shape[1]))]) * (1 + 1e-9)
    q_left = np.sqrt(np.c_[np.cumsum((qf * qf)[:, ::-1], axis=1)[:, ::-1], np.zeros(len(q))]) * (1 + 1e-9)
    large = np.abs(qf).max(initial=0) * np.abs(cf).max(initial=0) * n_dim >= EXACT
    out = []
    first = min(STEP * 2, n_dim)
    opening = qf[:, :first] @ cf[:first]
    for i in range(len(q)):
        part, alive, at = opening[i], None, first
        # The query itself may be among the candidates, and more than once.
        others = k + int((c_ids == q_ids[i]).sum())
        while True:
            room = q_left[i, at] * (c_left[at] if alive is None else c_left[at, alive])
            if large:
                room = room + 1e-9 * q_left[i, 0] * (c_left[0] if alive is None else c_left[0, alive])
            low = part - room
            if len(low) >= others:
                floor[i] = max(floor[i], np.partition(low, len(low) - others)[len(low) - others])
            keep = np.flatnonzero(part + room >= floor[i])
            alive = keep if alive is None else alive[keep]
            part = part[keep]
            if at >= n_dim or not len(alive):
                break
            to = min(at + STEP, n_dim)
            part = part + qf[i, at:to] @ cf[at:to, alive]
            at = to
        other = c_ids[alive] != q_ids[i]
        alive = alive[other]
        score = exact(q[i], c[:, alive]) if large else part[other].astype(np.int64)
        order = np.lexsort((c_ids[alive], ~score))[:k]
        if len(order) == k and not large:
            floor[i] = max(floor[i], score[order[-1]])
        out.append((np.full(len(order), i), alive[order], score[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k vectors of the highest scores, itself excepted.

    queries and vectors have the same columns. The score is the inner product of the components
    as whole numbers. Ties go to the smaller id; a query with fewer other vectors has fewer rows. Vectors
    that are null, hold null or non-finite components, or have a null id take no part; vectors are
    compared with those of their own length only, and an empty vector scores 0. Rows that repeat an id
    are vectors of their own, but none is the answer to a query with its id; a repeated query is answered once.
    A score beyond a long is shown as the nearest long, and such scores are picked by what they
    truly are, then shown as ties.

    Queries are dealt into blocks and candidates into parts, and a task answers one block from one part:
    queries are copied to each part, candidates to each block. The best k of each part come together by query.
    The plan is the same for any number of queries; nothing but counts gets to the driver.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    cand = vectors.select(F.col(key).cast("long").alias("id"), quantised(column).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(key).cast("long").alias("id"), quantised(column).alias("v")).where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // QUERIES))
    parts = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks), -(-vectors.count() // CANDIDATES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    rows = asked.select(mine(blocks, 1).alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), "id", "v")
    rows = rows.unionByName(cand.select(every(blocks).alias("block"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "v"))
    dealt = rows.repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, search = None, None
        for batch in batches:
            groups = np.stack([batch.column(c).to_numpy() for c in range(3)])
            starts = np.flatnonzero(np.r_[True, (groups[:, 1:] != groups[:, :-1]).any(0)]) if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                block, part, kind = groups[:, a].tolist()
                if (block, part) != held_group:
                    if search:
                        yield search.found()
                    held_group, search = (block, part), _Search(k)
                some = batch.slice(a, b - a)
                (search.compare if kind else search.ask)(np.asarray(some.column(3)), some.column(4))
        if search:
            yield search.found()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Search:
    """One block of queries, of any dimensions, and its k best candidates so far."""

    def __init__(self, k: int):
        self.k = k
        self.queries: dict[int, list] = {}  # by dimension: ids, vectors
        self.ready: dict[int, tuple] = {}

    def ask(self, ids: np.ndarray, v: pa.ListArray) -> None:
        lengths = np.asarray(v.value_lengths())
        for d in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == d)
            self.queries.setdefault(d, []).append((ids[own], to_matrix(v.take(pa.array(own)), d)))

    def compare(self, ids: np.ndarray, v: pa.ListArray) -> None:
        lengths = np.asarray(v.value_lengths())
        for d in np.unique(lengths).tolist():
            if d not in self.queries:
                continue
            if d not in self.ready:
                q_ids, q = (np.concatenate(x) for x in zip(*self.queries[d], strict=True))
                self.ready[d] = q_ids, q, np.full(len(q_ids), -np.inf), []
            q_ids, q, floor, found = self.ready[d]
            own = np.flatnonzero(lengths == d)
            for at in range(0, len(own), BLOCK):
                some = own[at : at + BLOCK]
                c_ids = ids[some]
                c = np.ascontiguousarray(to_matrix(v.take(pa.array(some)), d).T)
                for a in range(0, len(q), AT_ONCE):
                    b = a + AT_ONCE
                    if d:
                        i, j, s = best_of(q[a:b], q_ids[a:b], c, c_ids, self.k, floor[a:b])
                    else:
                        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(q_ids[a:b])), np.sort(np.argsort(c_ids)[: self.k + 1]), indexing="ij"))
                        other = q_ids[a:b][i] != c_ids[j]
                        i, j = i[other], j[other]
                        s = np.zeros(len(i), np.int64)
                    found.append((i + a, c_ids[j], s))
                if len(found) > 8 * -(-len(q) // AT_ONCE):
                    found[:] = self.best(found)

    def best(self, found: list) -> list:
        """The k best for each query so far, in one piece."""
        i, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((c, ~s, i))
        i, c, s = i[order], c[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
        return [(i[rank < self.k], c[rank < self.k], s[rank < self.k])]

    def found(self) -> pa.RecordBatch:
        rows = [(q_ids[i], c, s) for q_ids, _, _, found in self.ready.values() if found for i, c, s in self.best(found)]
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
