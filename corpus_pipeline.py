"""From the documents table to token ids: quality, exact and near duplicates, mixing, encoding.

STAGES are applied in turn, each to all that the one before it kept. All but the last return the
columns of documents. Every stage takes (spark, docs, sf_dir); only the classifier reads sf_dir,
for its labels. Nulls, empty texts, repeated rows and empty tables are met as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm import byte_bpe, exact_dedup, mixing, near_copies, quality
from lagloom.llm.common import delete, shared_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold of the classifier."""
    scored = quality.score_column(quality.train_quality(spark, sf_dir), spark)
    return docs.where(scored(F.col("text")) >= quality.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "digests"))
    kept = exact_dedup.keep_first(docs, index)
    index.remove()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more, over shingles of five words, connect the one with the smallest doc_id.

    Candidates are what SimHash links, as in op8, over those shingles; MinHash bands add what its links miss. All are checked exactly.
    """
    return near_copies.keep_one(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none to three times."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, a row for each document of the mix."""
    coder = byte_bpe.public_coder(spark)
    return byte_bpe.digests(coder.round_trip(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near-dedup by shingles", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can express neither the training of the classifier nor the pseudorandom mix; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage keeps is written to the shared folder and read again, and deleted once the next stage's rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{n}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    return docs
