"""Exact deduplication against a persistent digest index.

The index is a few Parquet tables, its parts, each bucketed and sorted by digest: one row for each
text ever seen. A batch is reduced to (doc_id, digest); its groups are sort-merge anti-joined with
each part on the bucket column, so that the index isn't shuffled, nor sorted while a bucket is one file, and
what is new is added as a part in the same buckets. Texts never leave the scan: only ids and 32-byte
digests move.

    state-N.json    the parts that count, with the batch, buckets and rows of each; the highest N holds
    part-*          digest, keep_id, keep_row, group_size, batch

A part counts once a new state names it, which is one rename. A batch that failed has left
nothing that counts, and one that is run again takes the place of its own rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.common import cut, delete, file_names, fresh, join_counted, read_text, settings, shared_path, write_text

#: Rows of a bucket, about; a part has more buckets the more rows there are.
BUCKET_ROWS = 2_000_000
#: With more parts, all become one.
PARTS = 8
#: Spark takes the order of a bucket of one file for granted only so.
ORDERED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def normalised(text: str = "text"):
    """The text with every run of white space replaced by one space; null counts as empty."""
    # A lone space stands already as it should: only other runs are rewritten.
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest(text: str = "text"):
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A digest index at path, in a folder that all executors share. One batch at a time may be added.

    keep_id and keep_row of a text name the row that stays, which never changes once it is in the
    index; group_size counts the equal rows in the batch that brought the text. buckets: at least so
    many to a part, times a power of two.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def state(self) -> tuple[int, list[dict]]:
        """The number of the state that holds, and its parts: name, batch, buckets, rows."""
        numbers = [int(m[1]) for n in file_names(self.spark, self.path) if (m := re.fullmatch(r"state-(\d+)\.json", n))]
        return (max(numbers), json.loads(read_text(self.spark, f"{self.path}/state-{max(numbers)}.json"))) if numbers else (0, [])

    def _publish(self, number: int, parts: list[dict]) -> None:
        write_text(self.spark, f"{self.path}/state-{number}.json", json.dumps(parts))

    def _table(self, part: dict) -> str:
        return f"lagloom_digests_{hashlib.sha256(f'{self.path}/{part["name"]}'.encode()).hexdigest()[:16]}"

    def _part(self, part: dict) -> DataFrame:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table(part)} (digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT, batch STRING) "
            f"USING PARQUET CLUSTERED BY (digest) SORTED BY (digest) INTO {part['buckets']} BUCKETS LOCATION '{self.path}/{part['name']}'"
        )
        return self.spark.table(self._table(part))

    def _buckets_for(self, rows: int) -> int:
        n = self.buckets
        while n * BUCKET_ROWS < rows:
            n *= 2
        return n

    def _write(self, rows: DataFrame, batch: str, most: int) -> dict:
        """A part of rows that counts for nothing yet. most: as many rows at most."""
        part = {"name": f"part-{uuid.uuid4().hex}", "batch": batch, "buckets": self._buckets_for(most)}
        dealt = rows.repartition(part["buckets"], "digest").write.mode("overwrite").format("parquet")
        dealt.bucketBy(part["buckets"], "digest").sortBy("digest").option("path", f"{self.path}/{part['name']}").saveAsTable(self._table(part))
        return part | {"rows": self._part(part).count()}

    def read(self) -> DataFrame:
        """digest, keep_id, keep_row, group_size, batch of every text in the index."""
        found = self.spark.createDataFrame([], "digest binary, keep_id long, keep_row long, group_size long, batch string")
        for part in self.state()[1]:
            found = found.unionByName(self._part(part))
        return found

    def unknown(self, groups: DataFrame, parts: list[dict]) -> DataFrame:
        """The groups whose digest no part holds."""
        for part in parts:
            # Dealt as the part is, or else Spark would deal the part, if it has fewer buckets.
            groups = groups.repartition(part["buckets"], "digest").join(self._part(part).select("digest").hint("merge"), "digest", "left_anti")
        return groups

    def forget(self) -> None:
        """Drops the tables of this session that read the index, which itself stays."""
        for name in file_names(self.spark, self.path):
            if name.startswith("part-"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table({'name': name})}")

    def remove(self) -> None:
        """Deletes the index. Results of add() stay as they are."""
        self.forget()
        delete(self.spark, self.path)

    def compact(self) -> None:
        """Makes one part of all, with one sorted file a bucket, and removes what doesn't count."""
        number, parts = self.state()
        if len(parts) > 1:
            # Rows keep the batch that they came with, so that a batch may still be run again.
            merged = self._write(self.read(), "", sum(p["rows"] for p in parts))
            self._publish(number + 1, [merged])
            parts = [merged]
        named = {p["name"] for p in parts}
        number = self.state()[0]
        for name in file_names(self.spark, self.path):
            if (m := re.fullmatch(r"state-(\d+)\.json", name)) and int(m[1]) < number:
                delete(self.spark, f"{self.path}/{name}")
        for name in file_names(self.spark, self.path):
            if name.startswith("part-") and name not in named:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table({'name': name})}")
                delete(self.spark, f"{self.path}/{name}")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Enters docs (doc_id, text) and says of each row what becomes of it.

        Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs.
        Of equal texts in docs the row with the smallest doc_id stays, unless an earlier batch
        holds the text: then none does, keep_id names the earlier row, and group_size counts the
        rows of that batch and of this one.

        batch names the batch: one of a name that the index knows is run again, and gets what it got
        the first time, if its rows are the same. Without a name it is a new batch.

        A null text equals an empty one. A null doc_id sorts before all others. Rows repeated
        with the same doc_id are separate rows of the group, of which one is kept. An empty
        table gives an empty result. Other columns of docs are not read.
        """
        named, batch = batch is not None, batch or uuid.uuid4().hex
        rows = cut(docs.select("doc_id", digest().alias("digest")).withColumn("row", F.monotonically_increasing_id()))
        total = rows.count()
        groups = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("here"))
        groups = groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("here").alias("group_size"))
        number, parts = self.state()
        if named and any(p["batch"] in ("", batch) for p in parts):
            # Nothing is published yet: a state without the batch would let others decide about its texts.
            parts = self._without(batch, parts)
        if parts:
            groups = cut(groups)
        with settings(self.spark, ORDERED):
            part = self._write(self.unknown(groups, parts).withColumn("batch", F.lit(batch)), batch, total)
            self._publish(number + 1, [*parts, part])
            own = self._part(part).select("digest", F.col("group_size").alias("here"), "keep_id", "keep_row", F.col("group_size").alias("size"))
            for old in parts:
                here = groups.select("digest", F.col("group_size").alias("here")).repartition(old["buckets"], "digest")
                known = here.join(self._part(old).hint("merge"), "digest").select("digest", "here", "keep_id", F.lit(None).cast("long").alias("keep_row"), (F.col("group_size") + F.col("here")).alias("size"))
                own = own.unionByName(known)
            # Parts may go with a later batch: what they say is read now.
            own = cut(own)
        out = join_counted(rows, own, "digest", "here", total).select(
            "doc_id",
            "keep_id",
            F.col("size").cast("long").alias("group_size"),
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
        if len(parts) >= PARTS:
            self.compact()
        self.forget()
        return out

    def _without(self, batch: str, parts: list[dict]) -> list[dict]:
        """The parts without the rows of a batch that is run again. Of a part of several batches a new one is written, which counts for nothing yet."""
        left = []
        for p in parts:
            if p["batch"] == "" and not (found := self._part(p)).where(F.col("batch") == batch).isEmpty():
                left.append(self._write(found.where(F.col("batch") != batch), "", p["rows"]))
            elif p["batch"] != batch:
                left.append(p)
        return left


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that an index keeps, with all their columns.

    Of rows that repeat a doc_id and a text, one stays; a null text equals an empty one, and a null doc_id is one
    before all others. An empty table gives an empty one. Texts are shuffled once, by doc_id; only where doc_ids repeat
    are they hashed again and sorted.
    """
    id_, sha, n = fresh(docs, "__id", "__sha", "__n")
    found = cut(index.add(docs).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), "kept"))
    kept = found.where("kept").drop("kept")
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(kept[id_]))
    if found.groupBy(id_).count().where("count > 1").isEmpty():
        return joined.drop(id_, sha)
    joined = joined.where(F.sha2(normalised(), 256) == F.col(sha))
    once = Window.partitionBy(id_, sha).orderBy(id_)
    return joined.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).drop(id_, sha, n)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, shared_path(spark, "digests"))
    found = index.add(docs)
    index.remove()  # it served this one batch
    return found


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""
