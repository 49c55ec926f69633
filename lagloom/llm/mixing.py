"""Mixing sources to target weights, with DataFrame functions only.

The words of a source are one stream, its documents in a fixed order, packed into blocks of a
fixed number of words. A source gives as many draws of blocks as its target takes. For each output
shard the counts of the sources are drawn multinomially, with the sources' shares of all draws as
probabilities: each slot draws its source. Summed over all shards such counts miss the
targets a little, so they are reconciled: of a source that came out too often, as many draws as there are
too many, picked by its permutation, go to the sources that came out too seldom, in the order of
sources. The draws of a source, as they come in the shards, are mapped through its pseudorandom
permutation to places in its stream of blocks, by another permutation each time around, and blocks are
joined to documents by source and index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.common import WORD, cut, fresh, join_counted

#: No source is taken, and no document repeated, more often.
MOST = 3
#: Draws in a row whose sources are listed together, where a slot looks up what it has drawn.
RUN = 4096
#: Chunks of a source, or shards, over which one window sums.
GROUP = 4096
#: Documents of a chunk of a source's stream, about.
CHUNK = 1000
#: Parts of a copy that are carried on when copies are rounded.
PARTS = 1 << 20


def permuted(x, n, *key, rounds: int = 24):
    """The image of x in 0..n-1 (long columns) under a pseudorandom permutation that key chooses.

    Swap-or-not: in each round x is paired with k - x modulo n, and a bit that both of a pair
    share says whether they trade places. Any n will do.
    """

    def turn(at, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit("pair"), r, *key), n) - at, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(at, other), *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, turn)


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size and others, a row for each source) with weight and target (double).

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes by
    weight; a target is at most MOST times its source's size, and the rest is shared by the
    others in the same way. The targets of the sources that aren't held are all the same multiple of
    their weight: sources are held in the order of limit over weight, up to the first that needn't be.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    held = Window.orderBy(F.col("__limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__limit").over(held), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(held), F.lit(0)))
    return (
        sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
        .withColumn("__limit", F.col("source_size") * MOST)
        .withColumn("__level", level)
        .withColumn("__free", F.when(F.col("__level") * F.col("weight") <= F.col("__limit"), F.struct(F.col("__limit") / F.col("weight"), F.col("__level").alias("level"))))
        .withColumn("target", F.least(F.col("__limit").cast("double"), F.coalesce(F.min("__free").over(everything)["level"], F.lit(0.0)) * F.col("weight")))
        .drop("__limit", "__level", "__free")
    )


def running_sums(df: DataFrame, order: str, value: str, offset: str) -> DataFrame:
    """df (key, order, value and others; order counts from 0) with the sum of value over the rows of the key before this one, in two steps of bounded windows."""
    grouped = df.withColumn("__group", F.expr(f"{order} div {GROUP}"))
    before = Window.partitionBy("key").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("key", "__group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = grouped.groupBy("key", "__group").agg(F.sum(value).alias("__sum")).select("key", "__group", F.coalesce(F.sum("__sum").over(before), zero).alias("__before"))
    found = grouped.withColumn("__inside", F.coalesce(F.sum(value).over(inside), zero)).join(sums, ["key", "__group"])
    return found.withColumn(offset, F.col("__inside") + F.col("__before")).drop("__inside", "__before", "__group")


def drawn_slots(spark: SparkSession, sources: DataFrame, all_: int, shard_blocks: int, seed: int) -> DataFrame:
    """key, j, shard, slot: every slot of the mix, with the source that it draws and which of the source's draws it is.

    sources: key, n (draws that the source makes, over 0) and offset (those of the sources before it); all_: their sum.
    """
    # Slot `at` draws the source in whose share a number below all_ lies. Sources are listed by runs of such numbers.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, all_ // (64 * RUN)))
    number = F.pmod(F.xxhash64(F.lit(seed), F.lit("source"), "id"), F.lit(max(all_, 1)))
    slots = spark.range(0, all_, 1, parts).select(F.col("id").alias("at"), number.alias("number")).withColumn("run", F.expr(f"number div {RUN}"))
    listed = sources.withColumn("run", F.explode(F.expr(f"sequence(offset div {RUN}, (offset + n - 1) div {RUN})"))).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("offset", "key"))).alias("listed"))
    key = F.element_at(F.filter("listed", lambda x: x["offset"] <= F.col("number")), -1)["key"]
    drawn = slots.join(listed, "run").select(key.alias("key"), F.expr(f"at div {shard_blocks}").alias("shard"), (F.col("at") % shard_blocks).alias("slot"))
    counts = cut(drawn.groupBy("key", "shard").agg(F.count("*").alias("count")))
    # The i-th draw of a source, in the order of shards and slots.
    within = Window.partitionBy("key", "shard").orderBy("slot")
    drawn = drawn.withColumn("i", F.row_number().over(within) - 1).join(running_sums(counts, "shard", "count", "before"), ["key", "shard"])
    drawn = cut(drawn.select("key", "shard", "slot", (F.col("i") + F.col("before")).alias("i")))

    earlier = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    made = sources.select("key", "n").join(counts.groupBy("key").agg(F.sum("count").alias("made")), "key", "left").withColumn("made", F.coalesce("made", zero))
    over, under = F.greatest(zero, F.col("made") - F.col("n")), F.greatest(zero, F.col("n") - F.col("made"))
    made = made.withColumns({"over": F.coalesce(F.sum(over).over(earlier), zero), "under": F.coalesce(F.sum(under).over(earlier), zero)})
    found = join_counted(drawn, made.where("made > 0").select("key", "n", "made", "over"), "key", "made", all_)
    found = cut(found.withColumn("j", permuted(F.col("i"), F.col("made"), F.lit(seed), F.lit("order"), F.col("key"))).select("key", "j", "n", "over", "shard", "slot"))
    seldom = made.where("made < n").withColumn("j", F.explode(F.sequence("made", F.col("n") - 1))).select("key", "j", (F.col("under") + F.col("j") - F.col("made")).alias("place"))
    spare = found.where("j >= n").select((F.col("over") + F.col("j") - F.col("n")).alias("place"), "shard", "slot")
    return found.where("j < n").select("key", "j", "shard", "slot").unionByName(spare.join(seldom, "place").select("key", "j", "shard", "slot"))


@dataclass
class Mix:
    """rows: row, doc_id, size, source_size, target, begin (first word's place in the source's stream), key (the source).
    draws: key, block, take (words of the block that are taken), shard, slot. chunks: into how many a source is cut."""

    rows: DataFrame
    draws: DataFrame
    block_words: int
    chunks: int

    def pieces(self) -> DataFrame:
        """Each document cut at the blocks, with what draws take of each piece; one row with no block for a document without words."""
        b = self.block_words
        first, last = F.expr(f"begin div {b}"), F.expr(f"(begin + size - 1) div {b}")
        cut_up = self.rows.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))).alias("block"))
        low = F.greatest("begin", F.col("block") * b) - F.col("block") * b
        high = F.least(F.col("begin") + F.col("size"), F.col("block") * b + b) - F.col("block") * b
        # No block is drawn over MOST times, so these lists are short.
        uses = self.draws.groupBy("key", "block").agg(F.collect_list(F.struct("shard", "slot", "take")).alias("uses"))
        # Draws come from a row for each source, which Spark would take for a small table and broadcast.
        return cut_up.withColumns({"low": low, "high": high}).join(uses.hint("merge"), ["key", "block"], "left")

    def documents(self) -> DataFrame:
        """row, key, doc_id, size, source_size, target, taken, first_shard of every document."""
        zero = F.lit(0).cast("long")
        taken = F.aggregate("uses", zero, lambda sum_, u: sum_ + F.greatest(zero, F.least("high", u["take"]) - F.col("low")))
        shard = F.array_min(F.transform(F.filter("uses", lambda u: u["take"] > F.col("low")), lambda u: u["shard"]))
        kept = [F.first(c).alias(c) for c in ("key", "doc_id", "size", "source_size", "target")]
        pieces = self.pieces().select("row", "key", "doc_id", "size", "source_size", "target", F.coalesce(taken, zero).alias("taken"), shard.alias("shard"))
        return pieces.groupBy("row").agg(*kept, F.sum("taken").alias("taken"), F.min("shard").alias("first_shard"))

    def blocks(self) -> DataFrame:
        """shard, slot, key, words (array) of every drawn block, the mix itself. Needs rows made with text."""
        used = self.pieces().where("uses is not null").select("key", "block", "begin", "low", "high", F.explode("uses").alias("u"), "words")
        start = F.col("block") * self.block_words + F.col("low") - F.col("begin") + 1
        length = F.least("high", F.col("u.take")) - F.col("low")
        parts = used.where(length > 0).select("u.shard", "u.slot", "key", "low", F.slice("words", start.cast("int"), length.cast("int")).alias("part"))
        # A block holds at most as many pieces as words.
        return parts.groupBy("shard", "slot", "key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "part"))), lambda p: p["part"])).alias("words"))


def mix(docs: DataFrame, block_words: int = 256, shard_blocks: int = 4096, seed: int = 1, with_words: bool = False) -> Mix:
    """Plans a mix of docs (doc_id, text, source).

    The size of a document is the number of its words, runs of other than ASCII white space; of a
    null or empty text it is 0. A null source is a source. Taken words of a source are its target
    rounded down: the last block drawn is cut. No document is taken over MOST times. The
    same rows and parameters give the same mix in any order of rows; rows that repeat doc_id and size
    may trade places. Without words, and for an empty table, all targets are 0 and nothing is drawn. Other columns are not read.
    """
    b, spark = block_words, docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    words = [F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words")] if with_words else []
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    sized = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *words))
    sources = cut(targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))))
    total = sources.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]

    # The stream of a source: chunks by hash of doc_id, in each by doc_id. A chunk is small whatever the source.
    n_chunks = total // CHUNK + 1
    chunked = sized.drop("source").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)))
    inside = Window.partitionBy("key", "chunk").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    chunks = running_sums(chunked.groupBy("key", "chunk").agg(F.sum("size").alias("n")), "chunk", "n", "offset").drop("n")
    placed = chunked.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(chunks, ["key", "chunk"]).withColumn("begin", F.col("inside") + F.col("offset")).drop("inside", "offset", "chunk")
    rows = join_counted(placed, sources.select("key", "docs", "source_size", "target"), "key", "docs", total).drop("docs")

    # How many draws each source makes, and where they begin among those of all sources.
    want, size = F.floor("target").cast("long"), F.col("source_size")
    whole, around = F.expr(f"source_size div {b}"), F.expr(f"(source_size + {b - 1}) div {b}")
    counted = sources.where("source_size > 0").select("key", "source_size", want.alias("want"), whole.alias("whole"), around.alias("around"))
    counted = counted.withColumn("n", F.expr(f"want div source_size * around + (want % source_size + {b - 1}) div {b}"))
    earlier = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut(counted.where("n > 0").withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))))
    draws_in_all = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slots = drawn_slots(spark, counted.select("key", "n", "offset"), draws_in_all, shard_blocks, seed)
    draws = join_counted(slots, counted.drop("offset"), "key", "n", draws_in_all)
    draws = draws.withColumns({"turn": F.expr("j div around"), "p": F.expr("j % around")})
    # The part block at the end of a stream comes last each time around.
    block = F.when(F.col("p") < F.col("whole"), permuted(F.col("p"), F.col("whole"), F.lit(seed), F.col("key"), F.col("turn"))).otherwise(F.col("whole"))
    take = F.least(F.lit(b), F.when(F.col("p") < F.col("whole"), F.lit(b)).otherwise(size % b), F.col("want") - F.col("turn") * size - F.col("p") * b)
    draws = draws.select("key", block.alias("block"), take.cast("long").alias("take"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("int").alias("slot"))
    return Mix(rows, draws, b, n_chunks)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs as often as the mix takes them, rounded to whole documents: not at all up to MOST times.

    What the mix takes of a document is rounded down or up so that its copies are right on average, whatever its
    length: copies are differences of the rounded running sum over all documents, by source and size, from a start
    that hashing gives. A source's words so miss what the mix takes of it by about one document. Rows that
    repeat a doc_id are repeated as often as the mix takes all of them together. Rows without words stay
    once; an empty table stays empty. The running sum goes over ranges of that order and over the ranges' sums.
    """
    id_, times, n = fresh(docs, "__id", "__times", "__n")
    plan = mix(docs, **parameters)
    taken = plan.documents().groupBy(F.col("doc_id").alias(id_)).agg(F.min("key").alias("key"), F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    taken = cut(taken.withColumn("part", F.coalesce(F.expr(f"taken * {PARTS} div nullif(size, 0)"), F.lit(0))))
    order = ["key", "size", id_]
    ranged = cut(taken.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("range", F.shiftright("place", 33))
    zero = F.lit(0).cast("long")
    sums = ranged.groupBy("range").agg(F.sum("part").alias("sum"))
    # One row for each range.
    offsets = sums.select("range", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("offset"))
    before = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.pmod(F.xxhash64(F.lit("copies")), F.lit(PARTS))
    taken = ranged.withColumn("inside", F.coalesce(F.sum("part").over(before), zero)).join(F.broadcast(offsets), "range").withColumn("at", start + F.col("inside") + F.col("offset"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr(f"(at + part) div {PARTS} - at div {PARTS}")).cast("int")
    found = taken.select(id_, copies.alias(times)).where(F.col(times) > 0)
    return docs.join(found, docs["doc_id"].eqNullSafe(found[id_])).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(id_, times, n)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).documents().drop("row", "key")
