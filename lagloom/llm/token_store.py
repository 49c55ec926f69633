"""A content-addressed store of token ids.

A rolling hash over the last ids of a document cuts its id stream into chunks, so that a
passage shared by documents mostly gives the same chunks wherever it stands. Each different
chunk is stored once under its digest, the first 16 bytes of the SHA-256 of its ids; a document is a
recipe, the list of its chunks; a Merkle manifest over the recipes, in ascending doc_id order, certifies them.

    entries     kind=chunk: chunk, a digest and the ids it is of, packed, 16 bit if all fit, else 32
                kind=doc, kind=again: what recipes and hot are made of; removed once the store stands
    hot         key, uses of the digests, at most HOT_KEYS, that many recipes hold
    recipes     part, ord, doc_id, start, n_tokens, chunks (for each a digest and a 32-bit length); by doc_id
    ranges      part, start, ord: what lies before each range of recipes, and so is to be added to theirs
    manifest    level, node, hash: the Merkle tree over the recipes, FAN children a node
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.byte_bpe import ChunkCoder, offsets_of, slices
from lagloom.llm.common import HOT_KEYS, delete, held, settings, small_batches

#: Children of a node of the Merkle tree.
FAN = 1024
#: Bytes of a digest, and of an entry of a recipe.
DIGEST, ENTRY = 16, 20
#: Ids that the rolling hash looks back on, fewer than the shortest chunk has; a chunk ends where its top MASK_BITS are 0.
LOOK, MASK_BITS = 8, 6
SHORTEST, LONGEST = 16, 8192
#: Pieces of text in the cache of a Python worker, for each of two generations.
PIECES = 400_000
#: Pieces put together to one text for the library, which is slower with long texts.
TOGETHER = 200
#: Digests that a task knows to have sent.
SENT = 200_000
#: While entries are written: a writer for each kind instead of a sort, and no shuffle files left behind.
ENTRIES_SETTINGS = {"spark.sql.maxConcurrentOutputFileWriters": "4", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

def _coder(vocabulary) -> tuple[ChunkCoder, int]:
    """A coder for the broadcast text of a tokenizers file, and the bytes that an id takes."""

    def make() -> tuple[ChunkCoder, int]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(vocabulary.value)
        wide = 2 if library.get_vocab_size() <= 1 << 16 else 4
        return ChunkCoder(together(library, f"<u{wide}"), f"<u{wide}", PIECES), wide

    return held(f"token_store {hashlib.sha256(vocabulary.value.encode()).hexdigest()}", make)


def together(library, dtype: str):
    """A function from many short texts to the ids of each, packed, which spares the library a call for each.

    Texts with no white space but perhaps one space at the start are put together to one text, with a
    line feed before those without a space, and the ids are cut where the bytes of their tokens say. That
    holds for byte-level vocabularies; should the places not meet, each text is encoded by itself.
    """
    vocabulary = library.get_vocab(with_added_tokens=True)
    length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, i in vocabulary.items():
        length[i] = len(token)
    wide = np.dtype(dtype).itemsize

    def single(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode_many(texts: list[str]) -> list[bytes]:
        at = [i for i, t in enumerate(texts) if len(t) < 100 and t.isprintable() and t.rfind(" ") <= 0 and t != " "]  # printable: no other white space
        out: list = [None] * len(texts)
        if at:
            lead = [texts[i] if texts[i][0] == " " else "\n" + texts[i] for i in at]
            sizes = np.fromiter((len(t.encode()) for t in lead), np.int64, len(lead))
            parts = ["".join(lead[i : i + TOGETHER]) for i in range(0, len(lead), TOGETHER)]
            ids = np.array([x for e in library.encode_batch_fast(parts, add_special_tokens=False) for x in e.ids], dtype)
            places = np.r_[0, np.cumsum(length[ids])]
            ends = np.cumsum(sizes)
            starts = ends - sizes + np.fromiter((t[0] == "\n" for t in lead), np.int64, len(lead))
            a, b = np.searchsorted(places, starts), np.searchsorted(places, ends)
            if places[-1] == ends[-1] and (places[a] == starts).all() and (places[b] == ends).all():
                packed = ids.tobytes()
                for i, x, y in zip(at, (a * wide).tolist(), (b * wide).tolist(), strict=True):
                    out[i] = packed[x:y]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, single([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out

    return encode_many


def chunk_ends(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end in the ids of documents, of which none is empty and which end where ends says.

    Depends on the ids near each place only, but for the length limits: a mark so near a
    document's begin that the hash looks back beyond it comes too soon to end a chunk.
    """
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    rolling = mixed.copy()
    for back in range(1, min(LOOK, len(ids))):
        rolling[back:] += mixed[:-back] * np.uint32(pow(0x85EBCA77, back, 1 << 32))
    places = np.union1d(np.flatnonzero((rolling >> np.uint32(32 - MASK_BITS)) == 0) + 1, ends)
    last = np.zeros(len(places), bool)
    last[np.searchsorted(places, ends)] = True
    out, start = [], 0
    for place, final in zip(places.tolist(), last.tolist(), strict=True):
        while place - start > LONGEST:
            start += LONGEST
            out.append(start)
        if final or place - start >= SHORTEST:
            out.append(place)
            start = place
    return np.array(out, np.int64)


def crc_shift_tables(bits: int = 48) -> np.ndarray:
    """tables[k][i]: bit i of a CRC-32 after 2**k more zero bytes."""
    one = np.zeros(32, np.uint64)
    for i in range(32):
        value = 1 << i
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        one[i] = value
    tables = [one]
    for _ in range(1, bits):
        tables.append(crc_times(tables[-1], tables[-1]))
    return np.array(tables)


def crc_times(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for i in range(32):
        out ^= table[i] * ((values >> np.uint64(i)) & np.uint64(1))
    return out


def crc_by_bytes(tables: np.ndarray) -> np.ndarray:
    """The same by byte: [k][b][v] is what byte b of value v gives after 2**k more zero bytes."""
    values = np.arange(256, dtype=np.uint64)
    return np.array([[crc_times(t, values << np.uint64(8 * b)) for b in range(4)] for t in tables], np.uint32)


def crc_shift(values: np.ndarray, length: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a longer text that goes on for length bytes. tables: from crc_by_bytes."""
    out = values.astype(np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero((length >> k) & 1)
        x, t = out[on], tables[k]
        out[on] = t[0][x & 0xFF] ^ t[1][(x >> 8) & 0xFF] ^ t[2][(x >> 16) & 0xFF] ^ t[3][x >> 24]
    return out


ENTRIES = "chunk binary, key binary, uses long, row long, doc_id {id}, n_tokens long, chunks binary"


def encode_entries(docs: DataFrame, vocabulary, end_id: int) -> DataFrame:
    """Rows of three kinds: chunk; key and uses; row, doc_id, n_tokens and chunks of documents.

    A task sends a chunk once, unless it has met too many others in between, and then how often it met it again.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "key", "uses", "row", "doc_id", "n_tokens", "chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, wide = _coder(vocabulary)
        again: dict[bytes, int] = {}
        kind, row = None, 0

        def rows(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), kind, pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds, strict=True)], names)

        def counted(row: int) -> pa.RecordBatch:
            more = [(k, n) for k, n in again.items() if n]
            again.clear()
            # With the last row's number, since other tasks may have counted as many.
            return rows(key=pa.array([k for k, _ in more], pa.binary()), uses=pa.array([n for _, n in more], pa.int64()), row=pa.array([row] * len(more), pa.int64()))

        for batch in batches:
            kind = batch.column(2).type
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, at = coder.encode(part.column(1))
                # An end id after each document.
                moved = np.full(len(ids) + len(part), end_id, ids.dtype)
                n = np.diff(at)
                for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    moved[x + k : y + k] = ids[x:y]
                ends = at[1:] + np.arange(1, len(part) + 1)
                stops = chunk_ends(moved, ends)
                starts = np.r_[0, stops[:-1]]
                data = memoryview(moved.tobytes())
                spans = [data[x:y] for x, y in zip((starts * wide).tolist(), (stops * wide).tolist(), strict=True)]
                keys = [sha256(x).digest()[:DIGEST] for x in spans]
                new: dict[bytes, memoryview] = {}
                for k, x in zip(keys, spans, strict=True):
                    if k in again:
                        again[k] += 1
                    else:
                        again[k] = 0
                        new[k] = x
                yield rows(chunk=pa.array([b"".join(x) for x in new.items()], pa.binary()))
                row = part.column(0)[-1].as_py()
                if len(again) > SENT:
                    yield counted(row)
                recipe = np.empty((len(stops), ENTRY), np.uint8)
                recipe[:, :DIGEST] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, DIGEST)
                recipe[:, DIGEST:] = (stops - starts).astype("<u4").view(np.uint8).reshape(-1, ENTRY - DIGEST)
                bounds = np.r_[0, np.searchsorted(stops, ends) + 1].astype(np.int32) * ENTRY
                packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds), pa.py_buffer(recipe.tobytes())])
                yield rows(row=part.column(0), doc_id=part.column(2), n_tokens=pa.array(n + 1), chunks=packed)
        if again:
            yield counted(row)

    # The row's number keeps repeated rows apart; it only has to differ within this run of the plan.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "text", "doc_id")
    return numbered.mapInArrow(run, ENTRIES.format(id=id_type))


def unpacked(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of recipes: the place of the recipe, the digest (a row of bytes), the length and what follows, of every chunk."""
    bounds = offsets_of(chunks).astype(np.int64)
    rows = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].reshape(-1, ENTRY) if bounds[-1] > bounds[0] else np.zeros((0, ENTRY), np.uint8)
    first = (bounds - bounds[0]) // ENTRY
    n = np.ascontiguousarray(rows[:, DIGEST:]).view("<u4").reshape(-1).astype(np.int64)
    total = np.r_[0, np.cumsum(n)]
    of = np.repeat(np.arange(len(chunks)), np.diff(first))
    return of, rows[:, :DIGEST], n, total[first[1:]][of] - total[1:]


def _leaf():
    """The hash of a recipe, from all that is known of it."""
    told = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "ord", "n_tokens", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.encode(told, "utf-8"), F.col("chunks")), 256))


def _above(level: DataFrame) -> DataFrame:
    """node, hash of the nodes over those of level (node, hash)."""
    joined = F.array_join(F.transform("under", lambda x: F.hex(x["hash"])), "")
    return (
        level.groupBy(F.floor(F.col("node") / FAN).alias("up"))
        .agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("under"))
        .select(F.col("up").alias("node"), F.unhex(F.sha2(joined, 256)).alias("hash"))
    )


class TokenStore:
    """A store at path, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, docs: DataFrame, vocabulary_path: str, end_id: int = 0, ranges: int | None = None) -> None:
        """Encodes docs (doc_id, text) with a tokenizers file and writes the store.

        Every document gets end_id at its end; a null or empty text has only that. Rows that
        repeat a doc_id are documents of their own; a null doc_id comes first. An empty table
        gives an empty store. Other columns are not read.
        """
        with open(vocabulary_path, encoding="utf-8") as f:
            vocabulary = self.spark.sparkContext.broadcast(f.read())
        # One shuffle for all kinds; texts are encoded once. Chunks are dealt as they are, since each task has sent few twice.
        kind = F.when(F.col("chunk").isNotNull(), F.lit("chunk")).when(F.col("key").isNotNull(), F.lit("again")).otherwise(F.lit("doc"))
        entries = encode_entries(docs, vocabulary, end_id).withColumn("at", F.xxhash64("chunk", "key", "row")).repartition("at").distinct().drop("at")
        with settings(self.spark, ENTRIES_SETTINGS):
            entries.withColumn("kind", kind).write.option("compression", "zstd").partitionBy("kind").parquet(f"{self.path}/entries")
        id_type = docs.schema["doc_id"].dataType.simpleString()

        def entries_of(kind: str) -> DataFrame:
            return self._entries(id_type).where(F.col("kind") == kind)


        ranges = ranges or max(12, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        found = entries_of("doc").select("row", "doc_id", "n_tokens", "chunks")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, start, ord_ = TaskContext.get().partitionId(), 0, 0
            for batch in batches:
                n = batch.num_rows
                ends = start + np.cumsum(batch.column(1).to_numpy())
                places = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(ord_, ord_ + n)), batch.column(0), pa.array(np.r_[start, ends[:-1]][:n]), batch.column(1), batch.column(2)]
                if n:
                    start, ord_ = int(ends[-1]), ord_ + n
                yield pa.RecordBatch.from_arrays(places, ["part", "ord", "doc_id", "start", "n_tokens", "chunks"])

        ordered = found.repartitionByRange(ranges, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "n_tokens", "chunks")
        self._write(ordered.mapInArrow(place, f"part int, ord long, doc_id {id_type}, start long, n_tokens long, chunks binary"), "recipes")
        total = self._read("recipes").agg(F.coalesce(F.sum(F.octet_length("chunks")), F.lit(0))).first()[0] // ENTRY
        uses = entries_of("again").groupBy("key").agg(F.sum("uses").alias("uses"))
        self._write(uses.where(F.col("uses") * HOT_KEYS > total).coalesce(1), "hot")
        # One row for each range.
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = self._read("recipes").groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))
        zero = F.lit(0).cast("long")
        self._write(sums.select("part", F.coalesce(F.sum("n").over(before), zero).alias("start"), F.coalesce(F.sum("rows").over(before), zero).alias("ord")), "ranges")

        self._level().select(F.lit(1).alias("level"), "node", "hash").write.partitionBy("level").parquet(f"{self.path}/manifest")
        level, n = 1, self._nodes(1).count()
        while n > 1:
            _above(self._nodes(level)).select(F.lit(level + 1).alias("level"), "node", "hash").write.mode("append").partitionBy("level").parquet(f"{self.path}/manifest")
            level, n = level + 1, -(-n // FAN)
        for kind in ("doc", "again"):
            delete(self.spark, f"{self.path}/entries/kind={kind}")

    def _entries(self, id_type: str = "long") -> DataFrame:
        return self.spark.read.schema(f"{ENTRIES.format(id=id_type)}, kind string").parquet(f"{self.path}/entries")

    def recipes(self) -> DataFrame:
        """ord, doc_id, start, n_tokens, chunks of every document; ord and start count all documents before it."""
        ranges = F.broadcast(self._read("ranges").select("part", F.col("start").alias("__start"), F.col("ord").alias("__ord")))
        found = self._read("recipes").join(ranges, "part")
        return found.select((F.col("ord") + F.col("__ord")).alias("ord"), "doc_id", (F.col("start") + F.col("__start")).alias("start"), "n_tokens", "chunks")

    def _level(self) -> DataFrame:
        """The lowest nodes of the tree over the recipes as they now read."""
        return _above(self.recipes().select(F.col("ord").alias("node"), _leaf().alias("hash")))

    def _nodes(self, level: int) -> DataFrame:
        tree = self.spark.read.schema("node long, hash binary, level int").parquet(f"{self.path}/manifest")
        return tree.where(F.col("level") == level).select("node", "hash")

    def verify_manifest(self) -> bool:
        """Whether the stored manifest is that of the stored recipes, hashed anew level by level."""
        level, now = 1, self._level()
        while True:
            stored = self._nodes(level).select("node", F.col("hash").alias("stored"))
            if not now.join(stored, "node", "full").where(~F.col("hash").eqNullSafe(F.col("stored"))).isEmpty():
                return False
            if self._nodes(level).count() <= 1:
                return True
            # What lies below is as it should be, so the next level may be made of it.
            now, level = _above(self._nodes(level)), level + 1

    def _chunks(self) -> DataFrame:
        """key, ids of every chunk."""
        return self._entries().where("kind = 'chunk'").select(F.expr(f"substring(chunk, 1, {DIGEST})").alias("key"), F.expr(f"substring(chunk, {DIGEST + 1})").alias("ids"))

    def _width(self) -> int:
        """Bytes that an id takes."""
        row = self._read("recipes").where("n_tokens > 0").select("chunks").limit(1).first()
        if row is None:
            return 2
        n = int.from_bytes(row.chunks[DIGEST:ENTRY], "little")
        found = self._chunks().where(F.col("key") == F.lit(bytearray(row.chunks[:DIGEST]))).select("ids").first()
        return len(found.ids) // n if found else 2

    def read_chunks(self, wide: int | None = None, salts: dict[bytes, int] | None = None) -> DataFrame:
        """digest, salt, n, crc of every chunk, from its stored ids; one whose ids don't give its digest is an error.

        salts: for some digests, how many rows with salts from 0 on there are to be.
        """
        wide, salts = wide or self._width(), salts or {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bounds = offsets_of(batch.column(0)).astype(np.int64)
                whole = memoryview(batch.column(0).buffers()[2] or b"")[bounds[0] : bounds[-1]]
                # The ids at full width, and with them the digests, which are of no use so.
                full, times = memoryview(np.frombuffer(whole, f"<u{wide}").astype("<u4").tobytes()), 4 // wide
                at = (bounds - bounds[0]).tolist()
                places = list(zip(at[:-1], at[1:], strict=True))
                keys = [bytes(whole[a : a + DIGEST]) for a, _ in places]
                digests = [sha256(whole[a + DIGEST : b]).digest()[:DIGEST] for a, b in places]
                if keys != digests:
                    wrong = next(k for k, d in zip(keys, digests, strict=True) if k != d)
                    raise ValueError(f"chunk {wrong.hex()} doesn't hold what its digest says")
                crc = [zlib.crc32(full[(a + DIGEST) * times : b * times]) for a, b in places]
                times = np.array([salts.get(k, 1) for k in keys], np.int64)
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                rows = pa.array(np.repeat(np.arange(len(keys)), times))
                columns = [pa.array(keys, pa.binary()), pa.array((np.diff(bounds) - DIGEST) // wide), pa.array(crc, pa.int64())]
                digest, n, crcs = (c.take(rows) for c in columns)
                yield pa.RecordBatch.from_arrays([digest, pa.array(salt.astype(np.int32)), n, crcs], ["digest", "salt", "n", "crc"])

        return self._entries().where("kind = 'chunk'").select("chunk").mapInArrow(run, "digest binary, salt int, n long, crc long")

    def _hot(self) -> dict[bytes, int]:
        """Into how many parts the uses of a chunk are dealt, for the chunks, at most HOT_KEYS, with over 1 / HOT_KEYS of all uses."""
        total = self._read("recipes").agg(F.coalesce(F.sum(F.octet_length("chunks")), F.lit(0))).first()[0] // ENTRY
        return {bytes(r.key): -(-r.uses * HOT_KEYS // total) for r in self._read("hot").collect()}

    def _uses(self, salts: dict[bytes, int]) -> DataFrame:
        """ord, digest, salt, length, after of every chunk of every document; after: how many ids follow."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, digests, n, after = unpacked(batch.column(1))
                salt = np.zeros(len(of), np.int32)
                ord_ = batch.column(0).to_numpy()[of]
                if salts:
                    keys = np.ascontiguousarray(digests).view(f"S{DIGEST}").reshape(-1)
                    # S drops zero bytes at the end, on both sides alike.
                    for k in np.flatnonzero(np.isin(keys, np.array(list(salts), f"S{DIGEST}"))).tolist():
                        salt[k] = ord_[k] % salts.get(digests[k].tobytes(), 1)
                bounds = np.arange(len(of) + 1, dtype=np.int32) * DIGEST
                digest = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(digests))])
                yield pa.RecordBatch.from_arrays([pa.array(ord_), digest, pa.array(salt), pa.array(n), pa.array(after)], ["ord", "digest", "salt", "length", "after"])

        return self.recipes().select("ord", "chunks").mapInArrow(run, "ord long, digest binary, salt int, length long, after long")

    def checksums(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

        The CRC-32 of a document is the exclusive or of what its chunks add, each shifted by the
        length that follows. A chunk that is missing, has another length or doesn't give its digest, and a
        document of another length than its recipe's, are errors.
        """
        tables, salts = crc_by_bytes(crc_shift_tables()), self._hot()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ord_, length, crc, after = batch.columns
                moved = crc_shift(crc.to_numpy(), after.to_numpy() * 4, tables)
                yield pa.RecordBatch.from_arrays([ord_, length, pa.array(moved.astype(np.int64))], ["ord", "length", "add"])

        recipes = self.recipes().select("ord", "doc_id", "start", "n_tokens", (F.octet_length("chunks") / ENTRY).alias("need"))
        found = self._uses(salts).join(self.read_chunks(salts=salts).hint("shuffle_hash"), ["digest", "salt"]).where("n = length")
        added = found.select("ord", "length", "crc", "after").mapInArrow(run, "ord long, length long, add long")
        added = added.groupBy("ord").agg(F.bit_xor("add").alias("crc"), F.count("*").alias("got"), F.sum("length").alias("length"))
        whole = (F.col("got") == F.col("need")) & (F.col("length") == F.col("n_tokens"))
        wrong = F.raise_error(F.concat(F.lit("the chunks of a recipe are missing or of other lengths, document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
        return recipes.join(added, "ord", "left").select("doc_id", "start", "n_tokens", F.when(whole, F.col("crc")).otherwise(wrong.cast("long")).alias("ids_crc32"))

    def read_documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids (array of long) of every document, put together from its chunks.

        A chunk that is missing or doesn't give its digest, and a document of another length than its recipe's, are errors.
        """
        wide = self._width()
        rows = self.recipes()
        parts = F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("at"), "digest", "ids")))
        joined = self._uses({}).join(self._chunks().withColumnRenamed("key", "digest"), "digest", "left").groupBy("ord").agg(parts.alias("parts"))

        def put_together(parts: list[dict], n: int) -> np.ndarray:
            for x in parts:
                if x["ids"] is None or hashlib.sha256(x["ids"]).digest()[:DIGEST] != x["digest"]:
                    raise ValueError(f"chunk {(x['digest'] or b'').hex()} is missing or doesn't hold what its digest says")
            ids = np.frombuffer(b"".join(x["ids"] for x in parts), f"<u{wide}").astype(np.int64)
            if len(ids) != n:
                raise ValueError(f"a recipe gives {len(ids)} ids and says {n}")
            return ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [put_together(parts, n) for parts, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids"])

        whole = rows.drop("chunks").join(joined, "ord").select("doc_id", "start", "n_tokens", "parts")
        return whole.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids array<long>")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lagloom.llm.common import shared_path

    store = TokenStore(spark, shared_path(spark, "tokens"))
    store.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    if not store.verify_manifest():
        raise ValueError("the store's recipes don't give its manifest")
    return store.checksums()
