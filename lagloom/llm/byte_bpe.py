"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece of text the encoder stores the one token that can stand last in the
encoding of that prefix. A token t may follow a token s just when the bytes of both, encoded by
themselves, give [s, t]; the encoding of a prefix is then its valid last token and the encoding
of what lies before it. Bytes are appended by extending the table, and after an edit only the
table from the edit on is computed anew.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.common import held, small_batches

#: Entries of each cache of a Python worker. A full cache is emptied; that of whole pieces keeps one generation more.
CACHE = 200_000
#: Longer pieces aren't cached.
CACHED_CHARS = 48
#: Bytes of text worked on at once.
SLICE = 8_000_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks in a .tiktoken file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Prefixes:
    """The table of one piece: last[i] is the token that ends the encoding of its first i bytes, states[i] what they may go on as."""

    def __init__(self, encoder: "PrefixEncoder", data: bytes = b""):
        self.encoder, self.data, self.last, self.states = encoder, b"", [-1], [encoder.states[b""]]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; what is stored for shorter prefixes stays as it is."""
        self.data += more
        self.encoder.extend(self.data, self.last, self.states)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replaces the bytes from start to end; prefixes that end by start are kept."""
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :], self.states[start + 1 :]
        self.encoder.extend(self.data, self.last, self.states)

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last)


class _State:
    """What the bytes read so far may be the start of: the tokens that end here, longest first, and the next states.

    tokens: length, id, and which tokens it may follow, as far as known; -1 stands for the start.
    """

    __slots__ = ("text", "tokens", "next")

    def __init__(self, text: bytes, tokens: list[tuple[int, int, dict[int, bool]]]):
        self.text, self.tokens, self.next = text, tokens, {}


class PrefixEncoder:
    """Encodes single pieces. ranks: token bytes to id, lower ids merged first; every byte a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.token: list[bytes] = [b""] * self.size
        for t, i in ranks.items():
            self.token[i] = t
        self.length = [len(t) for t in self.token]
        self.starts = {t[:i] for t in ranks for i in range(len(t) + 1)}
        self.states = {b"": _State(b"", [])}
        self.follows: dict[int, dict[int, bool]] = {}
        self.pairs = 0

    def merged(self, data: bytes) -> list[int]:
        """The encoding by merging the pair of lowest rank again and again; for short inputs."""
        get, none = self.ranks.get, self.size
        parts = [data[i : i + 1] for i in range(len(data))]
        joint = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while joint:
            low = min(joint)
            if low == none:
                break
            i = joint.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i < len(joint):
                joint[i] = get(parts[i] + parts[i + 1], none)
            if i:
                joint[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def may_follow(self, s: int, t: int) -> bool:
        """Whether merging the bytes of both gives both; of t alone, if s is -1."""
        if self.pairs >= CACHE:
            self.pairs = 0
            for known in self.follows.values():
                known.clear()
        self.pairs += 1
        found = self.follows[t][s] = self.merged(self.token[s] + self.token[t]) == [s, t] if s >= 0 else self.merged(self.token[t]) == [t]
        return found

    def step(self, state: _State, byte: int) -> _State:
        """The state after one more byte: its text is the longest end of what was read that starts a token."""
        text = state.text + bytes((byte,))
        while text not in self.starts:
            text = text[1:]
        if text not in self.states:
            ends = [(len(text) - i, self.ranks[text[i:]]) for i in range(len(text)) if text[i:] in self.ranks]
            self.states[text] = _State(text, [(n, t, self.follows.setdefault(t, {})) for n, t in ends])
        state.next[byte] = self.states[text]
        return self.states[text]

    def extend(self, data: bytes, last: list[int], states: list[_State]) -> None:
        """Fills last and states, which hold the prefixes of data up to some length, to the end of data."""
        state, end = states[-1], len(last)
        for byte in data[end - 1 :]:
            state = state.next.get(byte) or self.step(state, byte)
            states.append(state)
            for length, t, known in state.tokens:
                s = last[end - length]
                fits = known.get(s)
                if fits is None:
                    fits = self.may_follow(s, t)
                if fits:
                    last.append(t)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {byte}")
            end += 1

    def walk(self, last: list[int]) -> list[int]:
        ids, end = [], len(last) - 1
        while end > 0:
            ids.append(last[end])
            end -= self.length[last[end]]
        ids.reverse()
        return ids

    def encode(self, data: bytes) -> list[int]:
        """The ids of a piece. A piece that is itself a token is that token, as in tiktoken."""
        return self.encode_many([data])[0]

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece. In sorted order, a piece keeps of the table what it has in common with the one before."""
        out: list = [None] * len(pieces)
        left = []
        for i, data in enumerate(pieces):
            whole = self.ranks.get(data)
            if whole is None:
                left.append(i)
            else:
                out[i] = [whole]
        left.sort(key=pieces.__getitem__)
        last, states = [-1], [self.states[b""]]
        for i, same in zip(left, shared_prefixes([pieces[i] for i in left]), strict=True):
            del last[same + 1 :], states[same + 1 :]
            self.extend(pieces[i], last, states)
            out[i] = self.walk(last)
        return out


def shared_prefixes(pieces: list[bytes], most: int = CACHED_CHARS) -> list[int]:
    """How many bytes, `most` or fewer, each piece has in common with the one before."""
    rows = np.array([p[:most] for p in pieces], f"S{most}").view(np.uint8).reshape(len(pieces), most)
    same = np.zeros(len(pieces), np.int64)
    if len(pieces) > 1:
        differs = np.c_[rows[1:] != rows[:-1], np.ones(len(pieces) - 1, bool)]
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        same[1:] = np.minimum(differs.argmax(1), np.minimum(length[1:], length[:-1]))
    return same.tolist()


# What a byte may be, a bit each: white space but for spaces and line feeds; the first byte of such a character
# beyond ASCII, or of another one; a space or line feed; a comma or stop; a letter or number; the second
# byte of a letter from U+00C0 to U+00FF, whose first byte is C3.
_ODD_BYTE, _ODD_LEAD, _SPACE, _SIGN, _ALNUM, _LATIN = (np.uint8(1 << k) for k in range(6))
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in (
    (_ODD_BYTE, [0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]),
    (_ODD_LEAD, [0xC2, 0xE1, 0xE2, 0xE3]),
    (_SPACE, [0x20, 0x0A]),
    (_SIGN, [0x2C, 0x2E]),
    (_ALNUM, [i for i in range(128) if chr(i).isalnum()]),
    (_LATIN, [i for i in range(0x80, 0xC0) if i not in (0x97, 0xB7)]),
):
    _KINDS[_bytes] |= _kind
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def odd_texts(kinds: np.ndarray, bounds: np.ndarray, text: Callable[[int], str]) -> np.ndarray:
    """Which texts hold white space but for spaces and line feeds. kinds: of the UTF-8 of all, text i from bounds[i] to bounds[i + 1]."""
    found = np.zeros(len(bounds) - 1, bool)
    found[np.searchsorted(bounds, np.flatnonzero(kinds & _ODD_BYTE), "right") - 1] = True
    # A first byte that such white space has in common with other characters.
    for i in np.unique(np.searchsorted(bounds, np.flatnonzero(kinds & _ODD_LEAD), "right") - 1).tolist():
        found[i] = found[i] or _ODD.search(text(i)) is not None
    return found


def piece_starts(data: np.ndarray, kinds: np.ndarray, bounds: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Where the pieces begin that the texts are cut into: places that no match of the pattern crosses or looks past.

    Before a space or line feed after something else, after a line feed that stands alone, and
    before a comma or stop after a letter or number. Odd texts are one piece.
    """
    n = len(data)
    start = np.zeros(n + 1, bool)
    space = (kinds & _SPACE) != 0
    # Before the first and after the last character of a text nothing is cut.
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    if n > 1:
        inner = ~edge[1:n]
        after = ~space[:-1] & inner
        start[1:n] = space[1:] & after
        signs = np.flatnonzero(kinds[1:] & _SIGN) + 1
        before = kinds[signs - 1]
        latin = ((before & _LATIN) != 0) & (signs > 1) & (data[signs - 2] == 0xC3)
        signs = signs[(((before & _ALNUM) != 0) | latin) & inner[signs - 1]]
        start[signs] = True
        feeds = np.flatnonzero(data[1:-1] == 0x0A) + 1
        start[feeds[after[feeds - 1] & ~space[feeds + 1] & inner[feeds]] + 1] = True
    for i in np.flatnonzero(odd).tolist():
        start[bounds[i] + 1 : bounds[i + 1]] = False
    start[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    start[n] = False
    return np.flatnonzero(start)


def offsets_of(column: pa.Array) -> np.ndarray:
    """Where the values of a string or binary array begin in its data, and where the last ends."""
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Rows from, to of runs of a string array of about `most` bytes; a longer text is a run of its own."""
    bounds, at = offsets_of(column).astype(np.int64), 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, end
        at = end


def strings_of(column: pa.Array) -> list[str]:
    """A string array as a list, by one text that is split again, which is faster than value by value."""
    if not len(column):
        return []
    out = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), "\0")[0].as_py().split("\0")
    return out if len(out) == len(column) else column.to_pylist()


class ChunkCoder:
    """Encodes texts piece by piece with a cache.

    Texts are cut where the byte-level pattern (optional space and letters, numbers or other signs;
    white space up to the last before a word) neither crosses nor looks past: see piece_starts. Texts
    with other white space than spaces and line feeds aren't cut. Each different piece of a run of
    texts is looked up once. encode_many gets the pieces that are not in the cache and returns the ids
    of each, packed as dtype. The cache has two generations of `most` pieces.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], dtype: str = "<u4", most: int = CACHE):
        self.encode_many, self.dtype, self.most = encode_many, dtype, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, pieces: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        left = [i for i, x in enumerate(found) if x is None]
        new = []
        for i, ids in zip(left, [old.get(pieces[i]) for i in left], strict=True):
            if ids is None:
                new.append(i)
            else:
                found[i] = young[pieces[i]] = ids
        for i, ids in zip(new, self.encode_many([pieces[i] for i in new]) if new else (), strict=True):
            found[i] = ids
            if len(pieces[i]) <= CACHED_CHARS:
                young[pieces[i]] = ids
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where those of each text begin (one more at the end). A null text counts as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        bounds = offsets_of(texts).astype(np.int64)
        if bounds[-1] == bounds[0]:
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8, bounds[-1] - bounds[0], bounds[0])
        bounds = bounds - bounds[0]
        kinds = _KINDS[data]
        odd = odd_texts(kinds, bounds, lambda i: texts[i].as_py())
        starts = piece_starts(data, kinds, bounds, odd)
        cuts = np.r_[starts, len(data)].astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        ids = pa.array(self.look_up(strings_of(pieces.dictionary)), pa.binary()).take(pieces.indices)
        at = offsets_of(ids) // np.dtype(self.dtype).itemsize
        return np.frombuffer(ids.buffers()[2], self.dtype, at[-1]), at[np.searchsorted(starts, bounds)].astype(np.int64)


class TextEncoder:
    """Whole texts by a vocabulary and a pattern: each match of the pattern is encoded by itself."""

    def __init__(self, data: bytes, pattern: str):
        self.pieces = PrefixEncoder(parse_ranks(data))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.chunks = ChunkCoder(self.encode_chunks)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, packed."""
        ids: list[int] = []
        found = [self.pattern.findall(x) for x in chunks]
        # Chunks of one piece are kept by the caller.
        single = iter(self.pieces.encode_many([f[0].encode() for f in found if len(f) == 1]))
        ends = []
        for pieces in found:
            if len(pieces) == 1:
                ids += next(single)
            else:
                for piece in pieces:
                    ids += self.encode_piece(piece)
            ends.append(4 * len(ids))
        packed = np.array(ids, "<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_piece(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            found = self.pieces.encode(piece.encode())
            if len(self.known) >= CACHE // 4:
                self.known.clear()
            if len(piece) <= CACHED_CHARS:
                self.known[piece] = found
        return found

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        ids, at = self.chunks.encode(texts)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids)])


def decode(tokens: pa.Array, packed: pa.Array) -> pa.Array:
    """The bytes that the ids of each row stand for. tokens: the bytes of each id."""
    bounds = offsets_of(packed).astype(np.int64)
    if bounds[-1] == bounds[0]:
        return pa.array([b""] * len(packed), pa.binary())
    ids = np.frombuffer(packed.buffers()[2], "<u4", (bounds[-1] - bounds[0]) // 4, bounds[0])
    found = tokens.take(pa.array(ids))
    at = offsets_of(found)[(bounds - bounds[0]) // 4]
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(np.ascontiguousarray(at)), found.buffers()[2]])


def token_bytes(data: bytes) -> pa.Array:
    """The bytes of each id of a .tiktoken file; of an id without a token, none."""
    ranks = parse_ranks(data)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, i in ranks.items():
        out[i] = t
    return pa.array(out, pa.binary())


def _load(vocabulary, pattern: str) -> TextEncoder:
    key = hashlib.sha256(vocabulary.value + pattern.encode()).hexdigest()
    return held(f"byte_bpe {key}", lambda: TextEncoder(vocabulary.value, pattern))


class ByteBPE:
    """Encoding and decoding of columns. path: a .tiktoken file that the driver reads; it is broadcast (under 2 MB)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        small_batches(spark)
        with open(path, "rb") as f:
            self.vocabulary = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def encode(self, docs: DataFrame) -> DataFrame:
        """doc_id and ids, binary: the text's ids as little-endian unsigned 32-bit integers.

        One row for each row of docs, repeated rows too. A null or empty text has no ids. Other
        columns are not read; an empty table gives an empty result.
        """
        vocabulary, pattern = self.vocabulary, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = _load(vocabulary, pattern)
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), coder.encode(batch.column(1).slice(a, b - a))], ["doc_id", "ids"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")

    def round_trip(self, docs: DataFrame) -> DataFrame:
        """What decode(encode(docs)) gives, by one Python worker for each task instead of two: doc_id, ids, decoded."""
        vocabulary, pattern = self.vocabulary, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, tokens = _load(vocabulary, pattern), token_bytes(vocabulary.value)
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    ids = coder.encode(batch.column(1).slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, decode(tokens, ids)], ["doc_id", "ids", "decoded"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """Adds decoded, binary: the bytes that ids stand for."""
        vocabulary = self.vocabulary
        kind = encoded.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = token_bytes(vocabulary.value)
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    ids = batch.column(1).slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, decode(tokens, ids)], ["doc_id", "ids", "decoded"])

        return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_coder(spark: SparkSession) -> ByteBPE:
    import public_tokenizers

    return ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = public_coder(spark)
    return digests(coder.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet")))
