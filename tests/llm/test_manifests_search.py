"""Edit fingerprints, Merkle manifests and lexical search against brute force, on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lagloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from lagloom.llm import edit_embedding, lexical, merkle  # noqa: E402
from tests.llm.test_llm import SF, awkward, nothing  # noqa: E402

# Edit embedding


def plain_walk(text, steps=None):
    """The walk as the method says, one step at a time."""
    import xxhash

    out, i, step = [], 0, 0
    while i < len(text):
        out.append(text[i])
        bits = xxhash.xxh64_intdigest(text[i].encode(), 11) | 1
        i += bits >> (step % edit_embedding.PERIOD) & 1
        step += 1
    return "".join(out)


def test_walk_step_by_step():
    own = edit_embedding.Walker()
    for text in ("", " ", "a", "a  b ", "the cat sat on the mat " * 20, "中文é😀" * 50, "x" * 300, "a\nb\tc"):
        assert own.walk(text, 0) == plain_walk(text)
        digits, step = own.sample(text)
        assert step == len(plain_walk(text)) and len(digits) == sum(p < step for p in edit_embedding.PLACES)
        for at in (0, 1, len(text) // 2, len(text)):  # a walk can be broken off and taken up anywhere
            a, there = own.sample(text[:at])
            assert a + own.sample(text[at:], there)[0] == digits


def test_walk_over_stretches(monkeypatch):
    text = "some words that go on and on " * 200
    whole = edit_embedding.Walker().sample(text)
    monkeypatch.setattr(edit_embedding, "STRETCH", 37)
    monkeypatch.setattr(edit_embedding, "PIECES", 5)
    monkeypatch.setattr(edit_embedding, "CHARACTERS", 3)
    assert edit_embedding.Walker().sample(text) == whole


def test_likeness_follows_edits():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    few, many, other = [], [], []
    for _ in range(30):
        text = " ".join(rnd.choice(words) for _ in range(400))
        edit = lambda t, n: "".join(rnd.choice(["", c + rnd.choice("xyz"), "q"]) if rnd.random() < n / len(t) else c for c in t)
        mark = edit_embedding.fingerprint(text)
        few.append(edit_embedding.likeness(mark, edit_embedding.fingerprint(edit(text, 2))))
        many.append(edit_embedding.likeness(mark, edit_embedding.fingerprint(edit(text, 60))))
        other.append(edit_embedding.likeness(mark, edit_embedding.fingerprint(" ".join(rnd.choice(words) for _ in range(400)))))
    assert np.mean(few) > 0.8 > np.mean(many) > np.mean(other) and max(other) < 0.25
    assert edit_embedding.likeness("", "") == 1 and edit_embedding.likeness("", "1") == 0


def next_texts(rows):
    """(doc_id, text, next text) in the order of the contract; of repeated ids by text, null ids last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    return [(a, t or "", u or "") for (a, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True)]


def edited(text, follows):
    half = len(text) // 2
    return text[: len(text) - half] + follows[:half]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_edited_prints_awkward(spark, partitions):
    docs = awkward(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = [tuple(r) for r in edit_embedding.edited_prints(docs).collect()]
        assert edit_embedding.edited_prints(nothing(spark)).count() == 0
        one = edit_embedding.edited_prints(docs.where("doc_id = 9")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for id_, text, follows in next_texts([tuple(r) for r in docs.select("doc_id", "text").collect()]):
        e = edited(text, follows)
        a, b, c = (edit_embedding.fingerprint(x) for x in (text, e, follows))
        want.append((id_, len(text), hashlib.sha256(e.encode()).hexdigest(), a, b, edit_embedding.likeness(a, b), edit_embedding.likeness(a, c)))
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert len(one) == 1 and one[0].near_edited >= 0.5 and one[0].near_next == 1


def test_edit_query(spark):
    rows = edit_embedding.op11_edit_fingerprints(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: hashlib.sha256(edited(t, n).encode()).hexdigest() for i, t, n in next_texts(list(texts.items()))}
    assert {r.doc_id: r.edited_sha256 for r in rows} == want and len(rows) == len(texts)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.98 * len(rows)
    assert {r.doc_id: r.fingerprint for r in rows} == {i: edit_embedding.fingerprint(t) for i, t in texts.items()}


def test_edit_classes(spark):
    """Copies with a few edits share a class, whatever the size of the group; others stay alone. Links between representatives are all found."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.choice([40, 150, 600]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:20]):
        at = rnd.randrange(len(t))
        rows.append((100 + i, t[:at] + "z" + t[at + 1 :]))
        rows.append((200 + i, t))
    rows += [(300 + i, base[0][:-1] + chr(97 + i % 26)) for i in range(60)]
    rows += [(900, None), (901, ""), (None, base[1]), (39, "an id that comes twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = defaultdict(set)
    for r in edit_embedding.edit_classes(docs, alike=0.8, tile_bytes=4000).collect():
        found[r.doc_id].add(r.class_id)
    got = {k: min(v) for k, v in found.items() if k is not None and k != 39}
    marks = {i: edit_embedding.fingerprint(t) for i, t in rows if i is not None and i != 39}
    parent = {i: i for i in marks}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = {i: set(edit_embedding.bands(m)) for i, m in marks.items()}
    for i in marks:
        for j in marks:
            if i < j and keys[i] & keys[j] and edit_embedding.likeness(marks[i], marks[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in marks}
    assert all(got[200 + i] == i for i in range(20)) and got[359] == 0 and got[901] == 900
    assert sum(got[100 + i] == i for i in range(20)) >= 16
    assert edit_embedding.edit_classes(nothing(spark)).count() == 0


# Merkle manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_manifest(rows, fanout=3):
    """doc_id, leaf, subroot, root, siblings of each of (doc_id, source, lang, n_chars, text), by recursion."""

    def tree(nodes):
        if len(nodes) == 1:
            return nodes[0], [[]]
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        top, above = tree([h("".join(r)) for r in runs])
        return top, [[(r[:k], r[k + 1 :]), *above[i]] for i, r in enumerate(runs) for k in range(len(r))]

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], plain_leaf(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    root, tops = tree([trees[s][0] for s in names])
    return [(x[0], x[1], trees[s][0], root, path + tops[names.index(s)], x[2]) for s in names for x, path in zip(groups[s], trees[s][1], strict=True)]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_awkward(spark, fanout):
    docs = awkward(spark)
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    want = [(i, leaf, sub, root, [("".join(a), "".join(b)) for a, b in path]) for i, leaf, sub, root, path, _ in plain_manifest([(r[0], r[1], r[2], r[3], r[4]) for r in rows], fanout)]
    found = merkle.manifest(docs, fanout=fanout)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "path"]
    got = [(r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), [(p.left.hex(), p.right.hex()) for p in r.path]) for r in found.collect()]
    # A source of many rows and several sources of one to a few.
    assert sorted(got, key=repr) == sorted(want, key=repr)
    folded = found.select(merkle.folded(F.col("leaf"), F.col("path")).alias("f"), "root").collect()
    assert all(r.f == r.root for r in folded)


def test_manifest_small(spark):
    assert merkle.manifest(nothing(spark)).count() == 0
    one = merkle.manifest(awkward(spark).where("doc_id = 9")).first()
    assert one.leaf == one.subroot == one.root and one.path == []
    lone = spark.createDataFrame([(i, f"s{i}", None, None, None) for i in range(4)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.manifest(lone).collect()
    assert all(r.leaf == r.subroot for r in rows) and len({r.root for r in rows}) == 1 and [len(r.path) for r in rows] == [2] * 4


def test_manifest_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*merkle.FIELDS)
    got = {r.doc_id: r for r in merkle.op12_merkle_manifest(spark, SF).collect()}
    for id_, leaf, sub, root, path, row in plain_manifest([tuple(r) for r in docs.collect()]):
        r = got.pop(id_)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, sub, root, h("".join("".join(a) + "".join(b) for a, b in path)))
        text = row[4]
        if zlib.crc32(str(id_).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        at = plain_leaf(row, text)
        for a, b in path:
            at = h("".join(a) + at + "".join(b))
        assert (r.folded_root, r.verified) == (at, at == root)
    assert not got


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain_search(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in held]
    some, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * some + 2) / (2 * x + 1))) for t, x in df.items()}
    out, asked = [], defaultdict(list)
    for i, t in items:
        asked[i] += plain_terms(t)
    for item, terms in asked.items():
        scores = []
        for (i, c), length in zip(held, n, strict=True):
            m = 75 + (25 * length * some) // total if total else 0
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_terms():
    rnd = random.Random(2)
    letters = [chr(b) for b in range(128)] + list("éÉßñ中😀\x85 ﬀİ")
    texts = ["", None, " ", "A", "a-b_C", *("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(300))]
    for array in (pa.array(texts), pa.array(["junk", *texts])[1:], pa.array([], pa.string()), pa.array([None, None], pa.string())):
        row, code, terms = lexical.terms_of(array)
        got = [[] for _ in array]
        for r, c in zip(row.tolist(), code.tolist(), strict=True):
            got[r].append(terms[c])
        assert got == [plain_terms(t) for t in array.to_pylist()]


def test_slices_add_up():
    rnd = np.random.default_rng(4)
    for docs in (1, 63, 64, 300):
        ids = rnd.integers(0, 50, docs)
        index = lexical.BlockIndex(ids, np.zeros(docs, bool), np.ones(docs, np.int64), np.full(docs, 100))
        want, weights = np.zeros((6, docs), np.int64), np.array([0, 1, 7, 1000, 25_000, 60_000])
        for t in range(6):
            at = np.flatnonzero(rnd.random(docs) < rnd.choice([0.05, 0.5, 1]))
            tf = rnd.integers(1, 9, len(at))
            index.add(np.array([t]), weights[t : t + 1], np.array([len(at)]), at, tf)
            want[t, at] = weights[t] * ((10**9 * tf) // (1000 * tf + 1200))
        index.slice_up()
        question = [(t, int(q)) for t, q in enumerate([1, 3, 0, 1, 2, 11]) if q] + [(77, 1)]
        scores = sum(want[t] * q for t, q in question if t < 6)
        sums = index.sums(question)
        for k in (1, 2, 20, 1000):
            docs_, found = index.best(sums, k) if sums is not None else (np.zeros(0, int), np.zeros(0, int))
            best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s > 0)[:k]
            assert sorted((-s, i) for s, i in zip(found.tolist(), ids[docs_].tolist(), strict=True)) == best


@pytest.mark.parametrize(("limits", "block"), [({}, 8192), ({}, 5), ({"QUESTIONS": 2, "VOCABULARY": 0}, 8)])
def test_search_awkward(spark, monkeypatch, limits, block):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs = awkward(spark)
    texts = ["the haus and 12", "x" * 300, None, "", "--", "été Été ÉTÉ 中文 3.5 3 5 5", "the the the the the and", "another text under the same id", "nothinghasthis"]
    items = spark.createDataFrame([*enumerate(texts), (0, "and und"), (None, "haus")], "item_id long, text string").withColumn("term", F.lit("x"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain_search(rows, [tuple(r) for r in items.select("item_id", "text").collect()], 5)
    found = [tuple(r) for r in lexical.search(docs, items, k=5, block=block).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert lexical.search(nothing(spark), items).count() == 0 and lexical.search(docs, items.where("false")).count() == 0


def test_search_query(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 20)
    assert sorted(tuple(r) for r in lexical.op13_lexical_search(spark, SF).collect()) == sorted(want)
