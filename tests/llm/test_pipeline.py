"""The pipeline's stages, each against a plain version of what it should keep."""

import hashlib

import pytest

pytest.importorskip("lagloom.llm")
import corpus_pipeline  # noqa: E402
from lagloom.llm import quality  # noqa: E402
from tests.llm.test_llm import awkward, normal, nothing, plain_near  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = [r.asDict() for r in docs.collect()]
    model = quality.train_quality(spark, SF)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        after = [r.asDict() for r in out.collect()]
        if n < 4:
            assert out.columns == docs.columns
        if name == "quality classifier":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if model.score([r["text"]])[0] >= quality.THRESHOLD}
            bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            assert len({r["doc_id"] for r in after} & bad) <= 0.1 * len(bad) + 1
        elif name == "exact dedup":
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(hashlib.sha256(normal(r["text"]).encode()).digest(), r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(first.values())
        elif name == "near-dedup by shingles":
            rows = sorted(before, key=lambda r: r["doc_id"])
            root = plain_near([r["text"] for r in rows])
            assert sorted(r["doc_id"] for r in after) == sorted({rows[r]["doc_id"] for r in root})
        elif name == "mixing to target weights":
            times = {}
            for r in after:
                times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
            assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in before}
        else:
            want = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in before)
            assert sorted((r["doc_id"], r["decoded_sha256"]) for r in after) == want
        docs, before = out, after


def test_awkward_and_empty(spark):
    for docs in (awkward(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 3 * docs.count()
            if name != "byte-level BPE":
                assert out.columns == docs.columns


def test_near_dedup_takes_simhash_links(spark, monkeypatch):
    """The stage compares what SimHash links, exactly, also where no MinHash band is shared."""
    import random

    from lagloom.llm import near_copies, simhash

    # Of similarity 0.3 or more, without a common band: only the SimHash buckets hold both.
    for seed in range(100):
        rnd = random.Random(seed)
        words = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        other = words[:35] + [f"v{rnd.randrange(10**6)}" for _ in range(25)]
        sets = [near_copies.shingle_set(" ".join(w)) for w in (words, other)]
        alike = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
        if alike >= 0.36 and not set(near_copies.band_keys(sets[0])) & set(near_copies.band_keys(sets[1])):
            break
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "some other text")], "doc_id long, text string")
    monkeypatch.setattr(simhash, "near_duplicates", lambda d, shingle: d.selectExpr("doc_id", "'' as fingerprint", "1L as component_id"))
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, similarity=0.36).collect()) == [1, 3]
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, similarity=0.5).collect()) == [1, 2, 3]
    # Without stand-ins: fingerprints of a long text and of one with its last word changed are linked.
    monkeypatch.undo()
    long = [f"w{i % 7}x{i}" for i in range(2000)]
    same = spark.createDataFrame([(1, " ".join(long)), (2, " ".join([*long[:-1], "end"])), (3, "some other text")], "doc_id long, text string")
    assert {r.doc_id for r in near_copies.alike_bits(same).collect()} == {1, 2}
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, same, SF).orderBy("doc_id").collect()] == [1, 3]
