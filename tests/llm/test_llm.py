"""The corpus operators against brute force, and on awkward input."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lagloom.llm")

import public_tokenizers  # noqa: E402
import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from lagloom.llm import byte_bpe, common, exact_dedup, hilbert, language, mixing, near_copies, quality, simhash, token_store, topk, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, __id long, row string, key string, shard string"


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, names that operators use."""
    rnd = random.Random(3)
    words = ["the", "and", "Haus", "été", "niño", "12", "3.5", "—", "中文", "x" * 300]
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    texts = [None, "", " \t\n", "a", "a", "a b", "a  b", "a\r\nb", long, long, "x" * 20_000, "Ünï cödé 😀", "!!! ??? ###", "\r", "\u2003 \x85 \x1c"]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", "ü", None]), None if t is None else len(t), "d", i, "r", "k", "s") for i, t in enumerate(texts)]
    rows += rows[3:6] + [(None, "a", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)] + [(7, "another text under the same id", "en", "s1", 3, "", 1, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(text):
    out, run = [], False
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if not run:
                out.append(" ")
            run = True
        else:
            out.append(c)
            run = False
    return "".join(out)


def test_curve_is_a_hilbert_curve(spark):
    for n, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n).tolist()
        rows = spark.createDataFrame([(c,) for c in cells], "c array<int>").select("c", hilbert.hilbert_index([F.col("c")[i] for i in range(n)], bits).alias("h")).collect()
        path = [r.c for r in sorted(rows, key=lambda r: r.h)]
        assert sorted(r.h for r in rows) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:]))


def test_sharding_awkward(spark):
    docs = awkward(spark)
    rows = hilbert.shard_by_curve(docs, ["lang", "source", "n_chars"], 7).collect()
    texts = docs.select("doc_id", "text").collect()
    counts = np.bincount([r.shard for r in rows], minlength=7)
    assert counts.sum() == len(texts) and counts.max() - counts.min() <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    sums = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == sums
    order = [(r.curve, r.text_crc32) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert hilbert.shard_by_curve(nothing(spark), ["lang", "source", "n_chars"]).count() == 0


def test_sharding_long_prefixes(spark):
    docs = spark.createDataFrame([(i, f"common_crawl_{2000 + i % 20}") for i in range(400)] + [(900, None)], "doc_id long, source string")
    rows = docs.select("source", hilbert.curve_order(docs.select("source"), ["source"]).alias("curve")).distinct().collect()
    assert len(rows) == 21 and len({r.curve for r in rows}) == 21
    assert [r.source for r in sorted(rows, key=lambda r: r.curve)] == sorted((r.source for r in rows), key=lambda v: v or "")


def test_shards_written(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hilbert.write_shards(docs, str(tmp_path / "out"), ["lang", "source"], 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("shard").distinct().count() == 5
    assert back.select(*docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()


def test_shards_written_whole(spark, tmp_path):
    docs = awkward(spark)  # repeated doc_ids, a column called shard
    hilbert.write_shards(docs, str(tmp_path / "out"), ["lang", "source", "n_chars"], 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    same = lambda df: sorted(map(repr, df.select(*docs.columns).collect()))
    assert same(back.withColumn("shard", F.col("shard").cast("string"))) == same(docs)
    slots = back.groupBy("_shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert len(slots) == 5 and all(r.s == list(range(len(r.s))) for r in slots)
    hilbert.write_shards(nothing(spark), str(tmp_path / "none"), ["lang"], 5)


def test_shards_prune(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dims, shards = ["lang", "source", "n_chars"], 24
    rows = hilbert.shard_by_curve(docs, dims, shards).select("doc_id", "shard").join(docs, "doc_id").select("shard", *dims).toPandas()

    def opened(df, c, sets=False):
        """Shards on average that a filter for a value opens, by least and greatest values or by the values there are."""
        of = df.groupby("shard")[c]
        if sets:
            return np.mean([sum(v in s for s in of.agg(set)) for v in df[c].unique()])
        low, high = of.min().to_numpy(), of.max().to_numpy()
        return np.mean([((low <= v) & (high >= v)).sum() for v in df[c].unique()])

    plain = rows.sort_values(dims).reset_index(drop=True)
    plain["shard"] = plain.index * shards // len(plain)
    assert opened(rows, "lang", sets=True) < shards / 2
    assert opened(rows, "source") < shards / 2 and opened(rows, "n_chars") < shards / 2 < opened(plain, "n_chars")


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.op2_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    right, n = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_language_awkward(spark):
    docs = awkward(spark)
    model = language.train(docs)
    rows = language.label_spans(docs, model).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) or r.doc_id == 7
        assert 0 <= r.score <= 1
        if r.spans and r.doc_id != 7:
            assert r.spans[0].start == 0 and r.spans[-1].end == len(r.text)
    assert language.label_spans(docs, model).count() == docs.count()
    assert {r.lang_pred for r in language.label_spans(docs, language.train(nothing(spark))).collect()} == {"und"}
    assert language.label_spans(nothing(spark), model).count() == 0


def test_language_paths_are_best(spark):
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b", "c"], 4, np.zeros((16, 3)), np.ones((len(language._NAMES), 3), bool), penalty=3.0)
    for _ in range(200):
        scores = rng.normal(size=(rng.integers(1, 7), 3)) * rng.choice([0.5, 3, 6])
        value = lambda p: scores[np.arange(len(p)), p].sum() - 3.0 * (np.diff(p) != 0).sum()  # noqa: B023, E731
        best = max(value(np.array(p)) for p in np.ndindex(*[3] * len(scores)))
        assert abs(value(model.path(scores)) - best) < 1e-9
        assert abs(value(model.viterbi(scores)) - best) < 1e-9


def test_language_path_without_best():
    model = language.Model(["a", "b", "c"], 4, np.zeros((16, 3)), np.ones((len(language._NAMES), 3), bool), penalty=3.0)
    assert model.path(np.array([[2.5, -10, 0], [-10, 2.5, 0]])).tolist() == [0, 1]


def test_language_word_scores():
    languages, bits = ["a", "b", "c"], 10
    rng = np.random.default_rng(9)
    uses = np.ones((len(language._NAMES), 3), bool)
    uses[language._NAMES.index("Greek")] = [False, True, False]
    model = language.Model(languages, bits, rng.normal(size=(1 << bits, 3)), uses)
    words = ["x", "straße", "λόγος", "word", "é" * 9]

    def plain(word):
        marked, total = [2, *map(ord, word), 3], np.zeros(3)
        for n in (1, 2, 3, 4):
            for i in range(len(marked) - n + 1):
                if n == 1 and marked[i] <= 3:
                    continue
                h = 0
                for k in range(n):
                    h = (h + marked[i + k] + k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
                    h ^= h >> 31
                total += model.weights[h >> (64 - bits)]
        return total / 4

    got = model.score_words(words)
    for w, row in zip(words, got, strict=True):
        want = plain(w)
        if w == "λόγος":
            assert np.isclose(row[1], want[1]) and max(row[0], row[2]) <= row[1] - 2 * model.penalty
        else:
            assert np.allclose(row, want)


def test_language_rare(spark):
    rows = [(i, "the and of to in that is was " * 5, "en") for i in range(600)] + [(1000 + i, "žluťoučký kůň úpěl ďábelské ódy " * 3, "cs") for i in range(3)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=20)
    assert model.languages == ["cs", "en"] and model.read(["kůň úpěl"])[0][0] == "cs"
    nothing_known = language.train(nothing(spark))
    assert nothing_known.read(["some text"])[0][:2] == ("und", 0.0) and language.label_spans(nothing(spark), model).count() == 0


def test_language_spans_and_scripts(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog were in the house of the king", "en"), ("der Hund und die Katze waren in dem Haus des Königs", "de"), ("кошка и собака были в доме короля", "ru")] * 20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), penalty=4.0)
    text = "the dog and the cat in the house " * 3 + "die Katze und der Hund in dem Haus " * 3 + "собака и кошка в доме"
    (lang, _, spans) = model.read([text])[0]
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert text[spans[1][0] :].startswith("die Katze") and text[spans[2][0] :].startswith("собака")


def target_loop(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in held]
        rest = total - sum(3 * sizes[n] for n in held)
        got = {n: 3.0 * sizes[n] if n in held else rest * weight[n] / sum(weight[m] for m in free) for n in names}
        over = {n for n in free if got[n] > 3 * sizes[n]}
        if not over:
            return got
        held |= over


def test_mixing_awkward(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs, block_words=16).documents().collect()
    assert len(rows) == docs.count()
    where = {}
    for r in docs.select("doc_id", "source", "text").collect():
        where.setdefault((r.doc_id, len((r.text or "").encode().split())), set()).add(r.source)
    sizes = {}
    for r in docs.select("source", "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    want = target_loop(sizes)
    taken = {}
    for r in rows:
        sources = where[r.doc_id, r["size"]]
        assert any(sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-6 for s in sources)
        assert r.taken <= 3 * r["size"]
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert len(set(sizes.values())) == len(sizes)
    for s, n in sizes.items():
        assert taken[n] == int(want[s])
    assert mixing.mix(nothing(spark)).documents().count() == 0
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.taken)
    again = mixing.mix(docs.repartition(2), block_words=16).documents().collect()
    assert sorted(map(key, rows), key=str) == sorted(map(key, again), key=str)


def test_mixing_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix(docs, block_words=64, shard_blocks=50, with_words=True)
    blocks, per_doc = plan.blocks().collect(), plan.documents().collect()
    assert sum(len(b.words) for b in blocks) == sum(r.taken for r in per_doc)
    assert len({(b.shard, b.slot) for b in blocks}) == len(blocks) and max(len(b.words) for b in blocks) == 64
    count = {}
    for b in blocks:
        count[b.shard] = count.get(b.shard, 0) + 1
    assert all(n == 50 for s, n in count.items() if s < max(count))
    known = {w for r in docs.collect() for w in (r.text or "").split()}
    assert all(w in known for b in blocks for w in b.words)


def test_mixing_counts_are_multinomial(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.mix(docs, block_words=16, shard_blocks=500)
    draws = plan.draws.select("key", "shard", "slot").toPandas()
    n = draws.groupby("key").size()
    want = {("" if k is None else f"={k}"): v for k, v in target_loop({r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD))).alias("n")).collect()}).items()}
    # Totals are those of the targets, up to the part blocks at the ends of streams; each slot is drawn once.
    assert set(n.index) == set(want) and all(abs(n[k] * 16 - v) <= 16 * 4 for k, v in want.items())
    assert not draws.duplicated(["shard", "slot"]).any() and (draws.groupby("shard").size().iloc[:-1] == 500).all()
    counts = draws.groupby(["shard", "key"]).size().unstack(fill_value=0).iloc[:-1]
    expected = n[counts.columns].to_numpy() / n.sum() * 500
    ratio = ((counts.to_numpy() - expected) ** 2 / expected).sum() / (len(counts) * (len(n) - 1))
    assert 0.85 < ratio < 1.15
    assert draws.sort_values(["shard", "slot"]).reset_index(drop=True).equals(mixing.mix(docs.repartition(3), block_words=16, shard_blocks=500).draws.select("key", "shard", "slot").toPandas().sort_values(["shard", "slot"]).reset_index(drop=True))


def test_mixed_words_near_target(spark):
    rnd = random.Random(7)
    lengths = [("s00", rnd.choice([40, 300, 2600, 4000])) for _ in range(400)] + [(f"s{n:02d}", rnd.randint(100, 1500)) for n in range(1, 20) for _ in range(60)]
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(lengths)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sizes = {}
    for s, n in lengths:
        sizes[s] = sizes.get(s, 0) + n
    want, got, long = target_loop(sizes), {}, 0
    for r in mixing.mixed_documents(docs).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        long += r.source == "s00" and len(r.text.split()) > 2560
    assert want["s00"] < 0.3 * sizes["s00"] and long > 0
    largest = {s: max(n for t, n in lengths if t == s) for s in want}
    assert all(abs(got[s] - want[s]) <= largest[s] + 1 for s in want), {s: (got.get(s), want[s], largest[s]) for s in want}


def test_targets_held(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 3, None: 7}, {"x": 5}, {"a": 0, "b": 9, "c": 100, "d": 1, "e": 2, "é": 4}, {"a": 0}):
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        want = target_loop(sizes)
        for r in mixing.targets(df).collect():
            assert abs(r.target - want[r.source]) < 1e-9


def test_permutation(spark):
    for n in (1, 2, 3, 17, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit("s")).alias("x"))
        assert sorted(r.x for r in got.collect()) == list(range(n))


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://org", "http://org/", "https://A.EXAMPLE.org/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2",
        "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/FR/", "http://com/de/9", "http://xcom/de/9", "http://x.com?/de/", "http://x.com#a/fr/", "http://ads-track.x.net/en/",
        "http://m.ads-track.example.com/fr/3", "http://loads-track.x.net/", "http://x.net/ads/1", "http://x.net/casino", "http://x.net/casinos", "ftp://u@x.org:80/", "a://b://c.org/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[5:7])], "page_id long, url string, key string")
    rows = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.public_rules()).collect()}
    for r in rows.values():
        url = (urls + urls[5:7])[r.page_id]
        # All rules in turn, without the index.
        fit = [x for x in url_filter.public_rules() if url is not None and x.fits("".join(url_filter.parts_of(url)), url.translate(url_filter._LOWER))]
        prefix = max((x for x in fit if x.kind == "prefix" and r.host), key=lambda x: len(x.text), default=None)
        pattern = next((x for x in fit if x.kind == "pattern"), None)
        assert r.rule == (prefix.text if prefix else None) and r.pattern == (pattern.text if pattern else None)
    verdicts = {urls[i]: (rows[i].rule, rows[i].verdict) for i in range(len(urls))}
    assert verdicts["https://A.EXAMPLE.org/es/1?x#y"] == ("example.org/es/", "block")
    assert verdicts["http://example.org/en/12"] == ("example.org/en/1", "block")
    assert verdicts["http://notexample.org/es/"] == ("org/", "allow")
    assert verdicts["http://org"] == (None, "allow") and verdicts["http://com/de/9"] == ("com/de/", "block")
    assert verdicts["http://ads-track.x.net/en/"] == (None, "block") and verdicts["http://m.ads-track.example.com/fr/3"] == ("com/fr/", "allow")
    assert verdicts["http://loads-track.x.net/"] == (None, "allow") and verdicts["http://x.net/casinos"] == (None, "allow")
    assert rows[0].host == "" and rows[0].path == "" and verdicts["a://b://c.org/"] == (None, "allow")
    assert url_filter.judge_urls(pages.limit(0), url_filter.public_rules()).count() == 0


def test_thousands_of_url_rules():
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "klmnprst"]
    hosts = [f"{rnd.choice(words)}.{rnd.choice(words)}.{t}" for t in ("com", "org", "net") for _ in range(60)]
    rules = [url_filter.Rule(rnd.choice(["allow", "block"]), f"{rnd.choice(hosts)}/{rnd.choice(words)}", "prefix") for _ in range(1500)]
    patterns = ["||{a}.*^", "||{a}.{b}^", "/{a}/*/{b}", "^{a}^", "/{a}-{b}.", "*{a}/{b}/*", "={a}&", "{a}*{b}^"]
    rules += [url_filter.Rule("block", rnd.choice(patterns).format(a=rnd.choice(words), b=rnd.choice(words)), "pattern") for _ in range(1500)]
    plain = []
    for r in rules:
        body = re.escape(r.text.removeprefix("||")).replace(r"\*", ".*").replace(r"\^", r"([^a-z0-9_.%-]|$)")
        plain.append(re.compile((r"^[^/?#]*://([^/?#]*\.)?" if r.text.startswith("||") else "") + body))
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'www.', 'A.'])}{rnd.choice(hosts)}/{'/'.join(rnd.choices(words, k=rnd.randint(0, 4)))}{rnd.choice(['', '/', '.html', '?q=' + rnd.choice(words) + '&x', '-' + rnd.choice(words) + '.js'])}" for _ in range(1500)]
    often = {}
    for u in urls:
        for t in url_filter.tokens_of(u):
            often[t] = often.get(t, 0) + 1
    index, tried, fitting = url_filter.RuleIndex(rules, often), 0, 0
    for u in urls:
        host, path = url_filter.parts_of(u)
        fit = []
        for r, compiled in zip(rules, plain, strict=True):
            if r.kind == "prefix":
                own, slash, rest = r.text.partition("/")
                if (host == own or host.endswith("." + own)) and path.startswith(slash + rest):
                    fit.append(r)
            else:
                if compiled.search(u.lower()):
                    fit.append(r)
        prefix = max((r for r in fit if r.kind == "prefix"), key=lambda r: len(r.text), default=None)
        pattern = next((r for r in fit if r.kind == "pattern"), None)
        got = index.judge(u)
        assert got[2] == (prefix and prefix.text) and got[4] == (pattern and pattern.text), (u, got)
        assert got[3] == (prefix or pattern or url_filter.Rule("allow", "x", "pattern")).verdict
        tried, fitting = tried + got[5], fitting + len(fit)
    # Rules without a whole token run for every URL; of the others few do.
    assert fitting > 100 and len(index.always) < 250 and tried - len(index.always) * len(urls) < 0.03 * len(rules) * len(urls)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 9).astype(float).tolist() if i % 3 else rng.normal(size=9).tolist()) for i in range(400)]
    rows += [(400, None), (450, [1.0, None] + [0.0] * 7), (500, [float("nan")] * 9), (550, [float("inf")] * 9), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (650, []), (651, []), (652, []), (None, [1.0] * 9)] + rows[50:52] + rows[7:9]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in dict(whole).items():
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:5]
            assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_blocks(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = vectors.where("vec_id % 3 = 0")
    want = sorted(topk.top_k(vectors, asked).collect())
    for name, value in (("QUERIES", 7), ("CANDIDATES", 20), ("AT_ONCE", 3), ("BLOCK", 8)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(topk.top_k(vectors, asked).collect()) == want
    plan = topk.top_k(vectors, asked)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1


def test_top_k_large_values():
    rng = np.random.default_rng(1)
    q, c = (np.floor(rng.normal(size=(n, 20)) * 1e6).astype(np.int64) for n in (3, 200))
    i, j, s = topk.best_of(q, np.array([-1, -2, -3]), np.ascontiguousarray(c.T), np.arange(200), 5, np.full(3, -np.inf))
    for a in range(3):
        best = sorted((-sum(int(x) * int(y) for x, y in zip(q[a], w, strict=True)), n) for n, w in enumerate(c))[:5]
        assert [(-int(x), int(y)) for x, y in zip(s[i == a], j[i == a])] == best


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def test_bpe_like_tiktoken(spark, vocabulary):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(vocabulary), special_tokens={})
    ours, tokens = byte_bpe.TextEncoder(vocabulary, public_tokenizers.PATTERN), byte_bpe.token_bytes(vocabulary)
    rnd = random.Random(1)
    signs = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", " ", "é", "中", "1", "23", "½", "!", "'s", "'ll", "😀", "\r\n", "\r", "\x1c", "\x85", "_", "\0", "\u200b", "\xa0", "<|endoftext|>", ",", ".", "Ü", "×", "÷", "\u2003", "\u3000", " \n", "\n\n", ".,"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [None, "", "a" * 3000, " " * 500 + "x", "\n", "a\n"]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        ids = ours.encode(pa.array([None, *some], pa.string())[1:])
        for text, packed, decoded in zip(some, ids, byte_bpe.decode(tokens, ids), strict=True):
            assert np.frombuffer(packed.as_py(), "<u4").tolist() == library.encode_ordinary(text or "")
            assert decoded.as_py() == (text or "").encode()


def test_bpe_edits(vocabulary):
    pieces = byte_bpe.PrefixEncoder(byte_bpe.parse_ranks(vocabulary))
    rnd = random.Random(5)
    table, data = byte_bpe.Prefixes(pieces), b""
    for _ in range(60):
        new = bytes(rnd.choice(b"thingorsaeu ") for _ in range(rnd.randint(0, 6)))
        if rnd.random() < 0.5:
            table.append(new)
            data += new
        else:
            a = rnd.randint(0, len(data))
            b = rnd.randint(a, min(len(data), a + 4))
            table.replace(a, b, new)
            data = data[:a] + new + data[b:]
        assert table.data == data and table.ids() == (pieces.merged(data) if data else [])


def test_bpe_awkward(spark):
    docs = awkward(spark)
    coder = byte_bpe.public_coder(spark)
    rows = byte_bpe.digests(coder.decode(coder.encode(docs))).collect()
    want = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    assert sorted(r.decoded_sha256 for r in rows) == want
    order = lambda r: (r.ids_sha256, r.decoded_sha256, str(r.doc_id))
    assert sorted(rows, key=order) == sorted(byte_bpe.digests(coder.round_trip(docs)).collect(), key=order)
    assert coder.encode(nothing(spark)).count() == 0


def test_exact_dedup_awkward(spark):
    docs = awkward(spark)
    source = docs.select("doc_id", "text").collect()
    index = exact_dedup.DigestIndex(spark, common.shared_path(spark, "digests"), 4)
    rows = index.add(docs).collect()
    groups = {}
    for r in source:
        groups.setdefault(hashlib.sha256(normal(r.text).encode()).hexdigest(), []).append(r.doc_id)
    assert len(rows) == len(source) and {r.text_sha256 for r in rows} == set(groups)
    low = lambda ids: min(ids, key=lambda i: (i is not None, i))
    for r in rows:
        assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == low(groups[r.text_sha256])
    for sha in groups:
        kept = [r for r in rows if r.text_sha256 == sha and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    # A second batch: known texts go, new ones enter; an index opened again is the same.
    more = spark.createDataFrame([(-1, "a"), (900, "entirely new"), (901, "entirely  new")], "doc_id long, text string")
    again = {r.doc_id: r for r in exact_dedup.DigestIndex(spark, index.path, 4).add(more).collect()}
    assert not again[-1].kept and again[-1].keep_id is None and again[900].kept and not again[901].kept
    assert index.read().count() == len(groups) + 1
    assert index.add(nothing(spark)).count() == 0
    index.compact()
    assert len(index.state()[1]) == 1 and index.read().count() == len(groups) + 1
    kept = exact_dedup.keep_first(docs, exact_dedup.DigestIndex(spark, common.shared_path(spark, "digests"), 4))
    assert kept.columns == docs.columns and kept.count() == len(groups)


def texts(spark, numbers, start=0):
    return spark.createDataFrame([(start + n, f"text {n}") for n in numbers], "doc_id long, text string")


def decisions(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_index_batch_run_again(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark, common.shared_path(spark, "digests"), 2)
    first = decisions(index.add(texts(spark, range(30)), "monday"))
    assert sum(r[3] for r in first) == 30
    second = decisions(index.add(texts(spark, range(20, 40), 100), "tuesday"))
    assert sum(r[3] for r in second) == 10
    # A batch that was entered but not delivered gets the same again.
    assert decisions(index.add(texts(spark, range(20, 40), 100), "tuesday")) == second
    assert decisions(index.add(texts(spark, range(30)), "monday")) == first
    # One that failed before it was published has entered nothing.
    with monkeypatch.context() as m:
        m.setattr(exact_dedup.DigestIndex, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(texts(spark, range(35, 50), 200), "wednesday")
    assert index.read().count() == 40
    third = decisions(index.add(texts(spark, range(35, 50), 200), "wednesday"))
    assert sum(r[3] for r in third) == 10
    # The same texts under another name, or none, are new rows of known texts.
    assert not any(r[3] for r in decisions(index.add(texts(spark, range(35, 50), 200))))
    index.compact()
    assert len([n for n in common.file_names(spark, index.path) if n.startswith("part-")]) == 1
    assert decisions(index.add(texts(spark, range(35, 50), 200), "wednesday")) == third
    assert index.read().count() == 50 == index.read().select("digest").distinct().count()


@pytest.mark.parametrize("step", ["_write 1", "_write 2", "_publish 1", "cut 3"])
def test_index_batch_dies(spark, monkeypatch, step):
    """A batch that is run again and dies between any two steps changes no decision, nor do batches that are run again after it, in any order."""
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before = tables()
    index = exact_dedup.DigestIndex(spark, common.shared_path(spark, "digests"), 2)
    batches = {"x1": [(1, "a"), (2, "b"), (3, "a")], "x2": [(5, "a"), (6, "z")], "x3": [(7, "z"), (8, "y")]}
    run = lambda b: sorted(map(tuple, index.add(spark.createDataFrame(batches[b], "doc_id long, text string"), b).select("doc_id", "keep_id", "kept").collect()))
    want = {b: run(b) for b in batches}
    held = index.add(spark.createDataFrame([(9, "q")], "doc_id long, text string"), "x4")
    index.compact()  # all batches are in one part: x1 has to be taken out of it
    name, calls = step.split()
    left = [int(calls)]
    owner = exact_dedup if name == "cut" else exact_dedup.DigestIndex
    real = getattr(owner, name)

    def dies(*args):
        left[0] -= 1
        if not left[0]:
            raise RuntimeError("lost")
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(owner, name, dies)
        with pytest.raises(RuntimeError):
            run("x1")
    for b in ("x2", "x1", "x3"):
        assert run(b) == want[b], b
    assert [tuple(r) for r in held.select("doc_id", "kept").collect()] == [(9, True)]  # a result outlives a compaction
    assert tables() <= before
    index.remove()


def test_index_many_batches(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PARTS", 2)
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 10)
    index = exact_dedup.DigestIndex(spark, common.shared_path(spark, "digests"), 2)
    for n in range(5):
        assert sum(r[3] for r in decisions(index.add(texts(spark, range(20 * n, 20 * n + 30), 1000 * n), str(n)))) == (30 if n == 0 else 20)
    assert len(index.state()[1]) <= 3 and index.read().count() == 110
    assert [p["buckets"] for p in index.state()[1]] == [16] and index._buckets_for(30) == 4


def test_index_order_is_used(spark):
    index = exact_dedup.DigestIndex(spark, common.shared_path(spark, "digests"), 4)
    for n in range(2):
        index.add(texts(spark, range(100 * n, 100 * n + 100)), str(n))
    with common.settings(spark, exact_dedup.ORDERED | {"spark.sql.adaptive.enabled": "false"}):
        groups = common.cut(texts(spark, range(150, 250)).select(exact_dedup.digest().alias("digest")))
        plan = index.unknown(groups, index.state()[1])._jdf.queryExecution().executedPlan().toString()
    # The groups are shuffled and sorted once; neither part is.
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_index_in_another_process(spark):
    import subprocess
    import sys

    index = exact_dedup.DigestIndex(spark, common.shared_path(spark, "digests"), 2)
    index.add(texts(spark, range(30)), "here")
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {index.path + "-house"!r}).config("spark.checkpoint.dir", {common.shared_root(spark)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lagloom.llm.exact_dedup import DigestIndex
docs = spark.createDataFrame([(n, "text %d" % n) for n in range(20, 35)], "doc_id long, text string")
print("KEPT", DigestIndex(spark, {index.path!r}, 2).add(docs, "there").where("kept").count())
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "KEPT 5" in ran.stdout, ran.stderr[-2000:]
    assert index.read().count() == 35


def plain_fingerprint(text):
    words = [w for w in normal(text).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(bits):
    """For each fingerprint the smallest index reachable by links of at most 4 bits."""
    root = list(range(len(bits)))
    for i in range(len(bits)):
        for j in range(i):
            if bin(bits[i] ^ bits[j]).count("1") <= 4 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_simhash_awkward(spark):
    docs = awkward(spark).where("doc_id is null or doc_id != 7")
    source = sorted((r.doc_id, r.text or "") for r in docs.where("doc_id is not null").select("doc_id", "text").distinct().collect())
    bits = [plain_fingerprint(t) for _, t in source]
    root = linked(bits)
    want = {i: (f"{b:016x}", source[r][0]) for (i, _), b, r in zip(source, bits, root, strict=True)}
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == want[r.doc_id]
    assert {r.component_id for r in rows if r.doc_id is None} <= {w[1] for w in want.values()}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({w[1] for w in want.values()})
    assert simhash.near_duplicates(nothing(spark)).count() == 0


def test_simhash_repeated_ids(spark):
    a, b, c = ("".join(f"{k}{i} " for i in range(40)) for k in "abc")
    rows = [(3, b), (7, a), (7, b), (9, a), (12, c), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 3), (3, 3), (7, 3), (7, 3), (9, 3), (12, 12)]
    docs = awkward(spark)
    source = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.where("doc_id is not null").select("doc_id", "text").distinct().orderBy("doc_id").collect()]
    root = linked([bits for _, bits in source])
    name = {i: i for i, _ in source}
    for _ in source:
        for (i, _), r in zip(source, root, strict=True):
            low = min(name[i], name[source[r][0]])
            name[i] = name[source[r][0]] = low
    assert all(r.component_id == name[r.doc_id] for r in simhash.near_duplicates(docs).where("doc_id is not null").collect())
    twice = spark.createDataFrame([(5, a), (5, b), (5, c)], "doc_id long, text string")
    for n in (1, 2, 3):
        assert [r.text for r in simhash.keep_one(twice.orderBy(F.desc("text")).repartition(n)).collect()] == [a]


def plain_near(texts, similarity=0.8):
    """For each text the smallest index reachable by links of that Jaccard similarity of 5-word shingles."""
    sets = []
    for t in texts:
        words = (t or "").lower().encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_near_copies(spark):
    rnd = random.Random(2)
    texts = [None, "", "one", "ONE", "one two"]
    for n in (60, 200, 400):
        for _ in range(6):
            base = [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
            for changes in (0, 1, 2, n // 60, n // 45, n // 30):
                copy = list(base)
                for at in rnd.sample(range(n), changes):
                    copy[at] = "changed"
                texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    root = plain_near(texts)
    assert len(set(root)) < len(texts) - 40
    for tile in (8_000_000, 400):
        assert sorted(r.doc_id for r in near_copies.keep_one(docs, tile_bytes=tile).collect()) == sorted(set(root))
    stage = dict(corpus_pipeline.STAGES)["near-dedup by shingles"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(set(root))
    # No text is lost to another one under its doc_id.
    same = spark.createDataFrame([(3, "b " * 9), (7, "a " * 9), (7, "b " * 9)], docs.schema)
    assert sorted((r.doc_id, r.text[0]) for r in near_copies.keep_one(same).collect()) == [(3, "b"), (7, "a")]
    assert near_copies.keep_one(nothing(spark)).count() == 0


def test_tries_and_tiles(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flip = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    bits = np.unique(np.concatenate([base ^ flip(12) ^ flip(12) ^ flip(12) for _ in range(25)] + [rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    group = np.sort(rng.integers(0, 3, len(bits)))
    order = np.lexsort((bits, group))
    i, j = simhash.trie_pairs(group, bits[order], 4)
    b = bits[order]
    near = (np.bitwise_count(b[:, None] ^ b[None, :]) <= 4) & (group[:, None] == group[None, :])
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
    root = linked([int(x) for x in bits])
    nodes = spark.createDataFrame([(n, int(x.astype(np.int64))) for n, x in enumerate(bits)], "rep long, bits long")
    for tile in (1024, 5):
        found = {r.node: r.component for r in common.components(simhash.forest_edges(nodes, tile=tile)).collect()}
        assert [found.get(n, n) for n in range(len(bits))] == root


def test_components(spark, monkeypatch):
    rnd = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)]
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    want = {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in edges)}
    edges = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in common.components(edges).collect()} == want
    # Large stars dealt to several tasks.
    monkeypatch.setattr(common, "FEW", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 16)
    assert {r.node: r.component for r in common.components(edges).collect()} == want


def test_blocks_for():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**9, 10**10, 10**12, 10**18)] == [2, 2, 3, 3, 4, 6]
    for n in (2, 3, 4, 5):
        masks = [m % (1 << 64) for m in simhash.table_masks(4, n)]
        assert all(m.bit_count() >= 64 * n // (4 + n) - n for m in masks)


def test_token_store(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = awkward(spark)
    store = token_store.TokenStore(spark, common.shared_path(spark, "tokens"))
    store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), ranges=3)
    rows = sorted(store.checksums().collect(), key=lambda r: r.start)
    assert [r.doc_id is not None and r.doc_id for r in rows] == sorted((r.doc_id is not None and r.doc_id for r in rows), key=lambda x: (x is not False, x))
    ids = [(r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")) for r in docs.collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    want = sorted([(d, len(x), zlib.crc32(x.tobytes())) for d, x in ids], key=order)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], key=order) == want
    assert [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])[:-1]].tolist()
    assert store.verify_manifest()
    crcs = {r.start: (r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in store.read_documents().collect()}
    assert crcs == {r.start: (r.doc_id, r.ids_crc32) for r in rows}
    chunks = store._chunks()
    assert chunks.count() == chunks.select("key").distinct().count()
    empty = token_store.TokenStore(spark, common.shared_path(spark, "tokens"))
    empty.write(nothing(spark), public_tokenizers.path("byte_bpe_50k.json"))
    assert empty.checksums().count() == 0 and empty.verify_manifest()


def test_store_of_string_ids(spark):
    docs = spark.createDataFrame([("b", "two words", 1), ("a", "one", 2), (None, None, 3), ("a", "", 4)], "doc_id string, text string, start int")
    store = token_store.TokenStore(spark, common.shared_path(spark, "tokens"))
    store.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    whole = {r.start: (r.doc_id, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in store.read_documents().collect()}
    assert whole == {r.start: (r.doc_id, r.n_tokens, r.ids_crc32) for r in store.checksums().collect()}
    assert sorted((d or "") for d, *_ in whole.values()) == ["", "a", "a", "b"]


def test_store_tampered(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 2)  # a tree of several levels
    docs = spark.createDataFrame([(i, " ".join(f"{i} word{k}" for k in range(400))) for i in range(5)], "doc_id long, text string")
    stores = [token_store.TokenStore(spark, common.shared_path(spark, "tokens")) for _ in range(2)]
    for store in stores:
        store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), ranges=2)
    good, bad = stores

    def put(name, df):
        df.write.mode("overwrite").parquet(f"{bad.path}/{name}")

    recipes, ranges = good._read("recipes"), good._read("ranges")
    size = token_store.ENTRY
    changed = [
        ("chunks", F.expr(f"concat(substring(chunks, {size + 1}), substring(chunks, 1, {size}))")),
        ("chunks", F.expr(f"substring(chunks, {size + 1})")),
        ("start", F.col("start") + 1),
        ("ord", 4 - F.col("ord")),
        ("doc_id", F.col("doc_id") + 1),
        ("n_tokens", F.col("n_tokens") + 1),
    ]
    for name, value in changed:
        put("recipes", recipes.withColumn(name, value))
        assert good.verify_manifest() and not bad.verify_manifest(), name
    put("recipes", recipes.where("doc_id < 4"))
    assert not bad.verify_manifest()
    put("recipes", recipes)
    put("ranges", ranges.withColumn("start", F.col("start") + 1))
    assert not bad.verify_manifest()
    put("ranges", ranges)
    top = spark.read.parquet(f"{good.path}/manifest").agg(F.max("level")).first()[0]
    assert top == 3
    for level in (1, 2, 3):
        tree = spark.read.parquet(f"{good.path}/manifest")
        put("manifest", tree.withColumn("hash", F.when(F.col("level") == level, F.unhex(F.sha2("hash", 256))).otherwise(F.col("hash"))))
        assert not bad.verify_manifest(), level
    put("manifest", spark.read.parquet(f"{good.path}/manifest"))
    assert bad.verify_manifest() and bad.read_documents().count() == 5
    chunks = good._entries().where("kind = 'chunk'")
    hit = F.col("chunk") == F.lit(bytearray(chunks.agg(F.min("chunk").alias("chunk")).first().chunk))
    turned = F.expr("concat(substring(chunk, 1, 16), substring(chunk, 19), substring(chunk, 17, 2))")
    for broken in (chunks.where(~hit), chunks.withColumn("chunk", F.when(hit, turned).otherwise(F.col("chunk")))):
        broken.write.mode("overwrite").partitionBy("kind").parquet(f"{bad.path}/entries")
        for read in (bad.read_documents, bad.checksums):
            with pytest.raises(Exception, match="missing or|doesn't hold"):
                read().collect()
    chunks.write.mode("overwrite").partitionBy("kind").parquet(f"{bad.path}/entries")
    put("recipes", recipes.withColumn("chunks", F.expr(f"substring(chunks, {size + 1})")))
    with pytest.raises(Exception, match="missing or of other lengths"):
        bad.checksums().collect()


def test_store_hot_chunks(spark, monkeypatch):
    monkeypatch.setattr(token_store, "HOT_KEYS", 3)
    docs = spark.createDataFrame([(i, "the same text again" if i % 3 else f"text {i}") for i in range(60)], "doc_id long, text string")
    store = token_store.TokenStore(spark, common.shared_path(spark, "tokens"))
    store.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(store._hot().values()) == [2]
    assert len({r.ids_crc32 for r in store.checksums().collect()}) == 21


def ends_of(ids):
    return token_store.chunk_ends(ids, np.array([len(ids)]))


def test_chunk_ends_of_many():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 50_000, n).astype("<u2") for n in (1, 5, 400, 30_000, 17, 2, 900)] + [np.zeros(20_000, "<u2")]
    at = np.cumsum([0, *map(len, docs)])
    want = [a + e for a, d in zip(at, docs, strict=False) for e in ends_of(d)]
    assert token_store.chunk_ends(np.concatenate(docs), at[1:]).tolist() == want


def test_chunks_shared():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 50_000, 30_000).astype("<u2")

    def cut(ids):
        ends = ends_of(ids)
        return {hashlib.sha256(ids[a:b].tobytes()).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    one, two = (cut(np.r_[rng.integers(0, 50_000, n).astype("<u2"), passage]) for n in (777, 3210))
    assert len(one & two) > 0.8 * len(cut(passage))
    for n in (1, 63, 64, 65, 20_000):
        ends = ends_of(np.zeros(n, "<u2"))
        assert ends[-1] == n and max(np.diff([0, *ends])) <= token_store.LONGEST


def test_short_passages_shared():
    rng = np.random.default_rng(5)
    new = lambda n: rng.integers(0, 50_000, n).astype("<u2")

    def cut(ids):
        ends = ends_of(ids)
        return {ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    kept = shared = 0
    for n in [150, 300, 400] * 40:
        passage = new(n)
        one, two = (cut(np.r_[new(rng.integers(50, 600)), passage, new(rng.integers(50, 600))]) for _ in range(2))
        shared += n
        kept += sum(map(len, one & two)) // 2
    assert kept > 0.4 * shared


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) > 0.95 * len(held)


def test_quality_features_plain():
    mix, mask, bits = 0x9E3779B97F4A7C15, (1 << 64) - 1, 16
    crc = lambda s: zlib.crc32(s.encode())

    def plain(text):
        words = re.findall(r"\w+|[^\w\s]+", text or "")
        found, n, before, s1, s2, first = {}, len(words), 0, 1, 1, True
        for w in words:
            if w.isalpha():
                shape = "x" if w.islower() else "X" if w.isupper() else "Xx" if w[1:].islower() else "xX"
            elif w[0].isalnum() or w[0] == "_":
                shape = "9" if w.isdigit() else "a9"
            else:
                shape = w[:4]
            word = crc(w.lower())
            same = not first and word == before
            s = crc(shape) * 2 + same
            both = ((s + 11) * mix + s1) & mask
            for g in (word + (1 << 40), (word + 7) * mix + before, both, (both + 13) * mix + s2):
                b = (g * mix & mask) >> (64 - bits)
                found[b] = found.get(b, 0) + 1 / n / 4
            before, s1, s2, first = word, s, s1, False
        return found

    texts = ["The cat sat on the the mat.", None, "", "X" * 50 + " 12 a9 — ...", "One. Two! THREE three Straße été", "a"]
    buckets, values, first = quality.features(texts, bits)
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        got = {}
        for k, v in zip(buckets[a:b].tolist(), values[a:b].tolist(), strict=True):
            got[k] = got.get(k, 0) + v
        want = plain(t)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want), t


def test_ftrl_plain():
    rnd = random.Random(3)
    model = quality.FTRL(bits=5)
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return ((model.l1 if z[i] > 0 else -model.l1) - z[i]) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)

    for _ in range(300):
        at = rnd.sample(range(32), 6)
        x, label = [rnd.random() / 6 for _ in at], rnd.randint(0, 1)
        model.learn(np.array(at), np.array(x), label)
        full = [(i, v * model.scale) for i, v in zip(at, x, strict=True)] + [(32, 1.0)]
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in full)))
        ws = [weight(i) for i, _ in full]
        for (i, v), w in zip(full, ws, strict=True):
            g = (p - label) * v
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / model.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(33)])
    assert np.any(model.weights() == 0) or np.all(model.n[:32] > 0)


def test_quality_awkward(spark):
    docs = awkward(spark)
    labelled = docs.select("doc_id", "text", F.when(F.col("text").contains("the"), 1).when(F.col("doc_id") % 5 == 0, None).otherwise(0).alias("label"))
    model = quality.train(labelled)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    again = quality.train(labelled.repartition(5))
    assert np.array_equal(model.weights, again.weights)
    assert {r.score for r in quality.score(docs, quality.train(labelled.limit(0))).collect()} == {0.5}
    assert quality.score(nothing(spark), model).count() == 0
    # A text's score is the same alone and among others, to the last digit.
    texts = [r.text for r in docs.collect()]
    assert [model.score([t])[0] for t in texts] == model.score(texts).tolist() == model.score(texts[::-1])[::-1].tolist()
    assert model.score(["", None]).tolist() == model.score([None]).tolist() * 2 and model.score([]).tolist() == []
