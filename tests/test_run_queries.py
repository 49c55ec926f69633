"""Queries of a run on vectors that the small tables don't have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lagloom.plans import registry
from tests.test_queries import SF, norm


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(norm(x) for x in r) for r in found.fetchall())
    return sorted(tuple(norm(r[c]) for c in names) for r in registry.queries()[name](spark, str(folder)).collect()) == want


@pytest.mark.parametrize("name", ["run_faults", "run_statuses", "run_fault_rates"])
def test_dull_sound_is_never_alike(spark, tmp_path, name):
    """Vectors whose dull copies, taking in nine tenths of the sample before, had a likeness of 0.62 and 0.63."""
    rows = {r["vec_id"]: r for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()}
    pq.write_table(pa.Table.from_pylist([rows[v % 500] | {"vec_id": v} for v in (19452, 55757, 3)], pq.read_schema(f"{SF}/embeddings.parquet")), tmp_path / "embeddings.parquet")
    assert same_as_sql(spark, name, tmp_path)


@pytest.mark.parametrize("name", ["run_documents", "run_performance", "run_confidences", "run_quality", "run_reliability", "run_fault_rates", "run_statuses"])
def test_a_run_is_computed_once(spark, name):
    """What a run tells is made of alignments and comparisons that are there already: its plan aligns nothing again, and makes samples at most once."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") <= (name == "run_documents")


def test_streams_of_one_value(spark):
    """A pair of which one stream is missing is dropped; empty values are values."""
    from lagloom.operators import alignment

    pairs = spark.createDataFrame([("g", "a_vs_b", "a", "b"), ("g", "a_vs_c", "a", "c"), ("h", "a_vs_b", "a", "b")], "broadcast_key string, alignment_name string, stream1 string, stream2 string")
    values = spark.createDataFrame([("g", "a", [1.0]), ("g", "b", None), ("h", "b", [2.0])], "broadcast_key string, stream_name string, value array<double>")
    assert [tuple(r) for r in alignment.by_pair(pairs, values).collect()] == [("g", "a_vs_b", "a", "b", [1.0], None)]


def test_a_large_broadcast_is_paired_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from lagloom.operators import pairing

    copies = spark.range(400).selectExpr("'g' as broadcast_key", "concat('ti_hls_', id) as stream_name", "'cdn' as role")
    sources = spark.range(3).selectExpr("'g' as broadcast_key", "concat('pri_source_', id) as stream_name", "'source' as role")
    made = pairing.pair_streams(copies.unionByName(sources))
    assert made.count() == made.distinct().count() == 1200
    by_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) >= 8 and max(by_task) < 300


def test_parts_of_sources_meet_parts_of_copies(spark, monkeypatch):
    """Each pair once, whatever the parts; no task holds all sources, nor all copies, of a large broadcast."""
    from pyspark.sql import functions as F

    from lagloom.operators import pairing

    monkeypatch.setattr(pairing, "SIDE", 4)
    monkeypatch.setattr(pairing, "PARTS", 2)
    rows = [("g", f"pri_{i}", "source") for i in range(40)] + [("g", f"ti_{i}", "cdn") for i in range(60)] + [("g", "bk_0", "source")]
    rows += [("h", "pri_0", "source"), ("h", "ti_0", "cdn"), ("h", "ti_0", "cdn"), ("i", "pri_0", "source"), ("j", "ti_0", "cdn"), (None, "pri_0", "source"), (None, "ti_0", "cdn"), ("h", "bk_0", None)]
    streams = spark.createDataFrame(rows, "broadcast_key string, stream_name string, role string")
    is_primary = lambda n, r: r == "source" and "pri" in n
    want = sorted((k, n, m, q, f"{n}_vs_{m}") for k, n, r in rows if is_primary(n, r) for j, m, q in rows if k == j and k and q and not is_primary(m, q))
    for made in (pairing.pair_streams(streams), pairing.pair_streams(streams, 1, 20)):
        assert sorted(tuple(r) for r in made.collect()) == want
    by_task = made.where("broadcast_key = 'g'").groupBy(F.spark_partition_id()).agg(F.count_distinct("stream1"), F.count_distinct("stream2")).collect()
    assert len(by_task) > 40 and max(r[1] for r in by_task) < 40 and max(r[2] for r in by_task) < 61


def test_pairs_of_a_nation_are_dealt_by_their_number(spark, tmp_path):
    """750 million pairs go to more tasks than there would be for each core, 300 to fewer."""
    for suppliers, customers, tasks in ((40_000, 30_000, (45, 46)), (30, 10, (1, 4))):
        spark.range(suppliers).selectExpr("id as s_suppkey", "7 as s_nationkey", "1.0D as s_acctbal").write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
        spark.range(customers).selectExpr("id as c_custkey", "7 as c_nationkey", "1.0D as c_acctbal").write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
        assert tasks[0] <= registry.queries()["source_cdn_pairs"](spark, str(tmp_path)).rdd.getNumPartitions() <= tasks[1]


def test_content_fingerprints_are_made_once(spark):
    plan = registry.queries()["content_fingerprints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_samples_of_blocks_are_never_sorted(spark):
    """As on tables too large for broadcasts: samples are made once more after the envelopes, and met without a sort."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["block_alignments"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with_sound = plan[: plan.index("ArrowEvalPython")]
    assert plan.count("ArrowEvalPython [_pcm") == 1
    assert "hashpartitioning(broadcast_key" in with_sound and "ShuffledHashJoin" in with_sound
    assert plan.count("SortMergeJoin") <= 2  # that of names to pairs, and of pairs to what was found: no samples


def test_sound_of_one_file_is_made_by_many_tasks(spark, tmp_path):
    """A file of one row group is read by one task; what is made of its vectors isn't."""
    from pyspark.sql import functions as F

    from lagloom.plans import run_queries

    schema = pq.read_schema(f"{SF}/embeddings.parquet")
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    pq.write_table(pa.Table.from_pylist([rows[v % len(rows)] | {"vec_id": v} for v in range(4000)], schema), tmp_path / "embeddings.parquet")
    _, streams = run_queries._sound(spark, str(tmp_path))
    by_task = [r["count"] for r in streams.where("pcm is not null").groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) >= 12 and max(by_task) < 3 * sum(by_task) / len(by_task)


def test_streams_of_a_vector_are_the_same_noise_moved():
    """Each sample by itself, as it was made before noise was made once for a vector."""
    import numpy as np

    from lagloom.plans import run_queries as q

    rng = np.random.default_rng(5)
    ids = np.repeat([3.0, 615383.0, 3.0], 4)
    loudness, shift = rng.normal(size=(12, q.HOPS)), np.array([0, -5, 48, 27] * 3)
    loudness[2, 7] = np.nan
    at = np.arange(q.HOP * q.HOPS)[None, :] - shift[:, None]
    inside = (at >= 0) & (at < q.HOP * q.HOPS)
    loud = np.where(inside, 0.05 + np.abs(np.take_along_axis(loudness, np.clip(at // q.HOP, 0, q.HOPS - 1), 1)), 0.005)
    want = (q._noise(at, ids[:, None], 12.9898, 78.233, 43758.5453) * 2 - 1) * loud
    assert np.array_equal(q._made(ids, loudness, shift, np.full(12, "", object)), want, equal_nan=True)
    assert q._made(ids[:0], loudness[:0], shift[:0], np.zeros(0, object)).shape == (0, q.HOP * q.HOPS)


@pytest.mark.parametrize("name", ["run_performance", "run_confidences"])
def test_values_of_a_run_are_kept(spark, name):
    """Percentiles of large series ask for the values again and again: their plan reads no table anew."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan


@pytest.mark.parametrize("name", ["run_quality", "run_performance"])
def test_samples_are_read_once_for_envelopes_and_fingerprints(spark, monkeypatch, name):
    from lagloom.operators import alignment

    monkeypatch.setattr(alignment, "fingerprints", None)
    monkeypatch.setattr(alignment, "envelopes", None)
    registry.queries()[name](spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["run_alignments", "run_performance", "run_quality", "run_confidences", "run_reliability", "run_faults"])
def test_large_ids_are_no_timeouts(spark, tmp_path, name):
    """Times grow with ids: from 150,000 on a measurement took longer than the default limit, and was left out."""
    rows = {r["vec_id"]: r for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()}
    pq.write_table(pa.Table.from_pylist([rows[v % 500] | {"vec_id": v} for v in (3, 149_999, 150_001, 449_998, 615_383)], pq.read_schema(f"{SF}/embeddings.parquet")), tmp_path / "embeddings.parquet")
    assert same_as_sql(spark, name, tmp_path)


@pytest.mark.parametrize("name", ["run_quality", "run_confidences", "run_alignments"])
def test_pairs_meet_sound_in_tasks_by_their_number(spark, tmp_path, monkeypatch, name):
    """Whatever the session's number of shuffle partitions: with few of them, tasks grew with the input and spilled."""
    from pyspark.sql import functions as F

    from lagloom.operators import alignment

    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    pq.write_table(pa.Table.from_pylist([rows[v % len(rows)] | {"vec_id": v} for v in range(3000)], pq.read_schema(f"{SF}/embeddings.parquet")), tmp_path / "embeddings.parquet")
    made, align = [], alignment.align_streams
    monkeypatch.setattr(alignment, "align_streams", lambda *given: made.append(align(*given)) or made[-1])
    registry.queries()[name](spark, str(tmp_path))
    by_task = [r["count"] for r in made[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) >= 12 and max(by_task) < 3 * sum(by_task) / len(by_task)


def test_tasks_grow_with_rows(spark):
    from lagloom.operators import pairing

    assert [pairing.tasks_for(spark.range(n), 10, 100) for n in (0, 9, 35, 1600, 1601, 5000)] == [1, 1, 4, 16, 17, 50]


def test_what_is_kept_is_computed_in_small_batches(spark):
    """Batches of sound had 10,000 rows; the session's own setting is as before afterwards."""
    from lagloom.operators import kept

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    made = kept.once(spark.range(3000, numPartitions=1).mapInArrow(sizes, "n long"))
    assert max(r["n"] for r in made.collect()) <= 512
    assert spark.conf.get(name) == before
    with pytest.raises(ZeroDivisionError), kept.small_batches(spark):
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == before
