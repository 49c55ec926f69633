"""The engine's operators on the benchmark tables, each with the SQL that gives the same rows.

The tables stand in for measurements: events for lags (event_type the comparison, value the
seconds), customers and suppliers of a nation for the streams of a broadcast, embeddings for
samples and fingerprints, page URLs for endpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.functions import audio, numbers, text, urls
from lagloom.operators import catalog, config, liveness, pairing, quality, segments, stats, timers, validate
from lagloom.operators.alignment import best_lag
from lagloom.streaming.changes import changed
from lagloom.streaming.state import silences_of

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STATS_SQL = """count(value) AS count, coalesce(avg(value), 0) AS mean, coalesce(quantile_cont(value, 0.5), 0) AS median, coalesce(quantile_cont(value, 0.95), 0) AS p95,
 coalesce(quantile_cont(value, 0.99), 0) AS p99, coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max, coalesce(stddev_pop(value), 0) AS std_dev"""
ROUNDED = "count, round(mean, 6) AS mean, median, p95, p99, min, max, round(std_dev, 6) AS std_dev"


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on the order of rows in their last digits."""
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std_dev")})


@query(f"SELECT event_type, {ROUNDED} FROM (SELECT event_type, {STATS_SQL} FROM events GROUP BY event_type)")
def latency_stats(spark, sf_dir):
    return rounded(stats.stats_by(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query(f"""SELECT event_type, {ROUNDED} FROM (SELECT s.event_type, {STATS_SQL} FROM (SELECT DISTINCT event_type FROM events) s
 LEFT JOIN (SELECT event_type, value FROM events WHERE event_type <> 'click' AND value > 5) e ON e.event_type = s.event_type GROUP BY s.event_type)""")
def latency_stats_zero_filled(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    some = events.where("event_type <> 'click' and value > 5")
    return rounded(stats.zero_filled(stats.stats_by(some, ["event_type"], "value"), events.select("event_type").distinct(), "event_type"))


LAG_SQL = "value - 40 AS lag, CASE WHEN value > 100 THEN 'NO_MATCH' WHEN value < 10 THEN 'NO_ALIGNMENT' ELSE 'MATCH' END AS status"


@query(f"SELECT event_type, count, {', '.join(f'round({c}, 6) AS {c}' for c in stats.FIELDS[1:])} FROM (SELECT event_type, {STATS_SQL} FROM (SELECT event_type, abs(lag) AS value FROM (SELECT event_type, {LAG_SQL} FROM events) WHERE status = 'MATCH') GROUP BY event_type)")
def abs_match_lag_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns({"lag": F.col("value") - 40, "similarity": F.when(F.col("value") > 100, 0.1).otherwise(0.9)})
    rows = rows.withColumn("status", liveness.copy_status(F.when(F.col("value") < 10, -1.0).otherwise(0.0), F.lit(True), F.col("similarity"), 0.6))
    made = stats.stats_by(rows.where("status = 'MATCH'").select("event_type", F.abs("lag").alias("value")), ["event_type"], "value")
    return made.withColumns({c: F.round(c, 6) for c in stats.FIELDS[1:]})


@query(f"""WITH s AS (SELECT event_type, {STATS_SQL} FROM events WHERE event_type <> 'signup' GROUP BY event_type),
 z AS (SELECT t.event_type, coalesce(count, 0) AS count, coalesce(median, 0) AS median FROM (SELECT DISTINCT event_type FROM events) t LEFT JOIN s ON s.event_type = t.event_type)
 SELECT event_type, CASE WHEN shown THEN count END AS count, CASE WHEN shown THEN median END AS median
 FROM (SELECT *, event_type NOT IN ('signup', 'view') OR (SELECT max(count) FROM z WHERE event_type = 'signup') > 0 AS shown FROM z)""")
def presence_rule_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    made = stats.zero_filled(stats.stats_by(events.where("event_type <> 'signup'"), ["event_type"], "value"), events.select("event_type").distinct(), "event_type")
    return stats.with_presence(made, "signup", ["signup", "view"], "event_type").select("event_type", "count", "median")


def _streams(spark, sf_dir) -> DataFrame:
    """Suppliers as sources and customers as copies; a nation is a broadcast. Those whose key divides by 7 have `pri` in their name."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("broadcast_key"), F.concat(F.when(F.col("s_suppkey") % 3 == 0, "pri_source_").otherwise("bk_source_"), F.col("s_suppkey")).alias("stream_name"), F.lit("source").alias("role"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("broadcast_key"), F.concat(F.lit("ti_hls_"), F.col("c_custkey")).alias("stream_name"), F.lit("cdn").alias("role"), F.col("c_acctbal").alias("balance"))
    return s.unionByName(c).withColumn("error", F.when(F.col("balance") < 0, "connection timeout"))


STREAMS_SQL = """streams AS (
 SELECT CAST(s_nationkey AS VARCHAR) AS broadcast_key, (CASE WHEN s_suppkey % 3 = 0 THEN 'pri_source_' ELSE 'bk_source_' END) || s_suppkey AS stream_name, 'source' AS role, CASE WHEN s_acctbal < 0 THEN 'connection timeout' END AS error FROM supplier
 UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'ti_hls_' || c_custkey, 'cdn', CASE WHEN c_acctbal < 0 THEN 'connection timeout' END FROM customer)"""


@query(f"""WITH {STREAMS_SQL}, fine AS (SELECT * FROM streams WHERE error IS NULL)
 SELECT l.broadcast_key, l.stream_name AS stream1, r.stream_name AS stream2, r.role AS role2, l.stream_name || '_vs_' || r.stream_name AS alignment_name
 FROM fine l JOIN fine r ON l.broadcast_key = r.broadcast_key AND l.role = 'source' AND contains(l.stream_name, 'pri')
 AND (r.role = 'cdn' OR (r.role = 'source' AND NOT contains(r.stream_name, 'pri')))""")
def source_cdn_pairs(spark, sf_dir):
    return pairing.pair_streams(pairing.without_errors(_streams(spark, sf_dir)), 1 << 18, 1 << 24)


@query("""WITH a AS (SELECT o_orderkey, o_orderkey || '_vs_x' AS alignment_name FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000),
 f AS (SELECT l_orderkey, avg(l_discount) AS similarity FROM lineitem GROUP BY l_orderkey)
 SELECT CAST(o_orderkey AS VARCHAR) AS broadcast_key, alignment_name, round(similarity, 9) AS overall_similarity FROM a JOIN f ON l_orderkey = o_orderkey""")
def alignment_fp_lookup(spark, sf_dir):
    name = text.pair_name(F.col("o_orderkey").cast("string"), F.lit("x"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("broadcast_key"), name.alias("alignment_name"), F.when(F.col("o_orderstatus") == "P", "alignment failed").alias("error"), (F.col("o_totalprice") > 1000).alias("is_valid"))
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("overall_similarity"))
    f = f.select(F.col("l_orderkey").cast("string").alias("broadcast_key"), text.fingerprint_name(text.pair_name(F.col("l_orderkey").cast("string"), F.lit("x"))).alias("alignment_name"), "overall_similarity", F.lit(None).cast("string").alias("error"))
    return pairing.with_fingerprints(a, f).select("broadcast_key", "alignment_name", F.round("overall_similarity", 9).alias("overall_similarity"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag <> 'R' AND l_quantity > 5")
def error_anti_filter(spark, sf_dir):
    """Measurements without an error that are valid, of broadcasts without an error."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("broadcast_key"), F.when(F.col("o_orderstatus") == "P", "dns failure").alias("error"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("broadcast_key"), "l_linenumber", F.when(F.col("l_returnflag") == "R", "audio missing").alias("error"), (F.col("l_quantity") > 5).alias("is_valid"))
    fine = pairing.passing(pairing.valid_alignments(pairing.without_errors(lines)), orders)
    return fine.select(F.col("broadcast_key").alias("l_orderkey"), "l_linenumber")


@query("""SELECT o_orderkey AS broadcast_key, coalesce(n, 0) AS valid_streams, CASE WHEN coalesce(n, 0) < 2 THEN 'insufficient valid streams (' || coalesce(n, 0) || ') for alignment' END AS error
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity > 5 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def min_streams_guard(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("broadcast_key"), F.when(F.col("l_returnflag") == "R", "audio missing").alias("error"), F.struct((F.col("l_quantity") > 5).alias("is_valid")).alias("validation"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("broadcast_key"), F.lit(None).cast("string").alias("error"))
    return pairing.guard(orders, lines).select("broadcast_key", "valid_streams", "error")


@query("SELECT user_id AS group_key, bool_or(event_type = 'purchase' AND value > 20) AND bool_or(event_type = 'view' AND value > 20) AS complete FROM events GROUP BY user_id")
def required_roles_exists(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("group_key"), F.when(F.col("event_type") == "purchase", "source").when(F.col("event_type") == "view", "cdn").alias("role"), (F.col("value") > 20).alias("enabled"), F.lit(None).cast("boolean").alias("broadcast_enabled"))
    return catalog.has_required_roles(rows)


PAIRS_SQL = """pairs AS (SELECT CAST(user_id AS VARCHAR) AS broadcast_key, event_id,
 CASE event_type WHEN 'click' THEN 'pri_source_vs_ti_hls_' WHEN 'view' THEN 'pri_source_vs_ss_ais_hls_' WHEN 'purchase' THEN 'pri_source_vs_ti_mp3_' WHEN 'signup' THEN 'pri_source_vs_ss_ais_mp3_' ELSE 'pri_source_vs_bk_source_' END || lpad(CAST(event_id AS VARCHAR), 12, '0') AS alignment_name,
 (value - 20) / 7 AS latency_seconds, event_id % 11 <> 0 AS is_valid, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 100) / 100.0 END AS overall_similarity FROM events),
 slots AS (SELECT *, CASE WHEN contains(alignment_name, 'hls') AND contains(alignment_name, 'ti') THEN 'hls_cloudfront_lag' WHEN contains(alignment_name, 'hls') AND contains(alignment_name, 'ss_ais') THEN 'hls_ais_lag'
 WHEN contains(alignment_name, 'mp3') AND contains(alignment_name, 'ti') THEN 'icecast_cloudfront_lag' WHEN contains(alignment_name, 'mp3') AND contains(alignment_name, 'ss_ais') THEN 'icecast_ais_lag' ELSE 'source_lag' END AS comparison,
 sign(latency_seconds * 1000) * floor(abs(latency_seconds * 1000) + 0.5) / 1000 AS r FROM pairs),
 live AS (SELECT *, CASE WHEN comparison = 'source_lag' AND NOT is_valid THEN 0.0 ELSE r END AS lag_seconds, CASE WHEN overall_similarity IS NULL THEN NULL WHEN overall_similarity < 0.6 THEN 'NO_MATCH'
 WHEN NOT is_valid OR (comparison <> 'source_lag' AND r < 0) THEN 'NO_ALIGNMENT' ELSE 'MATCH' END AS status FROM slots),
 first AS (SELECT broadcast_key, comparison, arg_min(lag_seconds, alignment_name) AS lag_seconds, arg_min(coalesce(status, '-'), alignment_name) AS status FROM live GROUP BY broadcast_key, comparison)"""


def _pairs(spark, sf_dir) -> DataFrame:
    kinds = {"click": "ti_hls_", "view": "ss_ais_hls_", "purchase": "ti_mp3_", "signup": "ss_ais_mp3_"}
    other = F.lit("bk_source_")
    for k, v in kinds.items():
        other = F.when(F.col("event_type") == k, v).otherwise(other)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("broadcast_key"), text.pair_name(F.lit("pri_source"), F.concat(other, F.lpad(F.col("event_id").cast("string"), 12, "0"))).alias("alignment_name"),
        ((F.col("value") - 20) / 7).alias("latency_seconds"), (F.col("event_id") % 11 != 0).alias("is_valid"), F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 100) / 100.0).alias("overall_similarity"),
    )


@query(f"WITH {PAIRS_SQL} SELECT broadcast_key, comparison, lag_seconds, nullif(status, '-') AS status FROM first")
def liveness_status(spark, sf_dir):
    return liveness.classify(_pairs(spark, sf_dir))


def _pivot_sql() -> str:
    slots = [s for s, _ in liveness.SLOTS]
    return ", ".join(f"max(CASE WHEN comparison = '{s}' THEN lag_seconds END) AS {s}, nullif(max(CASE WHEN comparison = '{s}' THEN status END), '-') AS {s}_status" for s in slots)


@query(f"WITH {PAIRS_SQL} SELECT broadcast_key, {_pivot_sql()} FROM first GROUP BY broadcast_key")
def liveness_pivot(spark, sf_dir):
    wide = liveness.pivot(liveness.classify(_pairs(spark, sf_dir)))
    return wide.select("broadcast_key", *[c for s, _ in liveness.SLOTS for c in (F.col(s)["lag_seconds"].alias(s), F.col(s)["status"].alias(f"{s}_status"))])


NAMES_SQL = "CASE comparison " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in liveness.COMPARISONS.items()) + " END"


@query(f"WITH {PAIRS_SQL} SELECT broadcast_key, {NAMES_SQL} AS comparison, CAST(trunc(lag_seconds * 1000) AS BIGINT) AS lag_ms, nullif(status, '-') AS status FROM first")
def liveness_unpivot(spark, sf_dir):
    return liveness.unpivot(liveness.pivot(liveness.classify(_pairs(spark, sf_dir))))


@query(f"""WITH {PAIRS_SQL} SELECT 'streaming.latency.benchmark.ms' AS metric, CAST(trunc(lag_seconds * 1000) AS BIGINT) AS value,
 concat_ws('|', 'group:g', 'broadcast:' || broadcast_key, 'comparison:' || {NAMES_SQL}, 'status:' || status) AS tags FROM first WHERE status <> '-'
 UNION ALL SELECT 'streaming.benchmark.duration.milliseconds', 1500, concat_ws('|', 'group:g', 'broadcast:' || broadcast_key) FROM (SELECT DISTINCT broadcast_key FROM first WHERE status <> '-')""")
def metric_rows(spark, sf_dir):
    lags = liveness.classify(_pairs(spark, sf_dir)).where("status is not null").withColumn("broadcast_key", text.measurement_key(F.lit("g"), F.col("broadcast_key")))
    broadcasts = lags.select("broadcast_key").distinct().withColumns({"name": F.lit(""), "total_s": F.lit(1.5)})
    return liveness.metric_rows(liveness.pivot(lags), broadcasts).withColumn("tags", F.array_join("tags", "|"))


@query("""SELECT l_linestatus, coalesce(count(*) FILTER (l_returnflag = 'A') / nullif(CAST(count(*) AS DOUBLE), 0), 0) AS valid_rate, coalesce(count(*) FILTER (l_discount > 0.05 AND l_tax < 0.05) / nullif(CAST(count(*) AS DOUBLE), 0), 0) AS match_rate
 FROM lineitem GROUP BY l_linestatus""")
def quality_rates(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(numbers.ratio(F.count_if(F.col("l_returnflag") == "A"), n).alias("valid_rate"), numbers.ratio(F.count_if(F.expr("l_discount > 0.05 and l_tax < 0.05")), n).alias("match_rate"))


FACTS_SQL = """b AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'dns failure' END AS error, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 100) / 100.0 END AS score FROM orders),
 s AS (SELECT l_orderkey AS k, CASE WHEN l_quantity < 5 THEN 'decode error' WHEN l_quantity < 8 THEN 'unknown' END AS error, l_returnflag <> 'R' AS fine, CASE WHEN l_tax < 0.04 THEN 'hls' ELSE 'icecast' END AS type, l_discount > 0.03 AS aligned, l_discount > 0.06 AS matched FROM lineitem),
 g AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM b WHERE b.k = s.k AND b.error IS NULL))"""


def _facts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("broadcast_key"), F.when(F.col("o_orderstatus") == "P", "dns failure").alias("error"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 100) / 100.0).alias("health_score"))
    line = table(spark, sf_dir, "lineitem")
    key, error = F.col("l_orderkey").alias("broadcast_key"), F.when(F.col("l_quantity") < 5, "decode error").when(F.col("l_quantity") < 8, "unknown").alias("error")
    s = line.select(key, error, F.struct((F.col("l_returnflag") != "R").alias("is_valid")).alias("validation"), F.when(F.col("l_tax") < 0.04, "hls").otherwise("icecast").alias("type"))
    return b, s, line.select(key, error, (F.col("l_discount") > 0.03).alias("is_valid")), line.select(key, error, (F.col("l_discount") > 0.06).alias("is_valid_match"))


@query(f"""WITH {FACTS_SQL} SELECT (SELECT count(*) FILTER (error IS NULL AND fine) / CAST(count(*) AS DOUBLE) FROM g) AS stream_validity_rate, (SELECT count(*) FILTER (error IS NULL AND aligned) / CAST(count(*) AS DOUBLE) FROM g) AS alignment_success_rate,
 (SELECT count(*) FILTER (error IS NULL AND matched) / CAST(count(*) AS DOUBLE) FROM g) AS fingerprint_match_rate, (SELECT round(sum(coalesce(score, 0)) / CAST(count(*) AS DOUBLE), 9) FROM b WHERE error IS NULL) AS average_health_score,
 (SELECT count(*) FROM b WHERE error IS NULL AND score >= 0.9) AS excellent, (SELECT count(*) FROM b WHERE error IS NULL AND score >= 0.7 AND score < 0.9) AS good, (SELECT count(*) FROM b WHERE error IS NULL AND score >= 0.5 AND score < 0.7) AS fair, (SELECT count(*) FROM b WHERE error IS NULL AND score < 0.5) AS poor""")
def quality_metrics(spark, sf_dir):
    made = quality.quality_metrics(*_facts(spark, sf_dir)).withColumn("average_health_score", F.round("average_health_score", 9))
    return made.select("*", *[F.col("health_distribution")[b].alias(b) for b in ("excellent", "good", "fair", "poor")]).drop("health_distribution")


@query("""SELECT event_type, count(*) FILTER (value / 100 >= 0.9) AS excellent, count(*) FILTER (value / 100 >= 0.7 AND value / 100 < 0.9) AS good, count(*) FILTER (value / 100 >= 0.5 AND value / 100 < 0.7) AS fair, count(*) FILTER (value / 100 < 0.5) AS poor
 FROM events GROUP BY event_type""")
def health_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(quality.health_histogram(F.col("value") / 100).alias("h"))
    return rows.select("event_type", *[F.col("h")[b].alias(b) for b in ("excellent", "good", "fair", "poor")])


@query(f"WITH {FACTS_SQL} SELECT type, count(*) FILTER (error IS NULL AND fine) / CAST(count(*) AS DOUBLE) AS rate FROM s GROUP BY type")
def reliability_by_type(spark, sf_dir):
    return quality.success_by_type(_facts(spark, sf_dir)[1])


@query(f"""WITH {FACTS_SQL} SELECT CASE error WHEN 'dns failure' THEN 'network' WHEN 'decode error' THEN 'format' ELSE 'other' END AS error_class, count(*) AS n
 FROM (SELECT error FROM b WHERE error IS NOT NULL UNION ALL SELECT error FROM g WHERE error IS NOT NULL) GROUP BY 1""")
def error_distribution(spark, sf_dir):
    return quality.error_counts(*_facts(spark, sf_dir)[:2])


@query(f"""WITH {FACTS_SQL} SELECT (SELECT count(*) FROM b WHERE error IS NULL) AS succeeded, (SELECT count(*) FROM b WHERE error IS NOT NULL) AS failed, (SELECT count(*) FROM s) AS streams""")
def run_counts(spark, sf_dir):
    return quality.run_counts(*_facts(spark, sf_dir)[:2])


MESSAGES = ["timeout while reading", "connection refused", "dns lookup failed", "cannot decode frame", "codec missing", "status 404", "http error", "bad fingerprint", "alignment too short", "config missing", "invalid role", "Timeout", "something else"]
MESSAGE_SQL = "CASE event_id % 14 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END"
CLASS_SQL = "CASE WHEN m IS NULL THEN 'none' " + " ".join("WHEN " + " OR ".join(f"contains(m, '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in text.ERROR_CLASSES) + " ELSE 'other' END"


@query(f"SELECT event_id, m AS message, {CLASS_SQL} AS error_class FROM (SELECT event_id, {MESSAGE_SQL} AS m FROM events)")
def categorize_error(spark, sf_dir):
    message = F.get(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % 14).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", message.alias("message"), text.error_class(message).alias("error_class"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax, sign(x) * floor(abs(x) + 0.5) / 1000 AS rounded FROM (SELECT *, (l_discount - l_tax) * l_extendedprice / 7 * 1000 AS x FROM lineitem)")
def round_decimals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax", numbers.round_places((F.col("l_discount") - F.col("l_tax")) * F.col("l_extendedprice") / 7, 3).alias("rounded"))


@query("SELECT user_id AS broadcast_key, round(epoch_us(max(ts)) / 1e3 - epoch_us(min(ts)) / 1e3, 3) AS spread_ms, epoch_us(max(ts)) / 1e3 - epoch_us(min(ts)) / 1e3 <= 2e9 AS together FROM events GROUP BY user_id")
def start_spread(spark, sf_dir):
    made = pairing.start_spread(table(spark, sf_dir, "events").withColumn("broadcast_key", F.col("user_id")), "ts", 2e9)
    return made.withColumn("spread_ms", F.round("spread_ms", 3))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'decode error' WHEN value > 100 THEN 'timeout: a measurement took over 100s' END AS error FROM events")
def deadlines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("error", F.when(F.col("event_type") == "error", "decode error"))
    return pairing.within_deadline(rows, F.col("value") * 1e9, 100 * 10**9, "a measurement").select("event_id", "error")


@query("""SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN 0.0 ELSE x END AS clean, [0.0, CASE WHEN event_id % 5 = 1 THEN 0.0 ELSE value END]::VARCHAR AS list
 FROM (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value END AS x FROM events)""")
def sanitize_nonfinite(spark, sf_dir):
    k = F.col("event_id") % 5
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    xs = numbers.finite_array(F.array(F.lit(float("nan")), F.when(k == 1, float("inf")).otherwise(F.col("value"))))
    return table(spark, sf_dir, "events").select("event_id", numbers.finite(x).alias("clean"), F.concat(F.lit("["), F.array_join(F.transform(xs, lambda v: v.cast("string")), ", "), F.lit("]")).alias("list"))


CODECS = ["flac", "aac", "ogg", "opus", "mp3", "wav"]


@query("""SELECT p_partkey, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair' ELSE 'Poor' END AS rating, CASE WHEN h > 0.8 THEN 'Excellent' WHEN h > 0.5 THEN 'Good' ELSE 'Poor' END AS buffer FROM (
 SELECT p_partkey, (p_size % 11) / 10.0::DOUBLE AS h, CAST(least(100, 50 + CASE WHEN p_size * 8 >= 320 THEN 20 WHEN p_size * 8 >= 192 THEN 15 WHEN p_size * 8 >= 128 THEN 10 WHEN p_size * 8 >= 96 THEN 5 ELSE 0 END
 + CASE WHEN p_retailprice * 45 >= 48000 THEN 15 WHEN p_retailprice * 45 >= 44100 THEN 10 WHEN p_retailprice * 45 >= 22050 THEN 5 ELSE 0 END
 + CASE p_partkey % 6 WHEN 0 THEN 15 WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 10 WHEN 4 THEN 5 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 10 ELSE 0 END) AS DOUBLE) AS score FROM part)""")
def quality_score(spark, sf_dir):
    codec = F.get(F.array(*[F.lit(c) for c in CODECS]), (F.col("p_partkey") % 6).cast("int"))
    score = numbers.quality_score(F.col("p_size") * 8, F.col("p_retailprice") * 45, codec, F.col("p_type") == "ECONOMY")
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), numbers.rating(score).alias("rating"), numbers.buffer_band((F.col("p_size") % 11) / 10.0).alias("buffer"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '[/:?&=]', '_', 'g') AS file FROM pages")
def url_safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.file_name(F.col("url")).alias("file"))


@query("SELECT page_id, CASE WHEN strlen(url) <= 40 THEN url ELSE left(url, 37) || '...' END AS short FROM pages")
def truncate_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.truncated(F.col("url"), 40).alias("short"))


BYPASS = [urls.BypassRule(["example.com"], [], {"premium": "true", "partner": "bot~1*"}), urls.BypassRule(["example.net"], ["/de/"], {"page": "one two"}), urls.BypassRule([], ["/nowhere/"], {"x": "y"})]


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*') AS base, regexp_extract(url, '[?]([^#]*)', 1) AS q, regexp_extract(url, '#.*$') AS f FROM pages),
 m AS (SELECT *, contains(host, 'example.com') AS r1, contains(host, 'example.net') AND contains(path, '/de/') AS r2 FROM u),
 p AS (SELECT *, list_sort(list_concat(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT (r2 AND starts_with(x, 'page='))), CASE WHEN r1 THEN ['partner=bot~1%2A', 'premium=true'] ELSE [] END, CASE WHEN r2 THEN ['page=one+two'] ELSE [] END)) AS pairs FROM m)
 SELECT page_id, CASE WHEN r1 OR r2 THEN base || '?' || array_to_string(pairs, '&') || f ELSE url END AS target FROM p""")
def ad_bypass_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.with_bypass(F.col("url"), BYPASS).alias("target"))


@query("""SELECT page_id, CASE WHEN regexp_matches(u, '\\.html$') THEN 'hls' WHEN regexp_matches(u, '/$') OR regexp_matches(u, '/en/\\d+$') THEN 'icecast' END AS type, NOT (starts_with(url, 'http://') OR starts_with(url, 'https://')) AS is_local
 FROM (SELECT page_id, url, lower(regexp_replace(url, '[?#].*$', '')) AS u FROM pages)""")
def url_type_detect(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.stream_type(url, [r"\.html$"], [r"/$", r"/en/\d+$"]).alias("type"), urls.is_local(url).alias("is_local"))


TITLE_SQL = "CASE event_id % 5 WHEN 0 THEN 'CATEGORY:' || event_type || ',AD_BREAK' WHEN 1 THEN 'x CATEGORY:' || event_type WHEN 2 THEN 'CATEGORY:,' WHEN 3 THEN event_type || ' AD_BREAK' END"
TITLE = "case event_id % 5 when 0 then concat('CATEGORY:', event_type, ',AD_BREAK') when 1 then concat('x CATEGORY:', event_type) when 2 then 'CATEGORY:,' when 3 then concat(event_type, ' AD_BREAK') end"


@query(f"SELECT event_id, CASE WHEN contains(t, 'CATEGORY:') THEN regexp_extract(t, 'CATEGORY:([^,]*)', 1) END AS category, coalesce(contains(t, 'AD_BREAK'), false) AS ad_break FROM (SELECT event_id, {TITLE_SQL} AS t FROM events)")
def category_extract(spark, sf_dir):
    title = F.expr(TITLE)
    return table(spark, sf_dir, "events").select("event_id", text.category(title).alias("category"), text.has_ad_break(title).alias("ad_break"))


@query(f"""WITH s AS (SELECT user_id, value, {TITLE_SQL} AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
 SELECT user_id, count(*) AS segments, round(sum(value), 6) AS total_duration, round(avg(value), 6) AS average_duration, count(*) FILTER (contains(t, 'AD_BREAK')) AS ad_breaks, count(*) FILTER (contains(t, 'CATEGORY:click')) AS clicks FROM s WHERE n <= 10 GROUP BY user_id""")
def segment_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.col("value").alias("duration"), F.expr(TITLE).alias("title"))
    made = segments.segment_summary(rows, 10, "user_id")
    return made.select("user_id", "segments", F.round("total_duration", 6).alias("total_duration"), F.round("average_duration", 6).alias("average_duration"), "ad_breaks", F.coalesce(F.try_element_at("categories", F.lit("click")), F.lit(0)).cast("long").alias("clicks"))


@query("""SELECT user_id, count(*) AS segment_count, round(avg(value), 6) AS average_duration, min(value) AS min_duration, max(value) AS max_duration, bool_or(event_type = 'error') AS has_discontinuity, min(event_id // 1000) AS min_kbps, max(event_id // 1000) AS max_kbps, count(DISTINCT event_type) AS codecs
 FROM events GROUP BY user_id""")
def playlist_analysis(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("playlist_url", F.col("user_id"))
    s = e.select("playlist_url", F.col("value").alias("duration"), F.lit("").alias("title"), (F.col("event_type") == "error").alias("discontinuity"))
    v = e.select("playlist_url", F.col("event_id").alias("bandwidth"), F.col("event_type").alias("codecs"), F.lit(None).cast("string").alias("resolution"))
    made = segments.playlist_analysis(e.select("playlist_url").distinct(), s, v)
    return made.select(F.col("playlist_url").alias("user_id"), "segment_count", F.round("average_duration", 6).alias("average_duration"), "min_duration", "max_duration", "has_discontinuity", "min_kbps", "max_kbps", F.size("codecs_counts").cast("long").alias("codecs"))


@query("SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS n FROM customer) WHERE n = 2")
def select_by_index(spark, sf_dir):
    return catalog.select_by_index(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_name", 2).select("c_nationkey", "c_custkey", "c_name")


@query("SELECT user_id AS playlist_url, max(event_id) AS pos, arg_max(event_type, event_id) AS uri FROM events GROUP BY user_id")
def last_segment(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("playlist_url"), F.col("event_id").alias("pos"), F.col("event_type").alias("uri"))
    return segments.last_segment(rows)


@query("""SELECT vec_id, list_min(embedding) AS low, list_max(embedding) AS high, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding), 9) AS mean_square,
 len(list_filter(embedding, lambda x: abs(x::DOUBLE) > 0.5)) = 0 AS silent, CAST(len(embedding) AS INTEGER) AS samples, len(embedding) / 8.0::DOUBLE AS seconds FROM embeddings""")
def pcm_stats(spark, sf_dir):
    pcm = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_min(pcm).alias("low"), F.array_max(pcm).alias("high"), F.round(audio.mean_square(pcm), 9).alias("mean_square"), audio.is_silent(pcm, 0.5).alias("silent"), F.size(pcm).alias("samples"), audio.duration(pcm, F.lit(8)).alias("seconds"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(trunc(greatest(-1, least(1, x::DOUBLE * 4)) * 32767) AS SMALLINT)), ',') AS samples FROM embeddings")
def pcm16_quantize(spark, sf_dir):
    loud = F.transform("embedding", lambda x: x.cast("double") * 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(audio.pcm16(loud), lambda x: x.cast("string")), ",").alias("samples"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS next, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings)
 SELECT label, vec_id, next, round(greatest(0, list_cosine_similarity(e, f)), 6) AS similarity FROM v WHERE next IS NOT NULL""")
def fingerprint_similarity(spark, sf_dir):
    from lagloom.operators.alignment import likeness

    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.lead(F.struct("vec_id", "embedding")).over(w).alias("n")).where("n is not null")
    return rows.select("label", "vec_id", F.col("n.vec_id").alias("next"), F.round(likeness(F.col("embedding"), F.col("n.embedding")), 6).alias("similarity"))


@query("SELECT vec_id, CAST(vec_id % 7 - 3 AS INTEGER) AS lag, true AS sure FROM embeddings")
def temporal_alignment(spark, sf_dir):
    """Each vector against itself shifted by a lag that the search must find again."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"), (F.col("vec_id") % 7 - 3).cast("int").alias("shift"))
    pad = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.sin(i * 12.9898 + F.col("vec_id")) / 9)
    later = F.when(F.col("shift") > 0, F.concat(pad(F.greatest(F.lit(1), F.col("shift"))), F.col("a"))).otherwise(F.slice("a", 1 - F.col("shift"), F.size("a")))
    found = rows.withColumn("b", later).withColumn("best", best_lag(F.col("a"), F.col("b"), 5))
    return found.select("vec_id", F.col("best.lag").alias("lag"), (F.col("best.correlation") > 0.999).alias("sure"))


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END, ''), nullif(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END, ''), r_name) AS content_type,
 CASE WHEN n_regionkey = 1 AND c_custkey % 2 = 0 THEN false WHEN n_regionkey = 1 THEN true ELSE c_custkey % 2 <> 0 END AS enabled FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def inherit_content_type(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    flat = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rows = flat.select(
        "c_custkey", F.col("r_name").alias("group_content_type"), F.lit(None).cast("boolean").alias("group_enabled"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("broadcast_content_type"), F.lit(None).cast("boolean").alias("broadcast_enabled"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("").alias("content_type"), F.when(F.col("c_custkey") % 2 == 0, False).when(F.col("n_regionkey") != 1, True).alias("enabled"), F.lit("hls").alias("type"), F.lit("").alias("url"),
    )
    return catalog.inherit(rows).select("c_custkey", "content_type", "enabled")


LAYERS_SQL = "layers AS (SELECT n_name AS key, n_nationkey AS value, 1 AS priority FROM nation UNION ALL SELECT n_name, CASE WHEN n_regionkey = 2 THEN NULL ELSE 100 + n_nationkey END, 2 FROM nation WHERE n_regionkey > 0 UNION ALL SELECT n_name, 200 + n_nationkey, 3 FROM nation WHERE n_regionkey = 3)"


@query(f"WITH {LAYERS_SQL} SELECT key, arg_max(value, priority) AS value FROM layers WHERE value IS NOT NULL GROUP BY key UNION ALL SELECT r_name, r_regionkey FROM region WHERE r_name NOT IN (SELECT key FROM layers)")
def config_priority_merge(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    one = n.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value"), F.lit(1).alias("priority"))
    two = n.where("n_regionkey > 0").select(F.col("n_name").alias("key"), F.when(F.col("n_regionkey") != 2, F.col("n_nationkey") + 100).alias("value"), F.lit(2).alias("priority"))
    three = n.where("n_regionkey = 3").select(F.col("n_name").alias("key"), (F.col("n_nationkey") + 200).alias("value"), F.lit(3).alias("priority"))
    merged = config.merge_layers(one.unionByName(two).unionByName(three))
    return config.with_defaults(merged, table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("value")))


# Settings of customers in four layers: their region's, nation's, segment's, and those of their orders, of which there are many.
TRACED_SQL = """l AS (SELECT c_custkey AS key, 'region' AS layer, 1 AS priority, CAST(n_regionkey AS BIGINT) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 'nation', 2, c_nationkey + 100 FROM customer WHERE c_nationkey % 2 = 0
 UNION ALL SELECT c_custkey, 'segment', 3, CASE WHEN c_custkey % 3 = 0 THEN length(c_mktsegment) END FROM customer UNION ALL SELECT o_custkey, 'orders', 4, o_orderkey FROM orders WHERE o_custkey % 5 <> 0)"""


@query(f"WITH {TRACED_SQL}, o AS (SELECT key, layer, priority, max(value) AS value FROM l WHERE value IS NOT NULL GROUP BY ALL) SELECT key, arg_max(value, priority) AS value, arg_max(layer, priority) AS layer, array_to_string(list(layer ORDER BY priority DESC)[2:], ',') AS hidden FROM o GROUP BY key")
def traced_settings(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    row = lambda key, layer, priority, value: (F.col(key).alias("key"), F.lit(layer).alias("layer"), F.lit(priority).alias("priority"), value.cast("long").alias("value"))
    layers = [
        c.join(n, c.c_nationkey == n.n_nationkey).select(*row("c_custkey", "region", 1, F.col("n_regionkey"))), c.where("c_nationkey % 2 = 0").select(*row("c_custkey", "nation", 2, F.col("c_nationkey") + 100)),
        c.select(*row("c_custkey", "segment", 3, F.when(F.col("c_custkey") % 3 == 0, F.length("c_mktsegment")))), o.where("o_custkey % 5 <> 0").select(*row("o_custkey", "orders", 4, F.col("o_orderkey"))),
    ]
    made = config.traced_layers(layers[0].unionByName(layers[1]).unionByName(layers[2]).unionByName(layers[3]))
    return made.withColumn("hidden", F.array_join("hidden", ","))


@query("""SELECT p_partkey, rate > 0 AND channels > 0 AND samples > 0 AS is_valid, array_to_string(list_filter([CASE WHEN rate <= 0 THEN 'invalid sample rate' END, CASE WHEN channels <= 0 THEN 'invalid channel count' END, CASE WHEN samples = 0 THEN 'no audio data' END,
 CASE WHEN d < -1 OR d > 5 THEN printf('unexpected audio duration: got %.1fs, expected 20.0s', d + 20) END], lambda x: x IS NOT NULL), '; ') AS errors
 FROM (SELECT p_partkey, p_size % 5 AS rate, p_partkey % 3 AS channels, p_size % 7 AS samples, p_size - 20.0::DOUBLE AS d FROM part)""")
def validation_errors(spark, sf_dir):
    v = validate.stream_validation(F.lit("hls"), F.col("p_size") % 5, F.col("p_partkey") % 3, F.col("p_size") % 7, F.col("p_size").cast("double"), 20.0)
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.is_valid", F.array_join("v.errors", "; ").alias("errors"))


@query("""SELECT group_key, broadcast_key, stream_name, problem FROM (
 SELECT CAST(n_regionkey AS VARCHAR) AS group_key, CAST(n_nationkey AS VARCHAR) AS broadcast_key, CAST(c_custkey AS VARCHAR) AS stream_name,
 CASE WHEN c_acctbal < 0 THEN 'a stream needs a URL' WHEN c_custkey % 10 = 0 THEN 'a role must be source or cdn, not relay' WHEN c_mktsegment = 'BUILDING' THEN 'a content type must be one of music, news, talk, sports, mixed, not BUILDING' END AS problem
 FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE problem IS NOT NULL""")
def catalog_problems(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_regionkey").cast("string").alias("group_key"), F.lit("g").alias("group_name"), F.lit("news").alias("group_content_type"), F.col("n_nationkey").cast("string").alias("broadcast_key"), F.col("n_name").alias("broadcast_name"), F.lit("").alias("broadcast_content_type"), F.lit(True).alias("broadcast_enabled"),
        F.col("c_custkey").cast("string").alias("stream_name"), F.when(F.col("c_acctbal") >= 0, "u").alias("url"), F.when(F.col("c_custkey") % 10 == 0, "relay").when(F.col("c_custkey") % 2 == 0, "source").otherwise("cdn").alias("role"), F.when(F.col("c_mktsegment") == "BUILDING", "BUILDING").otherwise("").alias("content_type"), F.lit(True).alias("enabled"),
    )
    return catalog.problems(rows).where("level = 3").drop("level")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS last, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM last""")
def metadata_changes(spark, sf_dir):
    return changed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


SILENT_S = 6 * 3600


@query(f"""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS last, ts - lag(ts) OVER w > INTERVAL {SILENT_S} SECOND AS gone, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR gone OR event_type IS DISTINCT FROM last""")
def metadata_sessions(spark, sf_dir):
    """Changes of streams that are forgotten once they have been silent: the batch twin of state.follow()."""
    return changed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", silent_s=SILENT_S).select("user_id", "event_id", "event_type")


@query(f"""WITH e AS (SELECT user_id, ts FROM events UNION ALL SELECT c_custkey, TIMESTAMP '2024-01-03 00:00:00' FROM customer), m AS (SELECT user_id, (epoch_us(ts) + 999) // 1000 AS ms FROM e), g AS (SELECT user_id, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS heard FROM m)
 SELECT user_id, ms AS since_ms, ms + {SILENT_S * 1000} AS until_ms, 'timeout: no data for {SILENT_S}s' AS error FROM g WHERE coalesce(heard, 1706659200000) - ms > {SILENT_S * 1000}""")
def silent_streams(spark, sf_dir):
    """Deadlines that streams have missed, customers being those expected since a day: the batch twin of state.silences()."""
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("2024-01-03 00:00:00").cast("timestamp").alias("started"))
    found = silences_of(table(spark, sf_dir, "events"), "user_id", "ts", SILENT_S, F.timestamp_millis(F.lit(1706659200000)), expected)
    return found.select("user_id", F.unix_millis("since").alias("since_ms"), F.unix_millis("ts").alias("until_ms"), "error")


@query("""SELECT stream, ts, title FROM (SELECT *, lag(title) OVER w AS last, row_number() OVER w AS n FROM (SELECT user_id AS stream, event_id AS ts, nullif(nullif(event_type, 'error'), 'view') AS title FROM events) WHERE title IS NOT NULL WINDOW w AS (PARTITION BY stream ORDER BY ts)) WHERE n = 1 OR title <> last""")
def title_changes(spark, sf_dir):
    title = F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "view", F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("ts"), title.alias("title"))
    return changed(rows, "stream", ["ts"], "title", keep_empty=False)


@query("SELECT event_type AS event, round(sum(value), 4) AS seconds, round(sum(value) / sum(sum(value)) OVER () * 100, 6) AS percent, upper(left(event_type, 1)) || substr(event_type, 2) AS title FROM events GROUP BY event_type")
def percent_of_total(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("event")).agg(F.sum("value").alias("seconds"))
    return timers.shares(by).select("event", F.round("seconds", 4).alias("seconds"), F.round("percent", 6).alias("percent"), "title")


@query("""SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'a=1&b=2' AS suffixed, regexp_replace('file://' || url, '^file://', '') AS bare FROM pages""")
def url_suffixes(spark, sf_dir):
    """A ready query string behind each URL, and what is left of a file's URL."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.with_suffix(url, "a=1&b=2").alias("suffixed"), urls.local_path(F.concat(F.lit("file://"), url)).alias("bare"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Master Playlist' WHEN page_id % 2 = 0 THEN 'Live Media Playlist' ELSE 'VOD Media Playlist' END AS kind,
 CASE WHEN page_id % 5 = 0 THEN 'PASS' ELSE 'FAIL' END AS result, CASE WHEN contains(url, '#') THEN 'Healthy' ELSE 'Unhealthy' END AS health FROM pages""")
def report_labels(spark, sf_dir):
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", text.playlist_kind(n % 3 == 0, n % 2 == 0).alias("kind"), text.pass_label(n % 5 == 0).alias("result"), text.health_label(F.contains("url", F.lit("#"))).alias("health"))


@query("""SELECT user_id, round(sum(CASE WHEN event_type IN ('click', 'purchase') THEN value END), 4) AS seconds FROM events GROUP BY user_id HAVING user_id = (SELECT min(user_id) FROM events)""")
def response_time(spark, sf_dir):
    """The sum of several named events of the first user."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("user_id").alias("user_id"))
    own = events.join(F.broadcast(first), "user_id").select("user_id", F.col("event_type").alias("event"), F.col("value").alias("seconds"))
    return timers.response_seconds(own, ["click", "purchase"]).join(F.broadcast(first)).select("user_id", F.round("seconds", 4).alias("seconds"))


@query("SELECT user_id, event_type, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 > 3600 AS slow, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY user_id, event_type")
def event_timer(spark, sf_dir):
    made = timers.durations(table(spark, sf_dir, "events"), ["user_id", "event_type"])
    return made.select("user_id", "event_type", (F.col("seconds") > 3600).alias("slow"), F.round("seconds", 3).alias("seconds"))


@query("SELECT event_id, 'group_' || event_type AS key, 'group' AS head, event_type AS rest, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'named' END AS display FROM events")
def key_split_display(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("key", text.measurement_key(F.lit("group"), F.col("event_type"))).withColumn("k", text.split_key(F.col("key")))
    return rows.select("event_id", "key", F.col("k.group").alias("head"), F.col("k.broadcast").alias("rest"), text.display_name(F.when(F.col("event_id") % 2 == 0, "").otherwise("named"), F.col("k.broadcast")).alias("display"))


@query("SELECT conv_id, turn, CASE WHEN strpos(text, ' - ') > 0 THEN trim(substr(text, 1, strpos(text, ' - ') - 1)) END AS artist, CASE WHEN strpos(text, ' - ') > 0 THEN trim(substr(text, strpos(text, ' - ') + 3)) ELSE text END AS title, role AS r, CASE lower(role) WHEN 'music' THEN 'music' ELSE 'news' END AS content_type FROM conversations")
def icy_titles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.icy_title(F.col("text"))["artist"].alias("artist"), text.icy_title(F.col("text"))["title"].alias("title"), F.col("role").alias("r"), text.content_type(F.col("role")).alias("content_type"))


@query("SELECT event_id, CAST(trunc((value - 60) * 1000) AS BIGINT) AS ms, event_id * 1000003 // 1000000 AS whole_ms, event_id * 17 // 1000 AS kbps FROM events")
def unit_conversions(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", numbers.seconds_to_ms(F.col("value") - 60).alias("ms"), numbers.ns_to_ms(i * 1000003).alias("whole_ms"), numbers.kbps(i * 17).alias("kbps"))


@query("SELECT role, type, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'cdn' END AS role, p_type AS type, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS on1, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS on2 FROM part) WHERE coalesce(on1, true) AND on2 GROUP BY role, type")
def streams_by_role(spark, sf_dir):
    flag = lambda c: F.when(F.col(c) % 3 == 1, True).when(F.col(c) % 3 == 2, False)
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "source").otherwise("cdn").alias("role"), F.col("p_type").alias("type"), flag("p_size").alias("broadcast_enabled"), flag("p_partkey").alias("enabled"))
    both = catalog.streams_of(rows, "source").unionByName(catalog.streams_of(rows, "cdn"))
    return both.groupBy("role", "type").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS_SQL} SELECT broadcast_key, 5 AS sources, 1.5::DOUBLE AS total, {_pivot_sql()} FROM first GROUP BY broadcast_key")
def result_document(spark, sf_dir):
    """One nested JSON document for each broadcast, its fields taken out again, since each writer of JSON has its own form of numbers."""
    from lagloom.plans import benchmark

    lags = liveness.classify(_pairs(spark, sf_dir))
    broadcasts = lags.select("broadcast_key").distinct().withColumns({"name": F.lit("n"), "content_type": F.lit(None).cast("string"), "total_s": F.lit(1.5), "error": F.lit(None).cast("string")})
    none = broadcasts.where(F.lit(False))
    made = benchmark.documents(benchmark.Run(broadcasts, none, none, none, lags))
    at = lambda path, kind="string": F.get_json_object("document", f"$.{path}").cast(kind)
    slots = [c for s, _ in liveness.SLOTS for c in (at(f"liveness_metrics.{s}.lag_seconds", "double").alias(s), at(f"liveness_metrics.{s}.status").alias(f"{s}_status"))]
    return made.select("broadcast_key", F.lit(len(liveness.SLOTS)).alias("sources"), at("total_benchmark_time_seconds", "double").alias("total"), *slots)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type AS comparison, round(max(value), 6) AS max_lag, count(*) AS n FROM events WHERE value < 100 GROUP BY 1, 2")
def lag_windows(spark, sf_dir):
    from lagloom.streaming.changes import lag_windows as windows

    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("comparison"), F.col("value").alias("lag_seconds"), F.when(F.col("value") < 100, "MATCH").alias("status"))
    return windows(rows, "1 day").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "comparison", F.round("max_lag", 6).alias("max_lag"), "n")


@query("""SELECT c_custkey, kind NOT IN ('music') AS speech_features, kind IN ('music', 'mixed') AS harmonic_features, kind = 'music' AS chroma_features
 FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'mixed' ELSE 'news' END AS kind FROM customer)""")
def content_settings_lookup(spark, sf_dir):
    kind = F.when(F.col("c_custkey") % 4 == 0, "Music").when(F.col("c_custkey") % 4 == 1, "mixed").when(F.col("c_custkey") % 4 == 2, "opera")
    return config.with_content_settings(table(spark, sf_dir, "customer").select("c_custkey", kind.alias("content_type"))).drop("content_type")


GROUPS_SQL = "g AS (SELECT CAST(r_regionkey AS VARCHAR) AS group_key, CAST(n_nationkey AS VARCHAR) AS broadcast_key, n_name, r_regionkey % 2 = 1 AS group_enabled, n_nationkey % 3 <> 0 AS broadcast_enabled FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _groups(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_regionkey").cast("string").alias("group_key"), F.col("r_name").alias("group_name"), F.col("n_nationkey").cast("string").alias("broadcast_key"), "n_name", (F.col("r_regionkey") % 2 == 1).alias("group_enabled"), (F.col("n_nationkey") % 3 != 0).alias("broadcast_enabled")
    )


@query(f"WITH {GROUPS_SQL} SELECT (SELECT count(*) FROM g WHERE group_enabled AND broadcast_enabled) AS broadcasts, (SELECT min(group_key) FROM g WHERE group_enabled) AS first_group, (SELECT count(DISTINCT group_key) FROM g WHERE group_enabled AND broadcast_key = '7') AS groups_with")
def catalog_counts(spark, sf_dir):
    g = _groups(spark, sf_dir)
    a = catalog.enabled_broadcasts(g).select(F.col("n").alias("broadcasts"))
    return a.join(catalog.first_group(g).select(F.col("group_key").alias("first_group"))).join(catalog.groups_with(g, "7").agg(F.count("*").alias("groups_with")))


@query(f"WITH {GROUPS_SQL} SELECT group_key, broadcast_key FROM (SELECT *, row_number() OVER (ORDER BY broadcast_key) - 1 AS n FROM g WHERE group_enabled AND broadcast_enabled AND group_key = (SELECT min(group_key) FROM g WHERE group_enabled)) WHERE n = 1")
def select_broadcast(spark, sf_dir):
    return catalog.select_broadcast(_groups(spark, sf_dir), 1).select("group_key", "broadcast_key")


@query("SELECT page_id, 'a' AS server, CAST(NULL AS VARCHAR) AS other, length(url) AS via FROM pages")
def shown_headers(spark, sf_dir):
    headers = F.create_map(F.lit("server"), F.lit("a"), F.lit("x-other"), F.col("url"), F.lit("via"), F.length("url").cast("string"))
    h = text.shown_headers(headers)
    return table(spark, sf_dir, "pages").select("page_id", F.try_element_at(h, F.lit("server")).alias("server"), F.try_element_at(h, F.lit("x-other")).alias("other"), F.try_element_at(h, F.lit("via")).cast("long").alias("via"))


@query("""SELECT vec_id, len(a) AS n, round(a[1]::DOUBLE, 6) AS first_a, round(b[1]::DOUBLE, 6) AS first_b, len(p) AS prefix FROM (
 SELECT vec_id, embedding[greatest(0, -lag) + 1 : 64 - greatest(0, lag)] AS a, embedding[greatest(0, lag) + 1 : 64 - greatest(0, -lag)] AS b, embedding[1 : 20] AS p FROM (SELECT *, CAST(vec_id % 9 - 4 AS INTEGER) AS lag FROM embeddings))""")
def overlap_truncate(spark, sf_dir):
    lag = (F.col("vec_id") % 9 - 4).cast("int")
    both = audio.overlap(F.col("embedding"), F.col("embedding"), lag)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", both.alias("o"), F.size(audio.first_seconds(F.col("embedding"), 2.5, F.lit(8))).cast("long").alias("prefix"))
    return rows.select("vec_id", F.size("o.a").cast("long").alias("n"), F.round(F.col("o.a")[0].cast("double"), 6).alias("first_a"), F.round(F.col("o.b")[0].cast("double"), 6).alias("first_b"), "prefix")
