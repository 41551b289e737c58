"""Run reports, diffs, stateful decisions, the outbox ledger and generated identities."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import diffs, folds, outbox, runs
from tidemark.plans.catalog import query
from tidemark.session import scratch_dir
from tidemark.sources import captures

LIMITS = "concat_ws(',', " + ", ".join(
    [f"CASE WHEN {c} > 0 THEN '{r}' END" for c, r in runs.COUNTED_LIMITS]
    + ["CASE WHEN observation_status = 'failed' THEN 'observer_failed' END", "CASE WHEN observation_status = 'partial' THEN 'partial_observation' END",
       "CASE WHEN observer_slow_queries > 0 THEN 'observer_query_delays' END"]
) + ")"
LOAD = " + ".join(runs.LOAD_COUNTERS)
STATUS = f"""st AS (SELECT run_id, case_id, repetition, correct, control_ok, observation_status, p95_ns, {LIMITS} AS reasons,
  CASE WHEN aborted THEN 'aborted' WHEN {LOAD} > 0 THEN 'limited' ELSE 'met' END AS load_status, aborted FROM v_runs),
rated AS (SELECT *, CASE WHEN aborted OR NOT correct THEN 'failed' WHEN reasons <> '' THEN 'limited' ELSE 'complete' END AS outcome FROM st)"""


@query("a22_load_status", f"""WITH {STATUS}
SELECT run_id, reasons, load_status, outcome, CASE WHEN observation_status = 'complete' THEN p95_ns END AS visibility_p95 FROM rated""")
def _(t):
    return runs.load_status(t.v_runs).select(
        "run_id", F.array_join("limit_reasons", ",").alias("reasons"), "load_status", "outcome",
        F.when(F.col("observation_status") == "complete", F.col("p95_ns")).alias("visibility_p95"),
    )


@query("a23_case_outcome", f"""WITH {STATUS}, r AS (SELECT case_id, bool_or(outcome = 'limited') AS lim FROM rated GROUP BY case_id),
f AS (SELECT case_id, bool_or(action = 'stop_requested' AND elapsed_ns - planned_ns > 250000000) AS lim FROM v_faults GROUP BY case_id)
SELECT coalesce(r.case_id, f.case_id) AS case_id, CASE WHEN coalesce(r.lim, false) OR coalesce(f.lim, false) THEN 'limited' ELSE 'complete' END AS outcome
FROM r FULL JOIN f ON f.case_id = r.case_id""")
def _(t):
    return runs.case_outcome(runs.load_status(t.v_runs), t.v_faults)


@query("j17_fault_traces", """
WITH f AS (SELECT run_id, count(*) AS n, string_agg(action, ',' ORDER BY elapsed_ns, action) AS actions FROM v_faults GROUP BY run_id)
SELECT r.run_id, coalesce(n, 0) AS fault_count, actions, correct AND control_ok AND coalesce(n, 0) >= 4 AS recovery_correct FROM v_runs r LEFT JOIN f ON f.run_id = r.run_id""")
def _(t):
    return runs.recovery_runs(t.v_runs, t.v_faults)


@query("a13_method_summary", """
WITH o AS (SELECT method, elapsed_ns, submitted * 1e9 / elapsed_ns AS eps, row_number() OVER (PARTITION BY method ORDER BY elapsed_ns) AS rn,
  row_number() OVER (PARTITION BY method ORDER BY submitted * 1e9 / elapsed_ns) AS re, count(*) OVER (PARTITION BY method) AS n FROM v_method_runs)
SELECT method, max(CASE WHEN rn = floor(n / 2.0) + 1 THEN elapsed_ns END) AS median_elapsed_ns,
  round(max(CASE WHEN re = floor(n / 2.0) + 1 THEN eps END), 3) AS median_eps FROM o GROUP BY method""")
def _(t):
    return runs.method_summary(t.v_method_runs).withColumn("median_eps", F.round("median_eps", 3))


GRID = """grid AS (SELECT c.case_id, m.method, r.repetition FROM (SELECT DISTINCT case_id FROM v_method_runs) c
  CROSS JOIN (VALUES ('insert'), ('batch-insert'), ('copy-merge')) m(method) CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT)), (CAST(3 AS BIGINT))) r(repetition))"""


@query("a14_completeness", f"""WITH {GRID},
seen AS (SELECT case_id, method, repetition, count(*) AS n, bool_and(correct) AS ok FROM v_method_runs GROUP BY case_id, method, repetition)
SELECT coalesce(g.case_id, s.case_id) AS case_id, coalesce(g.method, s.method) AS method, coalesce(g.repetition, s.repetition) AS repetition,
  CASE WHEN s.n IS NULL THEN 'missing' WHEN g.case_id IS NULL THEN 'unknown' WHEN s.n > 1 THEN 'repeated' ELSE 'incorrect' END AS fault
FROM grid g FULL JOIN seen s ON s.case_id = g.case_id AND s.method = g.method AND s.repetition = g.repetition WHERE s.n IS NULL OR g.case_id IS NULL OR s.n > 1 OR NOT s.ok""")
def _(t):
    return runs.completeness(t.v_method_runs, t.v_method_runs, 3)


@query("a15_completed_repetitions", """
SELECT case_id, repetition FROM v_method_runs GROUP BY case_id, repetition HAVING count(DISTINCT method) FILTER (WHERE correct) = 3""")
def _(t):
    return runs.completed_repetitions(t.v_method_runs)


@query("a15_completed_runs", """
SELECT 'database' AS kind, case_id, repetition FROM v_method_runs GROUP BY case_id, repetition HAVING count(DISTINCT method) FILTER (WHERE correct) = 3
UNION ALL SELECT CASE WHEN case_id % 2 = 0 THEN 'pipeline' ELSE 'recovery' END, case_id, repetition FROM v_runs WHERE correct""")
def _(t):
    """The three forms of a study: database cases by their methods, pipeline and recovery cases by their runs."""
    database = t.v_method_runs.select(F.lit("database").alias("kind"), "case_id", "method", "repetition", "correct")
    others = t.v_runs.select(F.when(F.col("case_id") % 2 == 0, "pipeline").otherwise("recovery").alias("kind"), "case_id", F.lit(None).cast("string").alias("method"), "repetition", "correct")
    return runs.completed_runs(database.unionByName(others))


@query("a18_ranges", """
SELECT case_id, min(peak_open) AS min_peak_open, max(peak_open) AS max_peak_open, min(p95_ns) AS min_p95_ns, max(p95_ns) AS max_p95_ns FROM v_runs GROUP BY case_id""")
def _(t):
    return runs.ranges(t.v_runs, ["case_id"], ["peak_open", "p95_ns"])


@query("a19_mean_acquisition", "SELECT run_id, round(acquire_ns / greatest(1, requests) / 1e6, 6) AS mean_ms FROM v_runs")
def _(t):
    return t.v_runs.select("run_id", F.round(runs.mean_acquisition_ms(F.col("acquire_ns"), F.col("requests")), 6).alias("mean_ms"))


@query("a16_session_groups", """
SELECT c_mktsegment AS user_name, CASE WHEN c_custkey % 3 = 0 THEN 'bench' ELSE 'other' END AS application,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'idle' ELSE 'active' END AS state, count(*) AS n FROM customer GROUP BY 1, 2, 3""")
def _(t):
    key = F.col("c_custkey")
    sessions = t.customer.select(
        F.col("c_mktsegment").alias("user_name"), F.when(key % 3 == 0, "bench").when(key % 3 == 1, F.col("c_name")).alias("application"),
        F.when(key % 5 == 0, F.lit(None)).when(key % 2 == 0, "idle").otherwise("active").alias("state"),
    )
    return runs.session_groups(sessions, "bench")


@query("a24_audit_totals", f"""WITH {STATUS}, c AS (SELECT case_id, count(*) AS n, bool_or(outcome = 'limited') AS lim FROM rated GROUP BY case_id)
SELECT CAST(coalesce(sum(n) FILTER (WHERE case_id % 3 = 0), 0) AS BIGINT) AS database_runs, CAST(coalesce(sum(n) FILTER (WHERE case_id % 3 = 1), 0) AS BIGINT) AS pipeline_runs,
  CAST(coalesce(sum(n) FILTER (WHERE case_id % 3 = 2), 0) AS BIGINT) AS recovery_runs, count(*) FILTER (WHERE lim) AS limited_cases FROM c""")
def _(t):
    kind = F.get(F.array(F.lit("database"), F.lit("pipeline"), F.lit("recovery")), (F.col("case_id") % 3).cast("int"))
    cases = runs.load_status(t.v_runs).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("runs"), F.when(F.bool_or(F.col("outcome") == "limited"), "limited").otherwise("complete").alias("status")
    ).withColumn("kind", kind)
    return runs.audit_totals(cases)


@query("a25_resource_summary", """
SELECT o_custkey % 50 AS run_id, min(o_orderkey * 31 % 100) AS min_memory_free, max(o_orderkey * 7919 % 4000000) AS max_rss_kib, max(o_totalprice) AS max_load,
  bool_or(o_orderstatus = 'P' AND o_orderkey % 997 = 3) AS triggered FROM orders GROUP BY 1""")
def _(t):
    key = F.col("o_orderkey")
    samples = t.orders.select(
        (F.col("o_custkey") % 50).alias("run_id"), (key * 31 % 100).alias("memory_free"), (key * 7919 % 4000000).alias("rss_kib"),
        F.col("o_totalprice").alias("load"), F.when((F.col("o_orderstatus") == "P") & (key % 997 == 3), "load").alias("stop_reason"),
    )
    return runs.resource_summary(samples, ["run_id"])


@query("a30_health", "WITH l AS (SELECT tenant_id, kind, arg_max(failed, seq) AS failed FROM v_operations GROUP BY tenant_id, kind) "
       "SELECT tenant_id, NOT bool_or(failed) AS ready, count(*) FILTER (WHERE failed) AS failed_kinds FROM l GROUP BY tenant_id")
def _(t):
    return folds.health(t.v_operations, ["tenant_id"])


LATEST = ", ".join(f"last_value(CASE WHEN kind = '{k}' THEN failed END IGNORE NULLS) OVER (ORDER BY seq) AS k{i}" for i, k in enumerate(labels.OPERATION_KINDS))
SUM = " + ".join(f"CAST(coalesce(k{i}, false) AS BIGINT)" for i in range(4))


@query("w12_health_timeline", f"WITH l AS (SELECT seq, {LATEST} FROM v_operations) SELECT seq, {SUM} AS failed_kinds, {SUM} = 0 AS ready FROM l")
def _(t):
    return folds.health_timeline(t.v_operations)


def bucket_requests(t):
    """Operations as requests, with time running a thousandfold so that buckets run dry."""
    return t.v_operations.select("tenant_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_ns"), F.col("seq").alias("request_id"))


BUCKET_SQL = """
WITH RECURSIVE r AS MATERIALIZED (SELECT tenant_id, epoch_us("at") AS at_ns, seq AS request_id, row_number() OVER (PARTITION BY tenant_id ORDER BY "at", seq) AS rn FROM v_operations),
f AS (SELECT tenant_id, at_ns, request_id, rn, CAST(0 AS DOUBLE) AS tokens, true AS allowed, CAST(0 AS BIGINT) AS remaining FROM r WHERE rn = 1
UNION ALL SELECT tenant_id, at_ns, request_id, rn, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1, CASE WHEN t >= 1 THEN CAST(floor(t - 1) AS BIGINT) ELSE 0 END
  FROM (SELECT r.*, least(CAST(1 AS DOUBLE), f.tokens + (r.at_ns - f.at_ns) / 1e9 * 1) AS t FROM f JOIN r ON r.tenant_id = f.tenant_id AND r.rn = f.rn + 1))
SELECT tenant_id, at_ns, request_id, allowed, remaining FROM f"""


@query("w10_token_bucket", BUCKET_SQL)
def _(t):
    return folds.token_bucket(bucket_requests(t), 1)


COOLDOWN = 3_600_000_000_000


def alert_operations(t):
    return t.v_operations.select("kind", "seq", (F.unix_micros(F.col("at").cast("timestamp")) * 1000).alias("at_ns"), (~(F.col("seq") % 9 == 0)).alias("failed"))


ALERT_SQL = f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT kind, seq, epoch_us("at") * 1000 AS at_ns, seq % 9 <> 0 AS failed, row_number() OVER (PARTITION BY kind ORDER BY seq) AS rn FROM v_operations),
f AS (SELECT kind, seq, at_ns, rn, failed AS state, at_ns AS last, CAST(0 AS BIGINT) AS held, CASE WHEN failed THEN 'failed' END AS line, CAST(0 AS BIGINT) AS suppressed FROM r WHERE rn = 1
UNION ALL SELECT r.kind, r.seq, r.at_ns, r.rn, r.failed,
  CASE WHEN r.failed AND NOT (f.state AND r.at_ns - f.last < {COOLDOWN}) THEN r.at_ns ELSE f.last END,
  CASE WHEN r.failed AND f.state AND r.at_ns - f.last < {COOLDOWN} THEN f.held + 1 ELSE 0 END,
  CASE WHEN r.failed AND NOT (f.state AND r.at_ns - f.last < {COOLDOWN}) THEN 'failed' WHEN NOT r.failed AND f.state THEN 'recovered' END, f.held
  FROM f JOIN r ON r.kind = f.kind AND r.rn = f.rn + 1)
SELECT kind, seq, at_ns, line AS state, suppressed FROM f WHERE line IS NOT NULL"""


@query("w11_alert_cooldown", ALERT_SQL)
def _(t):
    return folds.alert_cooldown(alert_operations(t), COOLDOWN)


@query("a8_outcome_counters", """
SELECT CASE kind WHEN 'storage' THEN 'success' WHEN 'progress' THEN 'timeout' ELSE 'error' END AS outcome, failed, count(*) AS n FROM v_operations GROUP BY 1, 2""")
def _(t):
    raw = F.when(F.col("kind") == "storage", "success").when(F.col("kind") == "progress", "timeout").otherwise(F.col("kind"))
    return t.v_operations.groupBy(labels.outcome(raw).alias("outcome"), "failed").agg(F.count(F.lit(1)).alias("n"))


@query("j13_snapshot_diff", """
WITH a AS (SELECT o_orderkey AS k, o_custkey AS v, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 19 <> 3),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 23 = 4 THEN o_custkey + 1 ELSE o_custkey END AS v, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 17 <> 2)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'content' END AS difference
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v OR a.s IS DISTINCT FROM b.s""")
def _(t):
    from tidemark.operators.store import snapshot_diff

    key = F.col("o_orderkey")
    s = F.when(key % 5 != 0, F.col("o_orderstatus")).alias("s")
    a = t.orders.where(key % 19 != 3).select(key.alias("k"), F.col("o_custkey").alias("v"), s)
    b = t.orders.where(key % 17 != 2).select(key.alias("k"), F.when(key % 23 == 4, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("v"), s)
    return snapshot_diff(a, b, ["k"], ["v", "s"])


@query("j14_registry_diff", """
SELECT p_partkey, CASE WHEN p_partkey % 13 = 1 THEN p_size + 1 ELSE p_size END AS p_size, p_brand, 'recorded' AS side, CASE WHEN p_partkey % 29 = 5 THEN 2 ELSE 1 END AS copies
FROM part WHERE p_partkey % 13 = 1 AND p_partkey % 11 <> 0
UNION ALL SELECT p_partkey, p_size, p_brand, 'recorded', 1 FROM part WHERE p_partkey % 29 = 5 AND p_partkey % 13 <> 1 AND p_partkey % 11 <> 0
UNION ALL SELECT p_partkey, p_size, p_brand, 'approved', 1 FROM part WHERE p_partkey % 13 = 1 OR p_partkey % 11 = 0""")
def _(t):
    key = F.col("p_partkey")
    approved = t.part.select("p_partkey", "p_size", "p_brand")
    changed = approved.where(key % 11 != 0).withColumn("p_size", F.when(key % 13 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")))
    out = diffs.registry_diff(changed.unionByName(changed.where(key % 29 == 5)), approved)
    return out.withColumn("copies", F.col("copies").cast("int"))


IDENTITY = {"revision": "revision", "source": "source", "seed": "seed", "mode": "mode", "dirty": "dirty status"}


@query("j15_identity_diff", """
SELECT p_partkey AS id, concat_ws(', ', CASE WHEN p_partkey % 7 = 1 THEN 'revision' END, CASE WHEN p_partkey % 6 = 2 THEN 'source' END,
  CASE WHEN p_partkey % 5 = 3 THEN 'seed' END, CASE WHEN p_partkey % 9 = 4 THEN 'dirty status' END) AS differences
FROM part WHERE p_partkey % 7 = 1 OR p_partkey % 6 = 2 OR p_partkey % 5 = 3 OR p_partkey % 9 = 4""")
def _(t):
    key = F.col("p_partkey")
    a = t.part.select(key.alias("id"), F.col("p_name").alias("revision"), F.lit(None).cast("string").alias("source"), F.col("p_size").alias("seed"),
                      F.lit("full").alias("mode"), F.lit(False).alias("dirty"))
    b = t.part.select(
        key.alias("id"), F.when(key % 7 == 1, "x").otherwise(F.col("p_name")).alias("revision"), F.when(key % 6 == 2, "x").alias("source"),
        F.when(key % 5 == 3, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("seed"), F.lit("full").alias("mode"), (key % 9 == 4).alias("dirty"),
    )
    return diffs.identity_diff(a, b, "id", IDENTITY)


# The identity of a study, by column and label, in the order in which differences are named.
STUDY_IDENTITY = {
    "source_sha": "revision", "source_print": "source", "controls_print": "controls", "images_print": "images", "config_print": "runtime",
    "seed": "seed", "mode": "mode", "source_dirty": "dirty status",
}
DIFFERS = {c: f"p_partkey % {n} = {n - 3}" for c, n in zip(STUDY_IDENTITY, (7, 6, 5, 9, 11, 13, 8, 10), strict=True)}


@query("j15_study_identity", f"""
SELECT p_partkey AS id, CASE WHEN p_partkey % 31 IN (1, 2) THEN 'revision, source, controls, images, runtime, seed, mode, dirty status' WHEN p_partkey % 31 = 3 THEN 'absent'
  ELSE concat_ws(', ', {", ".join(f"CASE WHEN {DIFFERS[c]} THEN '{label}' END" for c, label in STUDY_IDENTITY.items())}) END AS differences
FROM part WHERE p_partkey % 31 IN (1, 2, 3) OR {" OR ".join(DIFFERS.values())}""")
def _(t):
    """All eight fields; keys on the left or the right side only, and one of them without any value."""
    text = {c: F.concat(F.lit(f"{c}-"), F.col("p_partkey").cast("string")) for c in STUDY_IDENTITY}
    n = F.col("p_partkey") % 31
    left = t.part.where(n != 2).select(F.col("p_partkey").alias("id"), *[F.when(n != 3, text[c]).alias(c) for c in STUDY_IDENTITY])
    right = t.part.where((n != 1) & (n != 3)).select(F.col("p_partkey").alias("id"), *[F.when(F.expr(DIFFERS[c]) & (n != 2), "x").otherwise(text[c]).alias(c) for c in STUDY_IDENTITY])
    return diffs.identity_diff(left, right, "id", STUDY_IDENTITY)


@query("a28_fingerprints", """
WITH h AS (SELECT o_custkey % 100 AS run_id, sha256(concat('{"o_orderkey":', CAST(o_orderkey AS STRING), ',"o_orderpriority":"', o_orderpriority, '\\u0026"}')) AS h FROM orders)
SELECT run_id, sha256(concat('["', string_agg(h, '","' ORDER BY h), '"]')) AS fingerprint FROM h GROUP BY run_id""")
def _(t):
    rows = t.orders.select((F.col("o_custkey") % 100).alias("run_id"), "o_orderkey", F.concat("o_orderpriority", F.lit("&")).alias("o_orderpriority"))
    return diffs.small_fingerprint(rows, ["run_id"], ["o_orderkey", "o_orderpriority"])


@query("a28_tree_fingerprints", """
WITH h AS (SELECT o_custkey % 3 AS run_id, sha256(concat('{"o_custkey":', CAST(o_custkey AS STRING), '}')) AS h, count(*) AS c FROM orders GROUP BY 1, 2),
l AS (SELECT run_id, left(h, 4) AS leaf, sha256(concat('["', string_agg(concat(h, ':', CAST(c AS STRING)), '","' ORDER BY h), '"]')) AS d, sum(c) AS n FROM h GROUP BY 1, 2)
SELECT run_id, CAST(sum(n) AS BIGINT) AS members, sha256(concat('["', string_agg(concat(leaf, ':', d), '","' ORDER BY leaf), '"]')) AS fingerprint FROM l GROUP BY run_id""")
def _(t):
    return diffs.fingerprint(t.orders.withColumn("run_id", F.col("o_custkey") % 3), ["run_id"], ["o_custkey"])


@query("p10_safe_fields", """
SELECT c_custkey AS run_id, c_custkey % 2 = 0 AS https, c_mktsegment AS tenant, c_custkey AS seed, c_custkey % 100 AS concurrency FROM customer""")
def _(t):
    key = F.col("c_custkey")
    config = t.customer.select(
        key.alias("run_id"), F.when(key % 2 == 0, "https://host").otherwise("http://host").alias("api_url"), F.col("c_name").alias("api_key"),
        F.col("c_mktsegment").alias("tenant"), key.alias("seed"), (key % 100).alias("concurrency"), F.lit("secret").alias("connection_string"),
    )
    return runs.safe_fields(config)


def reports(t):
    """Reports with raw samples at the top and nested, one per customer."""
    q = t.orders.groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("ack_ns"), F.count(F.lit(1)).alias("accepted"), F.sum("o_orderkey").alias("total_ns")
    )
    return q.withColumn("inner", F.struct(F.col("accepted").alias("stored"), F.col("ack_ns").alias("backlog")))


@query("p11_strip_samples", """
SELECT o_custkey AS run_id, false AS has_samples, false AS nested_samples, count(*) AS accepted, CAST(sum(o_orderkey) AS BIGINT) AS total_ns, count(*) AS stored FROM orders GROUP BY o_custkey""")
def _(t):
    return runs.strip_samples(reports(t), ["inner"]).select(
        "run_id", F.col("ack_ns").isNotNull().alias("has_samples"), F.col("inner.backlog").isNotNull().alias("nested_samples"),
        "accepted", "total_ns", F.col("inner.stored").alias("stored"),
    )


CAPTURE_FOLDERS = 1000


def capture_files(t):
    """The same reports as captures: one gzip JSON file for each run, written sample by sample, in folders by run number."""
    def write():
        base = scratch_dir(t.spark, "capture-files")
        file = F.concat((F.col("o_custkey") % CAPTURE_FOLDERS).cast("string"), F.lit("/"), F.col("o_custkey").cast("string")).alias("file")
        sample = [t.orders.select(file, F.lit(p).alias("path"), F.col("o_orderkey").alias("index"), F.col("o_orderkey").cast("string").alias("value")) for p in ("ack_ns", "inner.backlog")]
        totals = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("accepted"), F.sum("o_orderkey").alias("total_ns"))
        held = {"accepted": "accepted", "inner.stored": "accepted", "total_ns": "total_ns"}
        field = [totals.select(file, F.lit(p).alias("path"), F.lit(None).cast("bigint").alias("index"), F.col(c).cast("string").alias("value")) for p, c in held.items()]
        captures.write_captures(reduce(DataFrame.unionAll, sample + field), base)
        return base

    return t.once("capture_files", write)


def captured(t):
    return captures.read_capture_rows(t.spark, capture_files(t))


@query("s10_capture_rows", """
SELECT o_custkey AS run_id, path, count(*) AS samples, CAST(sum(o_orderkey) AS BIGINT) AS total, count(*) - 1 AS last_index
FROM orders, (VALUES ('ack_ns'), ('inner.backlog')) p(path) GROUP BY o_custkey, path""")
def _(t):
    """Samples of compressed captures, one row each."""
    rows = captured(t).where(F.col("index").isNotNull())
    return rows.groupBy(F.col("file").cast("bigint").alias("run_id"), "path").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("value").cast("bigint")).alias("total"), F.max("index").alias("last_index")
    )


@query("p11_strip_capture_rows", """
SELECT o_custkey AS run_id, CAST(0 AS BIGINT) AS samples, count(*) AS accepted, CAST(sum(o_orderkey) AS BIGINT) AS total_ns, count(*) AS stored FROM orders GROUP BY o_custkey""")
def _(t):
    def field(p):
        return F.max(F.when(F.col("path") == p, F.col("value").cast("bigint")))

    return captures.strip_sample_rows(captured(t)).groupBy(F.col("file").cast("bigint").alias("run_id")).agg(
        F.count("index").alias("samples"), field("accepted").alias("accepted"), field("total_ns").alias("total_ns"), field("inner.stored").alias("stored")
    )


# Outbox ledger.
@query("l1_orders", """
SELECT order_id, amount_cents, concat('ev-', CAST(order_id AS STRING)) AS event_id FROM v_order_requests WHERE attempt = 0""")
def _(t):
    return outbox.admit_orders(t.v_order_requests)[0]


@query("l1_outbox_rows", """
SELECT concat('ev-', CAST(order_id AS STRING)) AS event_id, order_id, concat('{"order_id":', CAST(order_id AS STRING), ',"amount_cents":', CAST(amount_cents AS STRING), '}') AS body,
  'pending' AS state, CAST(0 AS BIGINT) AS attempts FROM v_order_requests WHERE attempt = 0""")
def _(t):
    return outbox.admit_orders(t.v_order_requests)[1].select("event_id", "order_id", "body", "state", "attempts")


@query("l1_conflicts", """
SELECT b.order_id, b.amount_cents, a.amount_cents AS first_amount FROM v_order_requests b JOIN v_order_requests a ON a.order_id = b.order_id AND a.attempt = 0
WHERE b.amount_cents <> a.amount_cents""")
def _(t):
    return outbox.admit_orders(t.v_order_requests)[2].select("order_id", "amount_cents", "first_amount")


@query("w15_outbox_state", """
SELECT event_id, arg_max(state, seq) AS state, CASE WHEN arg_max(state, seq) = 'acknowledged' THEN NULL ELSE max(error) END AS last_error,
  count(*) FILTER (WHERE seq > 0) AS attempts FROM v_outbox_feed GROUP BY event_id""")
def _(t):
    return outbox.outbox_state(t.v_outbox_feed)


LEDGER = """ledger AS (SELECT event_id, arg_max(state, seq) AS state, CASE WHEN arg_max(state, seq) = 'acknowledged' THEN NULL ELSE max(error) END AS last_error,
  count(*) FILTER (WHERE seq > 0) AS attempts FROM v_outbox_feed GROUP BY event_id)"""


@query("l2_apply_dispatch", f"""WITH {LEDGER}, res AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'acknowledged' WHEN event_id % 4 = 1 THEN 'rejected' ELSE 'pending' END AS s,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'http_400' ELSE 'http_503' END AS e FROM ledger WHERE event_id % 3 = 0 OR event_id % 5 = 2)
SELECT l.event_id, CASE WHEN l.state = 'pending' AND r.s IS NOT NULL THEN r.s ELSE l.state END AS state,
  attempts + CASE WHEN l.state = 'pending' AND r.s IS NOT NULL THEN 1 ELSE 0 END AS attempts,
  CASE WHEN l.state = 'pending' AND r.s IS NOT NULL THEN r.e ELSE last_error END AS last_error FROM ledger l LEFT JOIN res r ON r.event_id = l.event_id""")
def _(t):
    ledger = outbox.outbox_state(t.v_outbox_feed).withColumn("acknowledged_at", F.lit(None).cast("timestamp"))
    eid = F.col("event_id")
    results = t.v_outbox_feed.where("seq = 0 AND (event_id % 3 = 0 OR event_id % 5 = 2)").select(
        "event_id", F.when(eid % 4 == 0, "acknowledged").when(eid % 4 == 1, "rejected").otherwise("pending").alias("state"),
        F.when(eid % 4 == 1, "http_400").when(eid % 4 > 1, "http_503").alias("error"), F.lit("2024-01-01").cast("timestamp").alias("at"),
    )
    return outbox.apply_dispatch(ledger, results).select("event_id", "state", "attempts", "last_error")


@query("l3_dispatch_summary", """
SELECT event_id % 50 AS batch, count(*) FILTER (WHERE seq > 0) AS attempted, count(*) FILTER (WHERE seq > 0 AND state = 'acknowledged') AS acknowledged,
  count(*) FILTER (WHERE seq > 0 AND state = 'rejected') AS rejected, count(*) FILTER (WHERE state = 'pending') AS pending, max(error) FILTER (WHERE seq > 0) AS error
FROM v_outbox_feed GROUP BY 1""")
def _(t):
    d = t.v_outbox_feed.withColumn("batch", F.col("event_id") % 50).withColumn("attempted", F.col("seq") > 0)
    return outbox.dispatch_summary(d, ["batch"])


@query("a27_outbox_status", f"WITH {LEDGER} SELECT s.state, count(l.event_id) AS n FROM (VALUES ('pending'), ('acknowledged'), ('rejected')) s(state) LEFT JOIN ledger l ON l.state = s.state GROUP BY s.state")
def _(t):
    return outbox.outbox_status(outbox.outbox_state(t.v_outbox_feed))


@query("k2_next_pending", f"WITH {LEDGER} SELECT event_id, state, attempts FROM ledger WHERE state = 'pending' ORDER BY event_id LIMIT 25")
def _(t):
    return outbox.next_pending(outbox.outbox_state(t.v_outbox_feed), 25, "event_id").select("event_id", "state", "attempts")


@query("k3_first_issues", f"WITH {LEDGER} SELECT event_id, attempts, last_error FROM ledger WHERE last_error IS NOT NULL ORDER BY event_id LIMIT 100")
def _(t):
    return outbox.first_issues(outbox.outbox_state(t.v_outbox_feed), "event_id").select("event_id", "attempts", "last_error")
