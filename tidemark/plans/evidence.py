"""The evidence audit over recorded runs built from the given tables, each with its own planted fault."""

from pyspark.sql import functions as F

from tidemark.operators import audit as au
from tidemark.operators import generate as gen
from tidemark.operators import reconcile, runs, timeline
from tidemark.operators.ordered import running
from tidemark.operators.ranks import nearest_rank
from tidemark.functions import ids
from tidemark.plans.catalog import query
from tidemark.plans.tables import VIEWS

WINDOW_NS = 10_000_000_000
TOTAL_NS = 12_600_000_000

# Audited requests: 60 runs of up to three events a request.
VIEWS["v_areq"] = """
SELECT o_custkey % 60 AS run_id, o_orderkey AS request_id, (o_orderkey * 7919000) % 12000000000 AS started_ns,
  (o_orderkey * 7919000) % 12000000000 + (o_orderkey * 104729) % 500000000 + 1 AS finished_ns,
  (o_orderkey * 104729) % 500000000 + 1 + CASE WHEN o_custkey % 60 = 5 THEN 1 ELSE 0 END AS elapsed_ns,
  1 + o_orderkey % 3 AS events, o_orderkey % 10 < 7 AS accepted, o_orderkey % 10 = 7 AS ambiguous
FROM orders"""


def event_lists(t):
    """Every attempted event with its place in the run, whether it was accepted, unclear or stored, and how many such came up to it (``a``, ``u``).

    Running totals are made over requests: within one, its events count on from them.
    """
    kinds = {"a": "accepted", "u": "ambiguous"}
    spans = timeline.request_positions(t.v_areq, sums={n: F.when(F.col(k), F.col("events")) for n, k in kinds.items()})
    one = spans.select("run_id", *kinds.values(), *kinds, "events", "request_id", F.explode(F.sequence(F.lit(0), F.col("events") - 1)).alias("k"), "first")
    return one.select(
        "run_id", (F.col("first") + F.col("k")).alias("position"), (F.col("request_id") * 4 + F.col("k")).alias("event_id"), *kinds.values(),
        *[(F.col(n) + F.when(F.col(k), F.col("k") + 1 - F.col("events")).otherwise(0)).alias(n) for n, k in kinds.items()],
    )


def case(t):
    return t.once("audit_case", lambda: build_case(t))


def build_case(t):
    """Recorded tables of the audit. Run n (n < 20) carries one planted fault; the rest are sound."""
    q = t.v_areq
    ev = t.saved("audit_events", lambda: event_lists(t))
    totals = t.saved("audit_totals", lambda: ev.groupBy("run_id").agg(F.count_if("accepted").alias("na")))  # a row a run: the join need not move events
    run = F.col("run_id")
    acc = ev.where("accepted").join(totals, "run_id").select(
        "run_id", F.lit("accepted").alias("set_name"), F.when(run == 6, F.col("na") - F.col("a")).otherwise(F.col("a") - 1).alias("position"), "event_id"
    )
    stored = ev.where("accepted OR (ambiguous AND event_id % 2 = 0)").select("run_id", F.lit("stored").alias("set_name"), "position", "event_id")
    stray = q.where("run_id = 3").groupBy("run_id").agg(F.lit("stored").alias("set_name"), F.lit(-1).cast("bigint").alias("position"), F.lit(-1).cast("bigint").alias("event_id"))
    sets = t.saved("audit_sets", lambda: (
        ev.select("run_id", F.lit("attempted").alias("set_name"), "position", "event_id").unionByName(acc)
        .unionByName(ev.where("ambiguous").select("run_id", F.lit("ambiguous").alias("set_name"), (F.col("u") - 1).alias("position"), "event_id"))
        .unionByName(stored).unionByName(stray)
    ))
    digests = reconcile.tree_digest(sets).select(
        "run_id", "set_name", "ids",
        F.when((run == 2) & (F.col("set_name") == "stored"), F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col("tree_sha256")).alias("tree_sha256"),
    )
    digests = t.saved("audit_digests", lambda d=digests: d)
    order = running(q.where("accepted"), ["run_id"], "request_id", sums={"n": F.lit(1)}, unique=True, keep=["elapsed_ns"])
    n_req = t.saved("audit_accepted", lambda: q.where("accepted").groupBy("run_id").agg(F.count(F.lit(1)).alias("nr")))
    acks = order.join(n_req, "run_id").select(
        "run_id", F.when(run == 9, F.col("nr") - F.col("n")).otherwise(F.col("n") - 1).alias("position"), F.col("elapsed_ns").alias("latency_ns")
    )
    acks = t.saved("audit_acks", lambda a=acks: a)
    visibility = stored.select("run_id", "position", (F.col("event_id") * 7919 % 1000003).alias("latency_ns"))
    ps = au.PERCENTILES
    struct = lambda bump: F.struct(*[(F.col(p) + (F.when(run == 11, 1).otherwise(0) if bump and p == "p95_ns" else 0)).alias(p) for p in ps])
    ack_p = nearest_rank(acks, "latency_ns", ["run_id"], ps).select("run_id", struct(True).alias("ack_latency"))
    vis_p = nearest_rank(visibility, "latency_ns", ["run_id"], ps).select("run_id", struct(False).alias("visibility_latency"))
    win = timeline.window_split(q.withColumn("status", F.when(F.col("accepted"), 202).when(~F.col("ambiguous"), 400)), WINDOW_NS)
    rec = reconcile.reconcile(sets).select("run_id", F.col("stored").alias("persisted"), "ambiguous_unobserved")
    base = win.join(rec, "run_id").join(ack_p, "run_id", "left").join(vis_p, "run_id", "left")
    failed = run.isin(16, 17)
    observed = F.col("persisted") - F.when(run == 3, 1).otherwise(0)
    zero = F.lit(0).cast("bigint")
    recorded = base.select(
        "run_id", run.alias("case_id"), F.lit(True).alias("correct"), F.when(run == 1, 1).otherwise(0).alias("missing"), zero.alias("unexpected"),
        zero.alias("duplicate_rows"), zero.alias("content_mismatch"), (F.col("attempted") + F.when(run == 4, 1).otherwise(0)).alias("planned"), "attempted",
        "accepted", "ambiguous", "rejected", "persisted", zero.alias("generator_missed"), zero.alias("late_schedules"), "attempted_in_window",
        (F.col("accepted_in_window") + F.when(run == 8, 1).otherwise(0)).alias("accepted_in_window"), "attempted_after_window", "accepted_after_window",
        F.lit(WINDOW_NS).alias("window_ns"), F.lit(TOTAL_NS).alias("total_ns"), F.lit(TOTAL_NS - WINDOW_NS).alias("drain_ns"),
        (F.col("accepted_in_window") * F.lit(1e9) / F.lit(WINDOW_NS) * F.when(run == 12, 1.001).otherwise(1.0)).alias("accepted_eps"),
        (F.col("persisted") * F.lit(1e9) / F.lit(TOTAL_NS)).alias("verified_eps"), "ambiguous_unobserved",
        F.when(failed, "failed").otherwise("complete").alias("observation_status"), F.lit("passed").alias("delivery_status"),
        observed.alias("observed_events"), (observed + F.when(run == 10, 1).otherwise(0)).alias("visibility_sample_count"),
        zero.alias("observer_late_polls"), zero.alias("observer_outages"), zero.alias("observer_slow_queries"), F.lit(False).alias("aborted"),
        "ack_latency", F.when(run != 16, F.col("visibility_latency")).alias("visibility_latency"),
        F.struct(
            F.lit(0).alias("active"), F.lit(0).alias("waiting"), F.lit(4).alias("max_conns"), F.lit(2).alias("max_idle"), F.when(run == 7, 5).otherwise(4).alias("peak_open"),
            F.lit(1).alias("open"), F.lit(3).alias("peak_active"), run.alias("acquire_ns"), F.lit("transport_owned_connected_tcp").alias("tracking"),
            F.create_map(F.lit("timeout"), F.lit(2).cast("bigint")).alias("errors"), F.create_map(F.lit("HTTP/1.1"), F.lit(1).cast("bigint")).alias("protocols"),
        ).alias("conn"),
    )
    status = runs.load_status(recorded).withColumn("load_status", F.when(run == 15, "met").otherwise(F.col("load_status")))
    status = t.saved("audit_runs", lambda r=status: r)
    cases = status.select(
        "case_id", F.col("attempted").alias("count"), F.lit(3).alias("batch_size"), F.lit(4).alias("max_conns"), F.lit(0).alias("max_idle")
    )
    sample = q.where("request_id % 11 = 2").select("run_id", F.col("request_id").alias("position"), (F.col("request_id") * 50).alias("at"))
    none = F.lit(0).cast("bigint")
    line = running(
        q.where("accepted").select("run_id", F.col("finished_ns").alias("tick"), F.col("events").alias("e")).unionByName(
            sample.select("run_id", F.col("at").alias("tick"), none.alias("e"))), ["run_id"], "tick", sums={"acc": F.col("e")}
    )
    backlog = sample.join(line.withColumnRenamed("tick", "at"), ["run_id", "at"]).select(
        "run_id", "position", F.col("at").alias("elapsed_ns"), F.when((run == 14) & (F.col("position") % 22 == 13), 0).when(run == 14, 1).otherwise(0).cast("bigint").alias("visible"),
        (F.col("acc") + F.when(run == 13, 1).otherwise(0)).alias("accepted"), F.lit(False).alias("final"),
    )
    backlog = t.saved("audit_backlog", lambda b=backlog: b)
    return {"runs": status, "cases": cases, "requests": q, "sets": sets, "digests": digests, "acks": acks, "visibility": visibility, "backlog": backlog}


FAILING = {"R1": (1, 2), "R2": (3,), "R3": (4,), "R4": (5, 6), "R5": (7,), "R6": (8, 9), "R7": (10, 17), "R8": (11,), "R9": (12,), "R10": (13, 14), "R11": (15,)}


def add_rule(rule: str, name: str, runs_failing) -> None:
    bad = ", ".join(str(r) for r in runs_failing)

    @query(name, f"SELECT run_id, '{rule}' AS rule, run_id NOT IN ({bad}) AS passed FROM (SELECT DISTINCT run_id FROM v_areq)")
    def _(t):
        return au.audit(case(t), [rule]).select("run_id", "rule", "passed")


for _rule, _runs in FAILING.items():
    add_rule(_rule, f"{_rule.lower()}_{au.RUN_RULES[_rule].__name__.split('_', 1)[1]}", _runs)


@query("r12_manifest_controls", """
SELECT c_custkey AS run_id, 'R12' AS rule, c_custkey % 40 > 5 AS passed FROM customer""")
def _(t):
    key, n = F.col("c_custkey"), F.col("c_custkey") % 40
    settings = F.create_map(
        *[x for k, v in au.REQUIRED_SETTINGS.items() for x in (F.lit(k), F.when((n == 1) & (k == "api_route"), "direct_http").otherwise(v))],
        F.lit("tls_version"), F.when(key % 2 == 0, "TLS 1.2").otherwise("TLS 1.3"),
    )
    database = F.create_map(*[x for k in au.DURABLE_DATABASE for x in (F.lit(k), F.when((n == 2) & (k == "fsync"), "off").otherwise("on"))],
                            F.lit("server_version"), F.lit(au.SERVER_VERSION))
    topic = lambda name, parts, caching, keep: F.concat(
        F.lit(f"NAME {name} PARTITIONS "), parts, F.lit(" REPLICAS 1\nwrite.caching "), caching, F.lit("\nretention.ms "), keep, F.lit("\n"))
    text = F.concat(
        topic("lake.events", F.when(n == 5, "2").otherwise("3"), F.when(n == 3, "true").otherwise("false"), F.lit(au.RETENTION_MS)),
        topic("lake.dlq", F.lit("1"), F.lit("false"), F.when(n == 4, "1").otherwise(au.RETENTION_MS)),
    )
    m = t.customer.select(
        key.alias("run_id"), F.col("c_name").alias("source_sha"), F.when(n == 0, "other").otherwise(F.col("c_name")).alias("identity_sha"),
        F.lit(False).alias("fsync_bypass"), settings.alias("settings"), database.alias("database"), text.alias("topic_text"),
    )
    return au.r12_manifest(m, (("lake.events", 3), ("lake.dlq", 1))).select("run_id", "rule", "passed")


@query("r12_unique_cases", "SELECT s_name AS case_name, count(*) AS copies FROM (SELECT s_name FROM supplier UNION ALL SELECT s_name FROM supplier WHERE s_suppkey % 9 = 4) GROUP BY s_name HAVING count(*) > 1")
def _(t):
    cases = t.supplier.select("s_name").unionByName(t.supplier.where("s_suppkey % 9 = 4").select("s_name"))
    return cases.groupBy(F.col("s_name").alias("case_name")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("r13_provenance", """
SELECT p_partkey AS run_id, 'R13' AS rule, p_partkey % 30 > 3 AND (p_partkey % 30 <> 4 OR p_partkey % 2 = 1) AS passed FROM part""")
def _(t):
    from tidemark.operators.diffs import small_fingerprint

    key, n = F.col("p_partkey"), F.col("p_partkey") % 30
    controls = small_fingerprint(t.part.withColumn("run_id", key), ["run_id"], ["p_size", "p_brand"]).withColumnRenamed("fingerprint", "computed_controls_fingerprint")
    rows = t.part.withColumn("run_id", key).join(controls, "run_id").select(
        "run_id", "computed_controls_fingerprint",
        F.when(n == 0, F.sha2("p_name", 256)).otherwise(F.col("computed_controls_fingerprint")).alias("controls_fingerprint"),
        F.when(n == 1, F.upper(F.sha2("p_name", 256))).otherwise(F.sha2("p_name", 256)).alias("source_fingerprint"),
        F.when(n == 2, "short").otherwise(F.sha1("p_name")).alias("source_sha"),
        F.when(key % 2 == 0, "full").otherwise("smoke").alias("mode"), ((n == 4) | ((n == 3) & F.lit(True))).alias("source_dirty"),
    )
    rows = rows.withColumn("mode", F.when(n_of(rows) == 3, "connections").otherwise(F.col("mode")))
    return au.r13_provenance(rows).select("run_id", "rule", "passed")


def n_of(df):
    return df["run_id"] % 30


@query("r14_calibration", """
SELECT run_id, 'R14' AS rule, run_id NOT IN (1, 2, 3, 4) AS passed FROM (SELECT DISTINCT run_id FROM v_areq)""")
def _(t):
    run = F.col("run_id")
    q = t.v_areq.withColumn("elapsed_ns", F.col("finished_ns") - F.col("started_ns")).withColumn("accepted", F.lit(True))
    q = q.withColumn("status", F.when((run == 1) & (F.col("request_id") % 2 == 0), 503).otherwise(202))
    g = q.groupBy("run_id").agg(
        F.sum("events").alias("attempted"), F.coalesce(F.sum(F.when(F.col("finished_ns") <= WINDOW_NS, F.col("events"))), F.lit(0)).alias("inside")
    )
    rate = F.ceil(F.col("attempted") / 10) + 5
    rec = g.select(
        "run_id", F.lit(True).alias("correct"), rate.alias("rate"), F.lit(WINDOW_NS).alias("window_ns"), F.lit(TOTAL_NS).alias("total_ns"), (rate * 10).alias("planned"),
        "attempted", F.col("attempted").alias("accepted_events"), (F.col("inside") + F.when(run == 2, 1).otherwise(0)).alias("accepted_in_window"),
        (rate * 10 - F.col("attempted")).alias("generator_missed"),
        (F.col("inside") * F.lit(1e9) / F.lit(WINDOW_NS) + F.when(run == 3, 50).otherwise(0)).alias("accepted_eps"),
    )
    names = F.array(*[F.lit(s) for s in au.CALIBRATION_SETS])
    digests = g.select("run_id", F.explode(names).alias("set_name")).select(
        "run_id", "set_name", F.sha2(F.when((run == 4) & (F.col("set_name") == "accepted"), "x").otherwise(run.cast("string")), 256).alias("sha256")
    )
    return au.r14_calibration(rec, q, digests).select("run_id", "rule", "passed")


@query("r12_registry_cardinality", """
SELECT c_custkey AS run_id, 'R12' AS rule, CASE c_custkey % 12 WHEN 1 THEN 'cardinality' WHEN 2 THEN 'unique' WHEN 3 THEN 'mode' WHEN 4 THEN 'mode,cardinality' WHEN 5 THEN 'cardinality' ELSE '' END AS detail FROM customer""")
def _(t):
    """Studies with a case too few, one ID twice, a smoke study, an unknown mode and none at all."""
    key, n = F.col("c_custkey"), F.col("c_custkey") % 12
    mode = F.when(n == 3, "smoke").when(n == 4, "other").when(key % 2 == 0, "full").otherwise("connections")
    studies = t.customer.select(key.alias("run_id"), mode.alias("mode"), n.alias("n"))
    want = F.when(F.col("mode") == "full", 25).when(F.col("mode") == "connections", 12).otherwise(2) - F.when(F.col("n") == 1, 1).otherwise(0)
    cases = studies.where("n <> 5").select(F.col("run_id").alias("study_id"), "n", F.explode(F.sequence(F.lit(1), want)).alias("case_id"))
    cases = cases.withColumn("case_id", F.when((F.col("n") == 2) & (F.col("case_id") == 2), 1).otherwise(F.col("case_id")))
    return au.r12_registry(studies.drop("n"), cases.drop("n")).select("run_id", "rule", "detail")


@query("r14_transport", """
SELECT c_custkey AS run_id, 'R14' AS rule, CASE c_custkey % 15 WHEN 1 THEN 'idle' WHEN 2 THEN 'idle' WHEN 3 THEN 'errors' WHEN 4 THEN 'protocols' WHEN 5 THEN 'protocols'
  WHEN 6 THEN 'connections' WHEN 7 THEN 'connections' ELSE '' END AS detail FROM customer""")
def _(t):
    key, n = F.col("c_custkey"), F.col("c_custkey") % 15
    count = (key % 50 + 1).cast("long")
    runs_ = t.customer.select(
        key.alias("run_id"), count.alias("requests"), F.when(n == 1, 1).otherwise(0).alias("active_requests"), F.when(n == 2, 1).otherwise(0).alias("waiting"),
        F.when(n == 3, F.array(F.lit("reset"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(n == 4, F.create_map(F.lit("HTTP/2.0"), count)).when(n == 5, F.create_map(F.lit("HTTP/1.1"), count - 1)).otherwise(F.create_map(F.lit("HTTP/1.1"), count)).alias("protocols"),
        F.when(n == 6, 0).when(n == 7, 129).otherwise(key % 128 + 1).alias("peak_open"),
    )
    return au.r14_transport(runs_).select("run_id", "rule", "detail")


@query("r14_reports", """
SELECT p_partkey AS run_id, 'R14' AS rule, CASE p_partkey % 15 WHEN 1 THEN 'identity' WHEN 2 THEN 'identity' WHEN 3 THEN 'controls' WHEN 4 THEN 'controls' WHEN 5 THEN 'status'
  WHEN 6 THEN 'repetitions' WHEN 7 THEN 'identity' ELSE '' END AS detail FROM part""")
def _(t):
    key, n = F.col("p_partkey"), F.col("p_partkey") % 15
    controls = {**au.CALIBRATION_CONTROLS, "max_open": 128, "max_idle": 128}
    reports_ = t.part.select(
        key.alias("run_id"), F.when(n == 7, 1).otherwise(2).alias("schema"), F.lit(au.CALIBRATION_KIND).alias("kind"), F.col("p_name").alias("source_sha"),
        F.when(n == 1, "other").otherwise(F.col("p_name")).alias("identity_sha"), (n != 2).alias("https"), F.when(n == 5, "failed").when(key % 2 == 0, "complete").alias("status"),
        *[(F.lit(v) + F.when(((n == 3) & F.lit(k == "payload_bytes")) | ((n == 4) & F.lit(k == "max_idle")), 1).otherwise(0)).alias(k) for k, v in controls.items()],
    )
    runs_ = t.part.select(key.alias("report_id"), F.explode(F.sequence(F.lit(1), F.when(n == 6, 2).otherwise(3))).alias("repetition"))
    return au.r14_reports(reports_, runs_).select("run_id", "rule", "detail")


@query("r14_cohort", """
SELECT s_suppkey AS run_id, 'R14' AS rule, CASE s_suppkey % 9 WHEN 1 THEN 'cohort' WHEN 2 THEN 'cohort' WHEN 3 THEN 'source' WHEN 4 THEN 'cohort,source' ELSE '' END AS detail FROM supplier""")
def _(t):
    """A missing rate, a rate twice, a report of another source, and no report."""
    key, n = F.col("s_suppkey"), F.col("s_suppkey") % 9
    studies = t.supplier.select(key.alias("run_id"), F.col("s_name").alias("identity_sha"))
    rates = F.explode(F.array(*[F.lit(r) for r in au.CALIBRATION_RATES]))
    reports_ = t.supplier.where(n != 4).select(key.alias("study_id"), n.alias("n"), F.col("s_name").alias("source_sha"), rates.alias("rate")).where("NOT (n = 1 AND rate = 30000)")
    reports_ = reports_.withColumn("rate", F.when((F.col("n") == 2) & (F.col("rate") == 50_000), 30_000).otherwise(F.col("rate")))
    reports_ = reports_.withColumn("source_sha", F.when((F.col("n") == 3) & (F.col("rate") == 15_000), "other").otherwise(F.col("source_sha")))
    return au.r14_cohort(studies, reports_.drop("n")).select("run_id", "rule", "detail")


STUDY_SQL = """
WITH f AS (SELECT CASE s_suppkey % 20 WHEN 1 THEN 'missing' WHEN 2 THEN 'size' WHEN 3 THEN 'hash' WHEN 4 THEN 'gzip_time' WHEN 5 THEN 'raw_size' WHEN 6 THEN 'raw_size' END AS fault, concat('gz/', s_suppkey, '.gz') AS path FROM supplier),
r AS (SELECT CAST(c_custkey AS STRING) AS subject, 'R12' AS rule, c_custkey % 7 <> 1 AS passed, CASE WHEN c_custkey % 7 = 1 THEN 'cardinality' ELSE '' END AS detail FROM customer
UNION ALL SELECT path, 'R18', false, fault FROM f WHERE fault IS NOT NULL
UNION ALL SELECT 'study', 'R18', count(fault) = 0, CAST(count(fault) AS STRING) FROM f
UNION ALL SELECT CAST(o_custkey AS STRING), 'R20', false, 'content' FROM orders WHERE o_custkey % 13 = 5 GROUP BY o_custkey
UNION ALL SELECT 'study', 'R20', count(DISTINCT o_custkey) = 0, CAST(count(DISTINCT o_custkey) AS STRING) FROM orders WHERE o_custkey % 13 = 5)
SELECT subject, rule, passed, detail FROM r"""


@query("r_study_audit", STUDY_SQL)
def _(t):
    """Rules over registry, artifact files and captures in one audit."""
    from tidemark.plans.reports import captured
    from tidemark.plans.streams import artifacts
    from tidemark.sources.captures import strip_sample_rows
    from tidemark.sources.files import file_inventory

    key = F.col("c_custkey")
    base, listed = artifacts(t)
    fields = t.saved("capture_rows", lambda: captured(t)).select(F.col("file").cast("bigint").alias("run_id"), "path", "index", "value")
    changed = (F.col("run_id") % 13 == 5) & (F.col("path") == "total_ns")
    cases = t.customer.select(key.alias("study_id"), F.explode(F.sequence(F.lit(1), F.when(key % 7 == 1, 11).otherwise(12))).alias("case_id"))
    return au.audit_study({
        "studies": t.customer.select(key.alias("run_id"), F.lit("connections").alias("mode")), "registry": cases,
        "artifact_refs": listed.dropDuplicates(["path"]).drop("fault"), "artifact_files": file_inventory(t.spark, base, raw_sizes=True),
        "report_rows": fields, "summary_rows": strip_sample_rows(fields).withColumn("value", F.when(changed, F.lit("0")).otherwise(F.col("value"))),
    })


@query("r15_database_grid", """
SELECT CAST(floor(c_custkey / 9.0) AS BIGINT) AS run_id, 'R15' AS rule, run_id % 20 > 3 AND count(*) = 9 AS passed FROM customer GROUP BY 1""")
def _(t):
    key = F.col("c_custkey")
    case_id = F.floor(key / 9)
    n = case_id % 20
    cell = key % 9
    method = F.get(F.array(*[F.lit(m) for m in runs.METHODS]), (cell % 3).cast("int"))
    size = F.when(cell % 3 == 0, 1).otherwise(100)
    rec = t.customer.select(
        case_id.alias("case_id"), method.alias("method"), F.when((n == 0) & (cell == 8), 1).otherwise(F.floor(cell / 3) + 1).alias("repetition"),
        F.lit(5000).alias("submitted"), F.when((n == 1) & (cell == 4), 4499).otherwise(4500).alias("inserted"), F.lit(500).alias("duplicates"),
        (key * 1000 + 100000).alias("elapsed_ns"), F.ceil(F.lit(5000) / size).alias("batch_count"),
        (key * 1000 + F.when((n == 2) & (cell == 5), 100001).otherwise(100000)).alias("batch_sum_ns"),
        ((n != 3) | (cell != 7)).alias("correct"),
    )
    cases = rec.select("case_id").distinct().select("case_id", F.lit(5000).alias("count"), F.lit(0.1).alias("duplicate_fraction"), F.lit(100).alias("batch_size"))
    return au.r15_database(rec, cases).select("run_id", "rule", "passed")


@query("r16_outbox_recovery", """
WITH g AS (SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS run_id, count(*) AS n FROM orders GROUP BY 1)
SELECT run_id, 'R16' AS rule, n = 100 AND run_id % 12 > 3 AS passed FROM g""")
def _(t):
    key = F.col("o_orderkey")
    run = F.floor(key / 100)
    ids_ = t.orders.select(run.alias("run_id"), key.alias("event_id"))
    n = F.col("run_id") % 12
    sets = (
        ids_.withColumn("set_name", F.lit("accepted")).unionByName(ids_.withColumn("set_name", F.lit("ambiguous")))
        .unionByName(ids_.withColumn("event_id", F.when((n == 0) & (F.col("event_id") % 100 == 7), -1).otherwise(F.col("event_id"))).withColumn("set_name", F.lit("stored")))
    )
    rec = ids_.select("run_id").distinct().select(
        "run_id", F.lit(True).alias("correct"), F.when(n == 1, 3).otherwise(4).alias("fault_count"),
        F.when(n == 2, 4_999_999_999).otherwise(5_000_000_000).alias("first_attempt_ns"), F.when(n == 3, "http_400").otherwise("http_503").alias("first_attempt_status"),
    )
    return au.r16_recovery(rec, sets).select("run_id", "rule", "passed")


@query("r17_secret_scan", """
SELECT doc_id, 'token = "' AS marker FROM documents WHERE contains(text, 'token = "') UNION ALL
SELECT doc_id, 'postgres://' FROM documents WHERE contains(text, 'postgres://')""")
def _(t):
    return au.r17_secrets(t.documents, "doc_id", "text", (*au.SECRET_MARKERS, 'token = "'))


@query("r19_revision_mask", """
SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN 'unavailable' WHEN event_id % 3 <> 0 THEN 'available' END AS status,
  CASE WHEN event_type <> 'click' AND event_id % 3 <> 0 THEN user_id END AS sessions, value AS other FROM events""")
def _(t):
    s = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("sessions"), F.col("value").alias("other"))
    masked = au.r19_mask(s, "sessions", "event_type", ["click"], "row_stream_errors_unchecked")
    return masked.select("event_id", F.col("sessions_status.status").alias("status"), "sessions", "other")


@query("r20_summaries", """
SELECT o_custkey AS run_id, 'content' AS difference FROM orders WHERE o_custkey % 13 = 5 GROUP BY o_custkey""")
def _(t):
    from tidemark.plans.reports import reports

    r = reports(t)
    s = runs.strip_samples(r, ["inner"]).withColumn("total_ns", F.when(F.col("run_id") % 13 == 5, F.col("total_ns") + 1).otherwise(F.col("total_ns")))
    return au.r20_summaries(r, s, ["run_id"], ["inner"])


@query("r20_capture_summaries", """
SELECT o_custkey AS run_id, 'content' AS difference FROM orders WHERE o_custkey % 13 = 5 GROUP BY o_custkey""")
def _(t):
    """Reports and their summaries as rows of fields: a report is never one value."""
    from tidemark.plans.reports import captured
    from tidemark.sources.captures import strip_sample_rows

    fields = t.saved("capture_rows", lambda: captured(t)).select(F.col("file").cast("bigint").alias("run_id"), "path", "index", "value")
    changed = (F.col("run_id") % 13 == 5) & (F.col("path") == "total_ns")
    summary = strip_sample_rows(fields).withColumn("value", F.when(changed, (F.col("value").cast("bigint") + 1).cast("string")).otherwise(F.col("value")))
    return au.r20_rows(fields, summary, ["run_id"])


@query("r21_repetition_sets", """
SELECT case_id, count(*) = 3 AND count(DISTINCT repetition) = 3 AND min(repetition) = 1 AND max(repetition) = 3 AND bool_and(c_custkey % 53 <> 8) AS complete
FROM (SELECT c_custkey, CAST(floor(c_custkey / 3.0) AS BIGINT) AS case_id, CASE WHEN c_custkey % 30 = 7 THEN 1 ELSE 1 + c_custkey % 3 END AS repetition FROM customer WHERE c_custkey % 41 <> 3) GROUP BY case_id""")
def _(t):
    key = F.col("c_custkey")
    r = t.customer.where(key % 41 != 3).select(F.floor(key / 3).alias("case_id"), F.when(key % 30 == 7, 1).otherwise(1 + key % 3).alias("repetition"), (key % 53 != 8).alias("correct"))
    return runs.repetition_sets(r, 3)


# Generated identities.


@query("g1_identities", """
WITH h AS (SELECT event_id AS position, sha1(unhex('6BA7B8129DAD11D180B400C04FD430C8') || encode(concat('n/42/', CAST(event_id AS STRING)))) AS d FROM events)
SELECT position, concat(d[1:8], '-', d[9:12], '-5', d[14:16], '-', substr('89ab89ab89ab89ab', CAST(instr('0123456789abcdef', d[17:17]) AS INTEGER), 1), d[18:20], '-', d[21:32]) AS event_id FROM h""")
def _(t):
    name = gen.identity_name("n", F.lit(42), F.col("event_id"))
    return t.events.select(F.col("event_id").alias("position"), ids.uuid5(name).alias("event_id"))


@query("g2_fixed_payloads", """
SELECT event_id AS position, concat('{"data":"', rpad(lower(hex(xor(event_id, 77))), 245, 'x'), '"}') AS payload,
  TIMESTAMP '2026-01-01 00:00:00' + to_microseconds(event_id) AS occurred_at, concat('bench_', left(sha256('n'), 16)) AS event_type FROM events""")
def _(t):
    spec = gen.DatasetSpec(count=1, payload_bytes=256, seed=77, namespace="n")
    c = gen.event_content(F.col("position"), spec)
    rows = t.events.select(F.col("event_id").alias("position"))
    return rows.select("position", c["payload"].alias("payload"), c["occurred_at"].cast("timestamp_ntz").alias("occurred_at"), c["event_type"].alias("event_type"))


LETTERS = ids.ALPHABET
DIGESTS = ", ".join(f"sha256(concat('n/42/', CAST(event_id AS STRING), '/{o}'))" for o in range(0, 245, 32))


@query("g2_varied_payloads", f"""
WITH d AS (SELECT event_id AS position, concat({DIGESTS}) AS d FROM events)
SELECT position, concat('{{"data":"', array_to_string(list_transform(range(0, 245), lambda i: substr('{LETTERS}', CAST(
  (instr('0123456789abcdef', substr(d, 2 * i + 1, 1)) - 1) % 4 * 16 + instr('0123456789abcdef', substr(d, 2 * i + 2, 1)) AS BIGINT), 1)), ''), '"}}') AS payload FROM d""")
def _(t):
    spec = gen.DatasetSpec(count=1, payload_bytes=256, seed=42, namespace="n", payload_profile="varied")
    rows = t.events.select(F.col("event_id").alias("position"))
    return rows.select("position", gen.event_content(F.col("position"), spec)["payload"].alias("payload"))


@query("g3_duplicates", """
WITH n AS (SELECT count(*) - CAST(floor(count(*) * 0.25) AS BIGINT) AS u FROM orders)
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey < u THEN o_orderkey ELSE (o_orderkey - u) % u END AS source_id FROM orders, n""")
def _(t):
    unique = t.orders.groupBy().agg((F.count(F.lit(1)) - F.floor(F.count(F.lit(1)) * 0.25)).alias("u"))
    source = gen.duplicate_source(F.col("o_orderkey"), F.col("u"))
    orders = t.orders.withColumn("u", unique.scalar())
    return orders.select(F.col("o_orderkey").alias("row_id"), source.alias("source_id"))


@query("j12_decode_population", """
WITH u AS (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT run_id, 'accepted' AS set_name, idx AS position, event_id, true AS valid FROM u
UNION ALL SELECT run_id, 'accepted', n, CAST(NULL AS BIGINT), false FROM u WHERE idx = 0
UNION ALL SELECT run_id, 'accepted', n + 1, -run_id, true FROM u WHERE idx = 0""")
def _(t):
    numbered = running(t.events.select(F.col("user_id").alias("run_id"), "event_id"), ["run_id"], "event_id", sums={"n": F.lit(1)}, unique=True)
    universe = numbered.select("run_id", (F.col("n") - 1).alias("index"), "event_id")
    pop = numbered.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select(
        "run_id", F.lit("accepted").alias("set_name"), F.sequence(F.lit(0).cast("bigint"), F.col("n")).alias("indices"), F.array(-F.col("run_id")).alias("extra")
    )
    return gen.decode_population(pop, universe)


@query("j12_decode_rows", """
WITH u AS (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT run_id, 'accepted' AS set_name, idx AS position, event_id, true AS valid FROM u
UNION ALL SELECT run_id, 'accepted', n, CAST(NULL AS BIGINT), false FROM u WHERE idx = 0
UNION ALL SELECT run_id, 'accepted', n + 1, -run_id, true FROM u WHERE idx = 0""")
def _(t):
    """The same sets, one row for each index: a run of any length is never one value."""
    numbered = running(t.events.select(F.col("user_id").alias("run_id"), "event_id"), ["run_id"], "event_id", sums={"n": F.lit(1)}, unique=True)
    universe = numbered.select("run_id", (F.col("n") - 1).alias("index"), "event_id")
    mark = F.lit("accepted").alias("set_name")
    beyond = numbered.groupBy("run_id").agg(F.max("n").alias("index"))
    listed = universe.select("run_id", mark, F.col("index").alias("position"), "index").unionAll(beyond.select("run_id", mark, F.col("index").alias("position"), "index"))
    return gen.decode_rows(listed, beyond.select("run_id", mark, F.lit(0).alias("position"), (-F.col("run_id")).alias("event_id")), universe)
