"""Evidence audit: every recorded figure is derived again and compared.

``audit`` returns one row per run and rule: (run_id, rule, passed, detail). The
tables it reads are the recorded ones:

runs        one row per run, every recorded counter, rate and status
cases       planned count and limits per case
requests    (run_id, request_id, started_ns, finished_ns, elapsed_ns, events, accepted, ambiguous)
sets        ordered ID lists (run_id, set_name, position, event_id)
digests     recorded set digests (run_id, set_name, sha256)
acks        recorded latencies (run_id, position, latency_ns); visibility likewise
backlog     (run_id, position, elapsed_ns, visible, accepted, final)
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import reconcile, timeline
from tidemark.operators.ordered import join_nullsafe, running
from tidemark.operators.ranks import nearest_rank
from tidemark.operators.runs import LOAD_COUNTERS, METHODS, MIN_FAULTS, repetition_sets

REL_TOLERANCE = 1e-12
OBSERVATION_STATES = ("complete", "partial", "failed", "not_run")
PERCENTILES = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99}
Tables = Mapping[str, DataFrame]


def close(a: Column, b: Column) -> Column:
    """Equal within a relative tolerance."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(REL_TOLERANCE)


def verdict(df: DataFrame, rule: str, checks: Mapping[str, Column]) -> DataFrame:
    """One row per run: passed when every check holds, else the names of those that do not. NULL does not hold."""
    broken = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])
    text = F.array_join(F.filter(broken, lambda x: x.isNotNull()), ",")
    return df.select("run_id", F.lit(rule).alias("rule"), (text == "").alias("passed"), text.alias("detail"))


def per_run(runs: DataFrame, *parts: DataFrame) -> DataFrame:
    for p in parts:
        runs = runs.join(p, "run_id", "left")
    return runs


def sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("run_id").agg(*[F.count_if(F.col("set_name") == s).alias(f"n_{s}") for s in reconcile.SETS])


def r1_correctness(t: Tables) -> DataFrame:
    """Verdict and recorded digests. Digests with ``ids`` and ``tree_sha256`` are compared in parallel; flat ones need one pass over each set."""
    tree = "tree_sha256" in t["digests"].columns
    if tree:
        digests = reconcile.tree_digest(t["sets"]).select("run_id", "set_name", F.concat_ws(":", "ids", "tree_sha256").alias("computed"))
        recorded = t["digests"].select("run_id", "set_name", F.concat_ws(":", "ids", "tree_sha256").alias("recorded"))
        empty = F.concat_ws(":", F.lit("0"), F.sha2(F.lit(""), 256))
    else:
        digests = reconcile.set_digest(t["sets"]).select("run_id", "set_name", F.col("sha256").alias("computed"))
        recorded = t["digests"].select("run_id", "set_name", F.col("sha256").alias("recorded"))
        empty = F.sha2(F.lit(""), 256)
    names = recorded.join(digests, ["run_id", "set_name"], "full")
    same = names.groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("recorded") == F.coalesce("computed", empty), F.lit(False))).alias("same"))
    zero = F.col("missing") + F.col("unexpected") + F.col("duplicate_rows") + F.col("content_mismatch") == 0
    return verdict(per_run(t["runs"], same), "R1", {"correct": F.col("correct") & zero, "digests": F.col("same")})


def r2_sets(t: Tables) -> DataFrame:
    rules = reconcile.set_rules(t["sets"])
    g = rules.groupBy("run_id").agg(
        F.bool_and("passed").alias("all"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("rule")))), ",").alias("d")
    )
    j = per_run(t["runs"].select("run_id"), g)
    return j.select("run_id", F.lit("R2").alias("rule"), F.coalesce("all", F.lit(True)).alias("passed"), F.coalesce("d", F.lit("")).alias("detail"))


def r3_counts(t: Tables) -> DataFrame:
    j = per_run(t["runs"].join(t["cases"], "case_id"), sizes(t["sets"]))
    n = lambda s: F.coalesce(F.col(f"n_{s}"), F.lit(0))
    return verdict(j, "R3", {
        "planned": (F.col("planned") == F.col("count")) & (F.col("planned") == F.col("attempted") + F.col("generator_missed")),
        "classified": (F.col("attempted") == n("attempted")) & (F.col("attempted") == F.col("accepted") + F.col("ambiguous") + F.col("rejected")),
        "sets": (F.col("accepted") == n("accepted")) & (F.col("persisted") == n("stored")),
    })


def r4_requests(t: Tables) -> DataFrame:
    q = t["requests"]
    shape = (
        q.join(t["runs"].join(t["cases"], "case_id").select("run_id", "batch_size"), "run_id")
        .groupBy("run_id").agg(
            F.bool_and(F.col("events").between(1, F.col("batch_size"))).alias("size"),
            F.bool_and((F.col("finished_ns") >= F.col("started_ns")) & (F.col("started_ns") >= 0)).alias("interval"),
            F.bool_and(F.col("elapsed_ns") == F.col("finished_ns") - F.col("started_ns")).alias("elapsed"),
            F.sum("events").alias("listed"),
        )
    )
    attempted = t["sets"].where("set_name = 'attempted'").select("run_id", "position", "event_id")
    spans = timeline.request_positions(q)
    listed = spans.where("events > 0").select(
        "run_id", "accepted", "ambiguous", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("events") - 1)).alias("position")
    )
    sent = join_nullsafe(listed, attempted, ["run_id", "position"], "inner")
    kinds = {"accepted": F.col("accepted"), "ambiguous": F.col("ambiguous")}
    ranked = running(sent, ["run_id"], "position", sums={f"upto_{k}": c.cast("bigint") for k, c in kinds.items()}, unique=True, keep=["event_id", *kinds])
    expected = reduce(DataFrame.unionByName, [
        ranked.where(c).select("run_id", F.lit(k).alias("set_name"), (F.col(f"upto_{k}") - 1).alias("position"), F.col("event_id").alias("sent_id"))
        for k, c in kinds.items()
    ])
    recorded = t["sets"].where(F.col("set_name").isin(*kinds))
    same = recorded.join(expected, ["run_id", "set_name", "position"], "full").groupBy("run_id").agg(
        F.bool_and(F.coalesce(F.col("event_id") == F.col("sent_id"), F.lit(False))).alias("ids")
    )
    j = per_run(t["runs"], shape, same, sizes(t["sets"]))
    return verdict(j, "R4", {
        "size": F.col("size"), "interval": F.col("interval"), "elapsed": F.col("elapsed"),
        "positions": (F.col("listed") == F.col("n_attempted")) & F.coalesce("ids", F.lit(True)),
    })


def r5_connections(t: Tables) -> DataFrame:
    counts = t["requests"].groupBy("run_id").agg(F.count(F.lit(1)).alias("n_requests"))
    j = per_run(t["runs"].join(t["cases"], "case_id"), counts)
    c = F.col("conn")
    idle = F.when(F.col("max_idle") == 0, 2).otherwise(F.col("max_idle"))
    used = F.aggregate(F.map_values(c["protocols"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    allowed = lambda m, names: F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(n) for n in names]))) == 0
    return verdict(j, "R5", {
        "idle": (c["active"] == 0) & (c["waiting"] == 0),
        "limits": (c["max_conns"] == F.col("max_conns")) & (c["max_idle"] == idle),
        "sockets": (c["peak_open"] >= c["open"]) & (c["open"] >= 0) & (c["peak_active"] >= 0) & (c["acquire_ns"] >= 0),
        "cap": (c["max_conns"] == 0) | (c["peak_open"] <= c["max_conns"]),
        "tracking": c["tracking"] == "transport_owned_connected_tcp",
        "errors": allowed(c["errors"], labels.CONNECTION_ERRORS),
        "protocols": allowed(c["protocols"], labels.PROTOCOLS + ("other",)) & (used <= F.col("n_requests")),
    })


def r6_window(t: Tables) -> DataFrame:
    q = t["requests"].join(t["runs"].select("run_id", "window_ns"), "run_id")
    ev = F.col("events")
    g = q.groupBy("run_id").agg(
        F.coalesce(F.sum(F.when(F.col("started_ns") <= F.col("window_ns"), ev)), F.lit(0)).alias("starts"),
        F.coalesce(F.sum(F.when(F.col("accepted") & (F.col("finished_ns") <= F.col("window_ns")), ev)), F.lit(0)).alias("inside"),
    )
    acked = running(t["requests"].where("accepted"), ["run_id"], "request_id", sums={"n": F.lit(1)}, unique=True, keep=["elapsed_ns"])
    mine = acked.select("run_id", (F.col("n") - 1).alias("position"), "elapsed_ns")
    same = t["acks"].join(mine, ["run_id", "position"], "full").groupBy("run_id").agg(
        F.bool_and(F.coalesce(F.col("latency_ns") == F.col("elapsed_ns"), F.lit(False))).alias("same")
    )
    j = per_run(t["runs"], g, same, sizes(t["sets"]))
    return verdict(j, "R6", {
        "window": (F.col("inside") == F.col("accepted_in_window")) & (F.col("starts") == F.col("attempted_in_window")),
        "tail": (F.col("accepted_after_window") == F.col("n_accepted") - F.col("inside"))
        & (F.col("attempted_after_window") == F.col("n_attempted") - F.col("starts")),
        "acks": F.coalesce("same", F.lit(True)),
    })


def r7_visibility(t: Tables) -> DataFrame:
    n = t["visibility"].groupBy("run_id").agg(F.count(F.lit(1)).alias("samples"))
    j = per_run(t["runs"], n).withColumn("samples", F.coalesce("samples", F.lit(0)))
    complete = F.col("observation_status") == "complete"
    checks = {
        "count": (F.col("visibility_sample_count") == F.col("samples")) & (F.col("samples") <= F.col("observed_events")),
        "status": F.col("observation_status").isin(*OBSERVATION_STATES),
        "population": ~complete | (F.col("samples") == F.col("observed_events")),
        "unavailable": (complete & (F.col("samples") > 0)) | F.col("visibility_latency").isNull(),
        "delivery": F.col("delivery_status") == "passed",
    }
    if "persisted_eps" in t["runs"].columns:
        checks["legacy_rate"] = F.col("persisted_eps").isNull()
    return verdict(j, "R7", checks)


def r8_percentiles(t: Tables) -> DataFrame:
    def again(name: str) -> DataFrame:
        p = nearest_rank(t[name], "latency_ns", ["run_id"], PERCENTILES)
        bad = t[name].groupBy("run_id").agg(F.bool_and(F.col("latency_ns") >= 0).alias("ok"))
        return p.join(bad, "run_id").select("run_id", F.struct(*PERCENTILES).alias(f"{name}_again"), F.col("ok").alias(f"{name}_ok"))

    j = per_run(t["runs"], again("acks"), again("visibility"))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(p) for p in PERCENTILES])
    skip = (F.col("observation_status") != "complete") | F.col("visibility_again").isNull()
    return verdict(j, "R8", {
        "samples": F.coalesce("acks_ok", F.lit(True)) & F.coalesce("visibility_ok", F.lit(True)),
        "acks": F.coalesce("acks_again", zero) == F.col("ack_latency"),
        "visibility": skip | (F.col("visibility_again") == F.col("visibility_latency")),
    })


def r9_rates(t: Tables) -> DataFrame:
    inside = t["requests"].join(t["runs"].select("run_id", "window_ns"), "run_id").groupBy("run_id").agg(
        F.coalesce(F.sum(F.when(F.col("accepted") & (F.col("finished_ns") <= F.col("window_ns")), F.col("events"))), F.lit(0)).alias("inside")
    )
    flags = reconcile.id_flags(t["sets"]).groupBy("run_id").agg(
        F.sum("stored_rows").alias("n_stored"), F.count_if(F.col("ambiguous") & ~F.col("stored")).alias("unknown")
    )
    j = per_run(t["runs"], inside, flags)
    return verdict(j, "R9", {
        "duration": (F.col("total_ns") >= F.col("window_ns")) & (F.col("drain_ns") == F.col("total_ns") - F.col("window_ns")),
        "accepted_rate": close(F.col("accepted_eps"), F.col("inside") * F.lit(1e9) / F.col("window_ns")),
        "stored_rate": close(F.col("verified_eps"), F.col("n_stored") * F.lit(1e9) / F.col("total_ns")),
        "unknown": F.col("unknown") == F.col("ambiguous_unobserved"),
    })


def r10_backlog(t: Tables) -> DataFrame:
    points = t["backlog"]
    ordered = timeline.monotonic(points)
    none = F.lit(0).cast("bigint")
    acks = t["requests"].where("accepted").select("run_id", F.col("finished_ns").alias("at"), F.col("events").alias("e"))
    marks = points.select("run_id", F.col("elapsed_ns").alias("at"), none.alias("e"))
    line = running(acks.unionByName(marks), ["run_id"], "at", sums={"expected": F.col("e")}).withColumnRenamed("at", "elapsed_ns")
    j = join_nullsafe(points, line, ["run_id", "elapsed_ns"], "inner").join(
        t["runs"].select("run_id", "total_ns", "persisted", "observed_events"), "run_id"
    )
    bounds = F.when(F.col("final"), F.col("visible") == F.col("persisted")).otherwise(F.col("visible") <= F.col("observed_events"))
    g = j.groupBy("run_id").agg(
        F.bool_and((F.col("elapsed_ns") >= 0) & (F.col("elapsed_ns") <= F.col("total_ns"))).alias("in_run"),
        F.bool_and((F.col("visible") >= 0) & (F.col("visible") <= F.col("persisted")) & bounds).alias("bounded"),
        F.bool_and(F.col("accepted") == F.col("expected")).alias("acks"),
    )
    r = per_run(t["runs"].select("run_id"), ordered, g)
    yes = F.lit(True)
    return verdict(r, "R10", {
        "timeline": F.coalesce("time_ordered", yes) & F.coalesce("in_run", yes),
        "visible": F.coalesce("visible_ordered", yes) & F.coalesce("bounded", yes),
        "acks": F.coalesce("acks", yes),
    })


def r11_status(t: Tables) -> DataFrame:
    load = sum((F.col(c) for c in LOAD_COUNTERS), F.lit(0)) > 0
    watched = (F.col("observer_late_polls") + F.col("observer_outages") + F.col("observer_slow_queries") > 0)
    limited = load | watched | F.col("observation_status").isin("failed", "partial")
    return verdict(t["runs"], "R11", {
        "load": F.col("load_status") == F.when(load, "limited").otherwise("met"),
        "outcome": F.col("outcome") == F.when(limited, "limited").otherwise("complete"),
    })


RUN_RULES: dict[str, Callable[[Tables], DataFrame]] = {
    "R1": r1_correctness, "R2": r2_sets, "R3": r3_counts, "R4": r4_requests, "R5": r5_connections, "R6": r6_window,
    "R7": r7_visibility, "R8": r8_percentiles, "R9": r9_rates, "R10": r10_backlog, "R11": r11_status,
}


def audit(tables: Tables, rules: Sequence[str] = tuple(RUN_RULES)) -> DataFrame:
    """(run_id, rule, passed, detail) for the asked rules."""
    return reduce(DataFrame.unionByName, [RUN_RULES[r](tables) for r in rules])


# Rules over cases, controls and artifacts.

# Required controls, topics as (name, partitions), retention, shapes and secret markers.
REQUIRED_SETTINGS = {"api_tls": "true", "api_route": "https_gateway", "redpanda_memory": "1G", "redpanda_smp": "1",
                     "api_rate_limit_rps": "10000", "api_log_level": "info"}
TLS_VERSIONS = ("TLS 1.2", "TLS 1.3")
DURABLE_DATABASE = ("fsync", "synchronous_commit", "full_page_writes")
SERVER_VERSION = "18.6"
RETENTION_MS = "604800000"
SHA256_SHAPE = "^[0-9a-f]{64}$"
REVISION_SHAPE = "^[0-9a-f]{40}$"
SECRET_MARKERS = ("postgres://", "POSTGRES_ADMIN_PASSWORD", "POSTGRES_WRITER_PASSWORD", "-----BEGIN PRIVATE KEY")
CALIBRATION_SETS = ("accepted", "attempted", "sink_received")
CALIBRATION_KIND, CALIBRATION_PROTOCOL, CALIBRATION_RUNS = "tls_driver_calibration", "HTTP/1.1", 3
CALIBRATION_RATES = (15_000, 30_000, 50_000)
CALIBRATION_CONTROLS = {"batch_size": 100, "payload_bytes": 1024, "concurrency": 128, "max_connections": 128, "window_ns": 10_000_000_000}
CASE_PARTS = 192  # that registered cases are dealt over; up to 200 are written without a sort in memory
REGISTRY_CASES = {"full": 25, "connections": 12, "smoke": 2}
OUTBOX_ROWS = 100
OUTBOX_TIMEOUT_NS = 5_000_000_000
OUTBOX_FIRST_STATUS = ("http_503", "delivery_uncertain")
MAX_STORED_BYTES = 64 * 1024 * 1024
MAX_RAW_BYTES = 128 * 1024 * 1024


def r12_manifest(manifests: DataFrame, topics: Sequence[tuple[str, int]]) -> DataFrame:
    """Recorded controls (run_id, source_sha, identity_sha, fsync_bypass, settings, database, topic_text)."""
    s, d, text = F.col("settings"), F.col("database"), F.col("topic_text")
    pairs = {k: s[k] == v for k, v in REQUIRED_SETTINGS.items()}
    values = lambda key: F.regexp_extract_all(text, F.lit(rf"(?m)^{key}\s+(\S+)"), 1)
    only = lambda key, v: (F.size(values(key)) >= 2) & F.forall(values(key), lambda x: x == v)
    shape = [text.rlike(rf"NAME\s+{name.replace('.', '[.]')}\s+PARTITIONS\s+{n}\s+REPLICAS\s+1") for name, n in topics]
    return verdict(manifests, "R12", {
        "revision": (F.col("source_sha") == F.col("identity_sha")) & ~F.col("fsync_bypass"),
        "settings": reduce(lambda a, b: a & b, pairs.values()) & s["tls_version"].isin(*TLS_VERSIONS),
        "database": reduce(lambda a, b: a & b, [d[k] == "on" for k in DURABLE_DATABASE]) & (d["server_version"] == SERVER_VERSION),
        "caching": only(r"write\.caching", "false"),
        "retention": only(r"retention\.ms", RETENTION_MS),
        "topics": reduce(lambda a, b: a & b, shape),
    })


def r12_registry(studies: DataFrame, cases: DataFrame, publication: bool = True) -> DataFrame:
    """Per study (run_id, mode): as many ``cases`` (study_id, case_id) as its mode asks for, each ID once. A smoke study is no publication.

    Cases are dealt before they are counted: counts of a task that reads many of them would hold nearly each one in memory.
    """
    dealt = cases.select(F.col("study_id").alias("run_id"), "case_id").repartition(CASE_PARTS, "run_id")
    g = dealt.groupBy("run_id", "case_id").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.sum("n").alias("n"), F.count("case_id").alias("ids"))
    want = F.create_map(*[F.lit(x) for item in REGISTRY_CASES.items() for x in item])[F.col("mode")]
    return verdict(per_run(studies, g), "R12", {
        "mode": want.isNotNull() & (F.lit(not publication) | (F.col("mode") != "smoke")),
        "cardinality": F.coalesce("n", F.lit(0)) == want, "unique": F.coalesce(F.col("n") == F.col("ids"), F.lit(True)),
    })


def r13_provenance(runs: DataFrame) -> DataFrame:
    """Revision and fingerprint shapes, clean sources for full runs, and recomputed control fingerprints if given."""
    prints = [c for c in runs.columns if c.endswith("_fingerprint") and not c.startswith("computed_")]
    checks = {c: F.col(c).rlike(SHA256_SHAPE) for c in prints}
    checks["revision"] = F.col("source_sha").rlike(REVISION_SHAPE)
    checks["clean"] = ~F.col("mode").isin("full", "connections") | ~F.col("source_dirty")
    for c in prints:
        if f"computed_{c}" in runs.columns:
            checks[f"same_{c}"] = F.col(c) == F.col(f"computed_{c}")
    return verdict(runs, "R13", checks)


def r14_calibration(runs: DataFrame, requests: DataFrame, digests: DataFrame) -> DataFrame:
    """Calibration accounting: plan, totals, in-window rate, replies, and three equal set digests."""
    q = requests.join(runs.select("run_id", "window_ns"), "run_id")
    ev = F.col("events")
    g = q.groupBy("run_id").agg(
        F.sum(ev).alias("n_attempted"), F.coalesce(F.sum(F.when(F.col("accepted"), ev)), F.lit(0)).alias("n_accepted"),
        F.coalesce(F.sum(F.when(F.col("accepted") & (F.col("finished_ns") <= F.col("window_ns")), ev)), F.lit(0)).alias("inside"),
        F.bool_and((F.col("finished_ns") >= F.col("started_ns")) & (F.col("started_ns") >= 0)
                   & (F.col("elapsed_ns") == F.col("finished_ns") - F.col("started_ns")) & F.coalesce(F.col("status") == 202, F.lit(False))).alias("replies"),
    )
    d = digests.groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set("set_name")), ",").alias("names"), F.countDistinct("sha256").alias("kinds"),
        F.bool_and(F.col("sha256").rlike(SHA256_SHAPE)).alias("shaped"),
    )
    j = per_run(runs, g, d)
    return verdict(j, "R14", {
        "plan": F.col("correct") & (F.col("planned") == (F.col("rate") * F.col("window_ns") / F.lit(1e9)).cast("bigint")),
        "accounting": (F.col("attempted") == F.col("n_attempted")) & (F.col("accepted_events") == F.col("n_accepted"))
        & (F.col("accepted_in_window") == F.col("inside")) & (F.col("generator_missed") + F.col("n_attempted") == F.col("planned")),
        "rate": (F.col("total_ns") >= F.col("window_ns")) & close(F.col("accepted_eps"), F.col("inside") * F.lit(1e9) / F.col("window_ns")),
        "replies": F.col("replies"),
        "digests": (F.col("names") == ",".join(CALIBRATION_SETS)) & (F.col("kinds") == 1) & F.col("shaped"),
    })


def r14_transport(runs: DataFrame) -> DataFrame:
    """What a calibration run says of its connections: (run_id, requests, active_requests, waiting, errors, protocols map, peak_open)."""
    protocols = F.col("protocols")
    return verdict(runs, "R14", {
        "idle": (F.col("active_requests") == 0) & (F.col("waiting") == 0),
        "errors": F.coalesce(F.size("errors"), F.lit(0)) == 0,
        "protocols": (F.size(protocols) == 1) & (protocols[CALIBRATION_PROTOCOL] == F.col("requests")),
        "connections": F.col("peak_open").between(1, CALIBRATION_CONTROLS["max_connections"]),
    })


def r14_reports(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Calibration reports (run_id, schema, kind, source_sha, identity_sha, https, status and the controls) and their numbers of ``runs`` (report_id)."""
    counts = runs.groupBy(F.col("report_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n_runs"))
    controls = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in CALIBRATION_CONTROLS.items() if k != "max_connections"])
    return verdict(per_run(reports, counts), "R14", {
        "identity": (F.col("schema") == 2) & (F.col("kind") == CALIBRATION_KIND) & (F.col("source_sha") == F.col("identity_sha")) & F.col("https"),
        "controls": controls & (F.col("max_open") == CALIBRATION_CONTROLS["max_connections"]) & (F.col("max_idle") == CALIBRATION_CONTROLS["max_connections"]),
        "status": F.coalesce("status", F.lit("complete")) == "complete",
        "repetitions": F.col("n_runs") == CALIBRATION_RUNS,
    })


def r14_cohort(studies: DataFrame, reports: DataFrame) -> DataFrame:
    """Per study (run_id, identity_sha): the reports (study_id, rate, source_sha) hold each calibration rate once, all of the study's source."""
    g = reports.groupBy(F.col("study_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("rate").alias("rates"), F.bool_and(F.col("rate").isin(*CALIBRATION_RATES)).alias("known"),
        F.countDistinct("source_sha").alias("sources"), F.max("source_sha").alias("source"),
    )
    n = len(CALIBRATION_RATES)
    return verdict(per_run(studies, g), "R14", {
        "cohort": (F.col("n") == n) & (F.col("rates") == n) & F.col("known"),
        "source": (F.col("sources") == 1) & (F.col("source") == F.col("identity_sha")),
    })


def r15_database(runs: DataFrame, cases: DataFrame, repetitions: int = 3) -> DataFrame:
    """Per case: the method by repetition grid, counts, and the number and sum of timed batches.

    ``runs`` has correct, batch_count and batch_sum_ns; ``cases`` count, duplicate_fraction and batch_size.
    """
    j = runs.join(cases, "case_id")
    unique = F.col("count") - (F.col("count") * F.col("duplicate_fraction")).cast("bigint")
    size = F.when(F.col("method") == METHODS[0], 1).otherwise(F.col("batch_size"))
    counts = (F.col("submitted") == F.col("count")) & (F.col("inserted") == unique) & (F.col("duplicates") == F.col("count") - unique)
    timed = (F.col("batch_count") == F.ceil(F.col("count") / size)) & (F.col("batch_sum_ns") > 0) & (F.col("batch_sum_ns") <= F.col("elapsed_ns"))
    in_grid = F.col("method").isin(*METHODS) & F.col("repetition").between(1, repetitions)
    g = j.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("method", "repetition").alias("cells"), F.bool_and(in_grid).alias("grid"),
        F.bool_and(counts).alias("counts"), F.bool_and(timed).alias("timed"), F.bool_and(F.coalesce(F.col("correct"), F.lit(False))).alias("correct"),
    ).withColumnRenamed("case_id", "run_id")
    want = len(METHODS) * repetitions
    return verdict(g, "R15", {
        "grid": F.col("grid") & (F.col("n") == want) & (F.col("cells") == want), "counts": F.col("counts"), "batches": F.col("timed"),
        "correct": F.col("correct"),
    })


def r16_recovery(runs: DataFrame, sets: DataFrame) -> DataFrame:
    """Outbox recoveries: equal accepted and stored sets of the fixed size, an established timeout, enough faults."""
    same = reconcile.exact_set(
        sets.where("set_name = 'accepted'").select("run_id", "event_id").distinct(),
        sets.where("set_name = 'stored'").select("run_id", "event_id"), ["run_id"], "event_id",
    ).select("run_id", "equal")
    j = per_run(runs, same, sizes(sets))
    return verdict(j, "R16", {
        "correct": F.col("correct") & (F.col("fault_count") >= MIN_FAULTS),
        "sets": F.col("equal") & (F.col("n_stored") == OUTBOX_ROWS) & (F.col("n_ambiguous") == OUTBOX_ROWS),
        "timeout": (F.col("first_attempt_ns") >= OUTBOX_TIMEOUT_NS) & F.col("first_attempt_status").isin(*OUTBOX_FIRST_STATUS),
    })


def r17_secrets(texts: DataFrame, key: str, text: str, markers: Sequence[str] = SECRET_MARKERS) -> DataFrame:
    """(key, marker) of every marker found in a whole text. Rows are scanned where they are."""
    found = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.col(text), m))
    return texts.select(key, F.explode(found).alias("marker"))


def r18_artifacts(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Faults of stored artifacts against their references: presence, size, hash, raw size, gzip time.

    ``files`` comes from ``file_inventory`` with ``raw_bytes`` and ``gzip_time_zero``.
    """
    f = files.select("path", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"), "raw_bytes", "gzip_time_zero")
    gz = F.coalesce(F.col("codec"), F.lit("gzip")) != "json"
    fault = (
        F.when(F.col("f_size").isNull(), "missing")
        .when((F.col("size") != F.col("f_size")) | (F.col("f_size") > MAX_STORED_BYTES), "size")
        .when(F.col("sha256") != F.col("f_sha"), "hash")
        .when(gz & ~F.coalesce("gzip_time_zero", F.lit(False)), "gzip_time")
        .when((F.col("expected_raw") != F.coalesce("raw_bytes", F.lit(-1))) | (F.col("expected_raw") > MAX_RAW_BYTES), "raw_size")
    )
    return refs.withColumnRenamed("raw_size", "expected_raw").join(f, "path", "left").select("path", fault.alias("fault")).where("fault IS NOT NULL")


def r19_mask(samples: DataFrame, metric: str, revision: str, bad: Sequence[str], reason: str) -> DataFrame:
    """Samples with the metric marked unavailable where its source revision is known to be wrong; raw rows stay as they are."""
    void = F.struct(F.lit("unavailable").alias("status"), F.lit(reason).alias("reason"))
    ok = F.struct(F.lit("available").alias("status"), F.lit(None).cast("string").alias("reason"))
    wrong = F.col(revision).isin(*bad) & F.col(metric).isNotNull()
    return samples.withColumn(f"{metric}_status", F.when(wrong, void).when(F.col(metric).isNotNull(), ok)).withColumn(
        metric, F.when(~wrong, F.col(metric))
    )


def r20_summaries(reports: DataFrame, summaries: DataFrame, keys: Sequence[str], nested: Sequence[str] = ()) -> DataFrame:
    """Keys whose summary is not the report without its samples."""
    from tidemark.operators.runs import strip_samples
    from tidemark.operators.store import snapshot_diff

    content = [c for c in reports.columns if c not in keys]
    return snapshot_diff(strip_samples(reports, nested), summaries, keys, content)


def r20_rows(reports: DataFrame, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``r20_summaries`` of captures that are rows (keys, path, index, value): keys with a field that differs, is missing or too many."""
    from tidemark.operators.store import snapshot_diff

    fields = reports.where(F.col("index").isNull())
    found = snapshot_diff(fields, summaries, [*keys, "path"], ["value"])
    return found.select(*keys, F.lit("content").alias("difference")).distinct()


def _found(findings: DataFrame, rule: str, detail: Column) -> DataFrame:
    """Findings as failed rows, behind one row that says whether there are any."""
    subject = F.concat_ws("/", *[F.col(c).cast("string") for c in findings.columns if c not in ("fault", "difference", "marker", "complete")])
    rows = findings.select(subject.alias("subject"), F.lit(rule).alias("rule"), F.lit(False).alias("passed"), detail.alias("detail"))
    none = findings.agg(F.count(F.lit(1)).alias("n")).select(F.lit("study").alias("subject"), F.lit(rule).alias("rule"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("detail"))
    return none.unionAll(rows)


def _judged(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(F.col("run_id").cast("string").alias("subject"), "rule", "passed", "detail")


#: Rules over a whole study, by the tables that each reads.
STUDY_RULES: dict[str, Callable[[Tables], DataFrame]] = {
    "R12": lambda t: _judged(r12_registry(t["studies"], t["registry"])),
    "R13": lambda t: _judged(r13_provenance(t["provenance"])),
    "R14": lambda t: _judged(r14_calibration(t["calibrations"], t["calibration_requests"], t["calibration_digests"])),
    "R15": lambda t: _judged(r15_database(t["database_runs"], t["database_cases"])),
    "R16": lambda t: _judged(r16_recovery(t["recoveries"], t["recovery_sets"])),
    "R17": lambda t: _found(r17_secrets(t["texts"], "name", "text"), "R17", F.col("marker")),
    "R18": lambda t: _found(r18_artifacts(t["artifact_refs"], t["artifact_files"]), "R18", F.col("fault")),
    "R19": lambda t: _found(t["masked"].where("value IS NOT NULL AND revision_wrong").select("sample_id"), "R19", F.lit("value of a wrong revision")),
    "R20": lambda t: _found(r20_rows(t["report_rows"], t["summary_rows"], ["run_id"]), "R20", F.col("difference")),
    "R21": lambda t: _found(repetition_sets(t["repetitions"], 3).where("NOT complete"), "R21", F.lit("repetitions")),
}


class _NotGiven(Exception):
    """A rule asks for a table that the study doesn't have."""


class _Given(dict):
    def __missing__(self, name: str) -> DataFrame:
        raise _NotGiven(name)


def audit_study(tables: Tables, rules: Sequence[str] | None = None) -> DataFrame:
    """(subject, rule, passed, detail) for the asked ones of R1 to R21; without ``rules``, for all whose tables are given."""
    every = {**{r: (lambda t, f=f: _judged(f(t))) for r, f in RUN_RULES.items()}, **STUDY_RULES}
    given, parts = _Given(tables), []
    for rule in every if rules is None else rules:
        try:
            parts.append(every[rule](given))
        except _NotGiven as e:
            if rules is not None:
                raise ValueError(f"{rule} needs the table {e}") from e
    return reduce(DataFrame.unionByName, parts)
