"""Latency, backlog, windows, schedules, positions and log offsets."""

from pyspark.sql import functions as F

from tidemark.operators import latency, offsets, ranks, timeline
from tidemark.plans.catalog import query

WINDOW_NS = 10_000_000_000
PS = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99}

# When each request's events were first seen: some never, some before the reply arrived.
SEEN = """seen AS (SELECT run_id, request_id, CASE WHEN request_id % 21 = 5 THEN NULL
  WHEN request_id % 15 = 4 THEN finished_ns - 1 ELSE finished_ns + (request_id * 6700417) % 900000000 END AS observed_ns FROM v_requests WHERE status = 202)"""


def seen(t):
    rid = F.col("request_id")
    return t.v_requests.where("status = 202").select(
        "run_id", "request_id",
        F.when(rid % 21 == 5, F.lit(None)).when(rid % 15 == 4, F.col("finished_ns") - 1)
        .otherwise(F.col("finished_ns") + (rid * 6700417) % 900000000).alias("observed_ns"),
    )


@query("a6_percentiles", """
WITH o AS (SELECT run_id, elapsed_ns AS v FROM v_requests WHERE status = 202)
SELECT run_id, count(*) AS n, quantile_disc(v, 0.5) AS p50_ns, quantile_disc(v, 0.95) AS p95_ns, quantile_disc(v, 0.99) AS p99_ns FROM o GROUP BY run_id""")
def _(t):
    return ranks.nearest_rank(t.v_requests.where("status = 202"), "elapsed_ns", ["run_id"], PS)


@query("a6_percentiles_empty", """
SELECT run_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS p50_ns, CAST(0 AS BIGINT) AS p95_ns, CAST(0 AS BIGINT) AS p99_ns FROM v_requests GROUP BY run_id""")
def _(t):
    """Runs without a single sample report 0, not NULL."""
    none = t.v_requests.select("run_id", F.when(F.col("status") == 999, F.col("elapsed_ns")).alias("elapsed_ns"))
    return ranks.nearest_rank(none, "elapsed_ns", ["run_id"], PS)


def bounds_sql(source: str, value: str, bounds, by: str = "") -> str:
    les = ", ".join(f"(CAST({b!r} AS DOUBLE))" for b in bounds) + ", (CAST(NULL AS DOUBLE))"
    comma = f"{by}, " if by else ""
    return f"""SELECT {comma}b.le, count({value}) AS count, sum({value}) AS total, count(*) FILTER (WHERE b.le IS NULL OR {value} <= b.le) AS cumulative
FROM {source} CROSS JOIN (VALUES {les}) b(le) GROUP BY {comma}b.le"""


@query("a7_request_histogram", "WITH q AS (SELECT run_id, CAST(elapsed_ns AS DOUBLE) / 1e9 AS v FROM v_requests) "
       + bounds_sql("q", "v", latency.DEFAULT_BOUNDS, "run_id").replace("sum(v)", "round(sum(v), 3)"))
def _(t):
    q = t.v_requests.select("run_id", (F.col("elapsed_ns") / F.lit(1e9)).alias("v"))
    return latency.histogram(q, "v", latency.DEFAULT_BOUNDS, ["run_id"]).withColumn("total", F.round("total", 3))


@query("a7_batch_histogram", "WITH q AS (SELECT CAST(events AS DOUBLE) AS v FROM v_requests) " + bounds_sql("q", "v", latency.BATCH_BOUNDS))
def _(t):
    return latency.histogram(t.v_requests.select(F.col("events").cast("double").alias("v")), "v", latency.BATCH_BOUNDS)


@query("a10_receipt_latency", "WITH q AS (SELECT greatest(0, (event_id * 7919) % 90000000 - 5000000) / 1e6 AS v FROM events) "
       + bounds_sql("q", "v", latency.RECEIPT_BOUNDS).replace("sum(v)", "round(sum(v), 3)"))
def _(t):
    """Some rows carry a receipt time ahead of the storage clock; they count as 0 seconds."""
    stored = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") * 7919) % 90000000 - 5000000)
    rows = latency.receipt_latency(t.events.withColumn("stored_at", stored), "ts", "stored_at")
    return latency.histogram(rows, "seconds", latency.RECEIPT_BOUNDS).withColumn("total", F.round("total", 3))


@query("a11_visibility", f"""WITH {SEEN}
SELECT q.run_id, count(*) FILTER (WHERE observed_ns >= finished_ns) AS samples, coalesce(bool_or(observed_ns < finished_ns), false) AS clocks_disagree,
  CAST(coalesce(sum(CASE WHEN observed_ns >= finished_ns THEN observed_ns - finished_ns END), 0) AS BIGINT) AS latency_ns
FROM v_requests q JOIN seen s ON s.request_id = q.request_id GROUP BY q.run_id""")
def _(t):
    obs = t.v_requests.join(seen(t).drop("run_id"), "request_id")
    return latency.visibility(obs, ["run_id"], "finished_ns", "observed_ns")


WIN = f"""win AS (SELECT run_id, count(*) AS requests, CAST(sum(events) AS BIGINT) AS attempted,
  CAST(coalesce(sum(events) FILTER (WHERE started_ns <= {WINDOW_NS}), 0) AS BIGINT) AS attempted_in_window,
  CAST(coalesce(sum(events) FILTER (WHERE started_ns > {WINDOW_NS}), 0) AS BIGINT) AS attempted_after_window,
  CAST(coalesce(sum(events) FILTER (WHERE status = 202), 0) AS BIGINT) AS accepted,
  CAST(coalesce(sum(events) FILTER (WHERE status = 202 AND finished_ns <= {WINDOW_NS}), 0) AS BIGINT) AS accepted_in_window,
  CAST(coalesce(sum(events) FILTER (WHERE status = 202 AND finished_ns > {WINDOW_NS}), 0) AS BIGINT) AS accepted_after_window,
  CAST(coalesce(sum(events) FILTER (WHERE status IS NULL OR status >= 500), 0) AS BIGINT) AS ambiguous,
  CAST(coalesce(sum(events) FILTER (WHERE status <> 202 AND status < 500), 0) AS BIGINT) AS rejected FROM v_requests GROUP BY run_id)"""


@query("a20_window_totals", f"WITH {WIN} SELECT * FROM win")
def _(t):
    return timeline.window_split(t.v_requests, WINDOW_NS)


@query("w8_window_sides", f"""
SELECT request_id, CASE WHEN started_ns <= {WINDOW_NS} THEN 'inside' ELSE 'tail' END AS start_side,
  CASE WHEN finished_ns <= {WINDOW_NS} THEN 'inside' ELSE 'tail' END AS finish_side FROM v_requests""")
def _(t):
    return t.v_requests.select(
        "request_id", timeline.window_side(F.col("started_ns"), WINDOW_NS).alias("start_side"),
        timeline.window_side(F.col("finished_ns"), WINDOW_NS).alias("finish_side"),
    )


@query("a12_rates", f"""WITH {WIN}
SELECT run_id, round(accepted_in_window * 1e9 / {WINDOW_NS}, 6) AS accepted_eps, round(accepted * 1e9 / 12500000000, 6) AS verified_eps FROM win""")
def _(t):
    runs = timeline.window_split(t.v_requests, WINDOW_NS).select(
        "run_id", "accepted_in_window", F.col("accepted").alias("persisted"), F.lit(WINDOW_NS).alias("window_ns"), F.lit(12_500_000_000).alias("total_ns")
    )
    r = latency.rates(runs)
    return r.select("run_id", F.round("accepted_eps", 6).alias("accepted_eps"), F.round("verified_eps", 6).alias("verified_eps"))


@query("w1_ack_series", """
SELECT DISTINCT run_id, finished_ns, CAST(sum(events) OVER (PARTITION BY run_id ORDER BY finished_ns RANGE UNBOUNDED PRECEDING) AS BIGINT) AS acknowledged
FROM v_requests WHERE status = 202""")
def _(t):
    return timeline.ack_series(t.v_requests)


BACKLOG = f"""WITH {SEEN}, acks AS (SELECT q.run_id, q.finished_ns, q.events, s.observed_ns FROM v_requests q JOIN seen s ON s.request_id = q.request_id),
line AS (SELECT run_id, finished_ns AS tick, events AS acc, CASE WHEN observed_ns IS NULL OR observed_ns > finished_ns THEN events ELSE 0 END AS pend,
           CAST(NULL AS BIGINT) AS sample_id FROM acks
  UNION ALL SELECT run_id, observed_ns, 0, -events, NULL FROM acks WHERE observed_ns > finished_ns
  UNION ALL SELECT run_id, sample_ns, 0, 0, sample_id FROM v_samples),
run AS (SELECT *, sum(acc) OVER w AS accepted, sum(pend) OVER w AS pending FROM line WINDOW w AS (PARTITION BY run_id ORDER BY tick RANGE UNBOUNDED PRECEDING))
"""


@query("w2_accepted_at_samples", BACKLOG + "SELECT run_id, sample_id, CAST(accepted AS BIGINT) AS accepted FROM run WHERE sample_id IS NOT NULL")
def _(t):
    return timeline.backlog(t.v_samples, t.v_requests, seen(t)).select("run_id", "sample_id", "accepted")


@query("w3_pending_gauge", BACKLOG + "SELECT run_id, sample_id, CAST(pending AS BIGINT) AS pending FROM run WHERE sample_id IS NOT NULL")
def _(t):
    return timeline.backlog(t.v_samples, t.v_requests, seen(t)).select("run_id", "sample_id", "pending")


@query("j10_backlog_points", BACKLOG + """SELECT r.run_id, r.tick AS sample_ns, s.available, CAST(r.accepted AS BIGINT) AS accepted, CAST(r.pending AS BIGINT) AS pending
FROM run r JOIN v_samples s ON s.sample_id = r.sample_id""")
def _(t):
    return timeline.backlog(t.v_samples, t.v_requests, seen(t)).select("run_id", "sample_ns", "available", "accepted", "pending")


@query("a21_backlog_at_end", f"""WITH {SEEN}
SELECT q.run_id, CAST(coalesce(sum(events) FILTER (WHERE finished_ns <= {WINDOW_NS} AND (observed_ns IS NULL OR observed_ns > {WINDOW_NS})), 0) AS BIGINT) AS backlog
FROM v_requests q JOIN seen s ON s.request_id = q.request_id GROUP BY q.run_id""")
def _(t):
    return timeline.backlog_at(t.v_requests.join(seen(t).drop("run_id"), "request_id"), WINDOW_NS)


@query("w16_completion", f"""WITH {SEEN}
SELECT run_id, CASE WHEN count(*) FILTER (WHERE observed_ns IS NULL) = 0 THEN max(observed_ns) END AS completed_ns FROM seen WHERE run_id <> 2 OR observed_ns IS NOT NULL GROUP BY run_id""")
def _(t):
    return timeline.completion(seen(t).where("run_id <> 2 OR observed_ns IS NOT NULL"))


@query("w4_poll_gaps", """
WITH g AS (SELECT run_id, sample_ns - lag(sample_ns) OVER (PARTITION BY run_id ORDER BY sample_ns) AS gap FROM v_samples)
SELECT run_id, count(*) AS polls, count(*) FILTER (WHERE gap > 100000000) AS late_polls, coalesce(max(gap), 0) AS max_gap_ns FROM g GROUP BY run_id""")
def _(t):
    return timeline.poll_gaps(t.v_samples.withColumnRenamed("sample_ns", "started_ns"), 50_000_000)


@query("a26_poll_stats", """
SELECT run_id, count(*) AS polls, CAST(sum(sample_id * 104729 % 300000000) AS BIGINT) AS query_ns, max(sample_id * 104729 % 300000000) AS max_query_ns,
  count(*) FILTER (WHERE sample_id * 104729 % 300000000 > 100000000) AS slow_queries, count(*) FILTER (WHERE NOT available) AS outages FROM v_samples GROUP BY run_id""")
def _(t):
    polls = t.v_samples.select(
        "run_id", F.col("sample_ns").alias("started_ns"), (F.col("sample_ns") + F.col("sample_id") * 104729 % 300000000).alias("finished_ns"), "available"
    )
    return timeline.poll_stats(polls, 50_000_000)


@query("w5_peak_requests", """
WITH d AS (SELECT run_id, started_ns AS tick, CAST(1 AS BIGINT) AS d FROM v_requests UNION ALL SELECT run_id, finished_ns, -1 FROM v_requests WHERE request_id % 1000 <> 3),
n AS (SELECT run_id, tick, sum(d) AS d FROM d GROUP BY run_id, tick),
l AS (SELECT run_id, tick, sum(d) OVER (PARTITION BY run_id ORDER BY tick) AS level FROM n)
SELECT run_id, CAST(max(level) AS BIGINT) AS peak, CAST(arg_max(level, tick) AS BIGINT) AS still_open FROM l GROUP BY run_id""")
def _(t):
    open_ended = t.v_requests.withColumn("finished_ns", F.when(F.col("request_id") % 1000 != 3, F.col("finished_ns")))
    return timeline.peak_overlap(open_ended)


@query("w6_segments", """
WITH a AS (SELECT *, sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER (PARTITION BY part ORDER BY off) AS bad FROM v_log),
b AS (SELECT *, CASE WHEN valid THEN floor((row_number() OVER (PARTITION BY part, bad, valid ORDER BY off) - 1) / 5.0) ELSE -1 END AS chunk FROM a)
SELECT part, min(off) AS first_off, max(off) AS last_off, count(*) AS records, CASE WHEN bool_and(valid) THEN 'store' ELSE 'quarantine' END AS kind
FROM b GROUP BY part, bad, chunk""")
def _(t):
    return offsets.segments(t.v_log, 5)


POINTS = """points AS (SELECT sample_id AS position, run_id, CASE WHEN run_id = 1 AND sample_id % 401 = 5 THEN sample_id - 9 ELSE sample_id END AS elapsed_ns,
  CASE WHEN run_id = 2 AND sample_id % 402 = 6 THEN 0 ELSE sample_id * 3 END AS visible, available, sample_id % 100 = 99 AS final FROM v_samples)"""


def points(t):
    return t.sql(f"WITH {POINTS} SELECT * FROM points")


@query("w7_monotonic", f"""WITH {POINTS}, l AS (SELECT run_id, elapsed_ns, visible, lag(elapsed_ns) OVER w AS pe, lag(visible) OVER w AS pv FROM points
  WINDOW w AS (PARTITION BY run_id ORDER BY position))
SELECT run_id, bool_and(coalesce(elapsed_ns >= pe, true)) AS time_ordered, bool_and(coalesce(visible >= pv, true)) AS visible_ordered FROM l GROUP BY run_id""")
def _(t):
    return timeline.monotonic(points(t))


@query("w17_observed_curve", f"""WITH {POINTS}
SELECT run_id, CASE WHEN final THEN 'verified' ELSE 'observed' END AS series, elapsed_ns / 1e9 AS seconds, CASE WHEN available THEN visible END AS visible FROM points""")
def _(t):
    return timeline.observed_curve(points(t))


PLAN = {"rate": 1000, "window_ns": WINDOW_NS, "batch": 100, "pattern": "burst"}


@query("w9_schedule_lateness", """
WITH b AS (SELECT run_id, (request_id % 100) * 100 AS first, events, started_ns FROM v_requests)
SELECT run_id, count(*) AS batches, count(*) FILTER (WHERE started_ns - CAST(floor(CAST(first AS DOUBLE) / 10000 * 2500000000) AS BIGINT) > 25000000) AS late,
  CAST(coalesce(sum(events) FILTER (WHERE started_ns > 2500000000), 0) AS BIGINT) AS missed_events FROM b GROUP BY run_id""")
def _(t):
    b = t.v_requests.select("run_id", (F.col("request_id") % 100 * 100).alias("first"), "events", "started_ns")
    return timeline.schedule_lateness(b, PLAN)


@query("w13_consecutive_breach", """
WITH l AS (SELECT c_nationkey AS run_id, c_custkey AS sample, c_acctbal > 5000 AS breach, lag(c_acctbal > 5000) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS prev FROM customer)
SELECT run_id, sample FROM l WHERE breach AND prev""")
def _(t):
    loads = t.customer.select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("sample"), "c_acctbal")
    return timeline.consecutive_breaches(loads, "sample", "c_acctbal", 5000.0).select("run_id", "sample")


@query("j18_request_ids", """
WITH r AS (SELECT run_id, request_id, status, sum(events) OVER (PARTITION BY run_id ORDER BY request_id) AS upto, events FROM v_requests)
SELECT e.run_id, r.request_id, count(*) AS ids, min(e.event_id) AS low, max(e.event_id) AS high FROM (
  SELECT user_id % 4 AS run_id, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS position FROM events) e
JOIN r ON r.run_id = e.run_id AND e.position >= r.upto - r.events AND e.position < r.upto GROUP BY e.run_id, r.request_id""")
def _(t):
    from tidemark.operators.ordered import running

    ids = t.events.select((F.col("user_id") % 4).alias("run_id"), "event_id")
    listed = running(ids, ["run_id"], "event_id", sums={"n": F.lit(1)}, unique=True).select("run_id", "event_id", (F.col("n") - 1).alias("position"))
    return timeline.request_ids(t.v_requests, listed).groupBy("run_id", "request_id").agg(
        F.count(F.lit(1)).alias("ids"), F.min("event_id").alias("low"), F.max("event_id").alias("high")
    )


@query("j9_attach_samples", """
SELECT r.s_suppkey AS run_id, e.event_id, epoch_us(e.ts) - r.start AS "offset" FROM events e JOIN (
  SELECT s_suppkey, 1704067200000000 + s_suppkey * 7200000000 AS start, (1 + s_suppkey % 5) * 3600000000 AS total FROM supplier) r
ON epoch_us(e.ts) >= r.start AND epoch_us(e.ts) <= r.start + r.total""")
def _(t):
    samples = t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    runs = t.supplier.select(
        F.col("s_suppkey").alias("run_id"), (F.lit(1704067200000000) + F.col("s_suppkey") * 7200000000).alias("start"),
        ((1 + F.col("s_suppkey") % 5) * 3600000000).alias("total"),
    )
    return timeline.attach_samples(samples, runs, 3600000000).select("run_id", "event_id", "offset")


@query("j11_offset_progress", """
WITH e AS (SELECT part, max(off) + 1 AS end_off FROM v_log GROUP BY part),
c AS (SELECT part, max(off) + 1 AS committed_off FROM v_log WHERE valid AND occurred_at < TIMESTAMP '2024-01-20 00:00:00' AND part <> 2 GROUP BY part)
SELECT e.part, end_off, committed_off, end_off - greatest(0, coalesce(committed_off, 0)) AS behind FROM e LEFT JOIN c ON c.part = e.part""")
def _(t):
    log = t.v_log
    end = log.groupBy("part").agg((F.max("off") + 1).alias("end_off"))
    done = log.where("valid AND occurred_at < TIMESTAMP_NTZ '2024-01-20 00:00:00' AND part <> 2").groupBy("part").agg((F.max("off") + 1).alias("committed_off"))
    return offsets.progress(end, done)


SNAPS = """WITH s AS (SELECT snapshot_id, count(*) AS parts, bool_and(end_off >= 0 AND committed_off >= -1 AND committed_off <= end_off) AS possible,
  CAST(sum(end_off - greatest(0, committed_off)) AS BIGINT) AS lag,
  bool_and(end_off >= 0 AND ((end_off = 0 AND committed_off = -1) OR committed_off = end_off)) AS done FROM v_offsets GROUP BY snapshot_id)
"""


@query("w18_offset_lag", SNAPS + "SELECT snapshot_id, CASE WHEN parts = 3 AND possible THEN lag END AS lag FROM s")
def _(t):
    return offsets.offset_lag(offsets.snapshots(t.v_offsets)).select("snapshot_id", "lag")


@query("w19_caught_up", SNAPS + "SELECT snapshot_id, done AS caught_up FROM s")
def _(t):
    return offsets.caught_up(offsets.snapshots(t.v_offsets)).select("snapshot_id", "caught_up")
