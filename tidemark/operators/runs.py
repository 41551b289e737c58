"""Run reports: status, outcomes, completeness and summaries across repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import upper_median

# Limit reasons in order with the counter behind each, methods, and the late-control bound.
COUNTED_LIMITS = (
    ("generator_missed", "generator_missed_events"),
    ("late_schedules", "late_schedules"),
    ("rejected", "http_rejections"),
    ("ambiguous", "ambiguous_delivery"),
    ("attempted_after_window", "request_queue_tail"),
    ("accepted_after_window", "late_acknowledgements"),
    ("observer_late_polls", "observer_poll_delays"),
    ("observer_outages", "observer_unavailable"),
)
LOAD_COUNTERS = tuple(c for c, _ in COUNTED_LIMITS[:6])
METHODS = ("insert", "batch-insert", "copy-merge")
LATE_CONTROL_NS = 250_000_000
MIN_FAULTS = 4


def limit_reasons() -> Column:
    status = F.col("observation_status")
    named = [F.when(F.col(c) > 0, F.lit(reason)) for c, reason in COUNTED_LIMITS]
    named += [
        F.when(status == "failed", F.lit("observer_failed")),
        F.when(status == "partial", F.lit("partial_observation")),
        F.when(F.col("observer_slow_queries") > 0, F.lit("observer_query_delays")),
    ]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def load_status(runs: DataFrame) -> DataFrame:
    """Adds limit_reasons, load_status and outcome. ``aborted`` sticks and, like an incorrect run, fails."""
    limited = sum((F.col(c) for c in LOAD_COUNTERS), F.lit(0)) > 0
    aborted = F.coalesce(F.col("aborted"), F.lit(False))
    load = F.when(aborted, "aborted").when(limited, "limited").otherwise("met")
    out = runs.withColumn("limit_reasons", limit_reasons())
    outcome = (
        F.when(aborted | ~F.col("correct"), "failed").when(F.size("limit_reasons") > 0, "limited").otherwise("complete")
    )
    return out.withColumn("load_status", load).withColumn("outcome", outcome)


def case_outcome(runs: DataFrame, faults: DataFrame) -> DataFrame:
    """A case is limited by any limited run, or by a requested fault more than 250 ms late."""
    by_run = runs.groupBy("case_id").agg(F.bool_or(F.col("outcome") == "limited").alias("run_limited"))
    late = F.col("action").endswith("_requested") & (F.col("elapsed_ns") - F.col("planned_ns") > LATE_CONTROL_NS)
    by_fault = faults.groupBy("case_id").agg(F.bool_or(late).alias("late_fault"))
    limited = F.coalesce(F.col("run_limited"), F.lit(False)) | F.coalesce(F.col("late_fault"), F.lit(False))
    return by_run.join(by_fault, "case_id", "full").select(
        "case_id", F.when(limited, "limited").otherwise("complete").alias("outcome")
    )


def recovery_runs(runs: DataFrame, faults: DataFrame) -> DataFrame:
    """Runs with their fault actions in order; correct only with a clean control and at least four faults."""
    traces = faults.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("fault_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elapsed_ns", "action"))), lambda x: x["action"]), ",").alias("actions"),
    )
    j = runs.join(traces, "run_id", "left")
    n = F.coalesce(F.col("fault_count"), F.lit(0))
    return j.select(
        "run_id", n.alias("fault_count"), "actions", (F.col("correct") & F.col("control_ok") & (n >= MIN_FAULTS)).alias("recovery_correct")
    )


def method_summary(runs: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Upper medians of elapsed time and of the submitted rate, each on its own order."""
    by = list(by)
    rated = runs.withColumn("eps", F.col("submitted").cast("double") * F.lit(1e9) / F.col("elapsed_ns"))
    return upper_median(rated, "elapsed_ns", by, "median_elapsed_ns").join(upper_median(rated, "eps", by, "median_eps"), by)


def _correct() -> Column:
    """A run without a verdict counts as incorrect."""
    return F.coalesce(F.col("correct"), F.lit(False))


def completeness(runs: DataFrame, cases: DataFrame, repetitions: int) -> DataFrame:
    """Faults of each case's method by repetition grid: missing, repeated, unknown, inconsistent or not correct."""
    grid = cases.select("case_id").distinct().select(
        "case_id", F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method")
    ).select("case_id", "method", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(repetitions).cast("bigint"))).alias("repetition"))
    signs = (F.col("inserted") >= 0) & (F.col("duplicates") >= 0) & (F.col("elapsed_ns") > 0) & (F.col("submitted") > 0)
    sums = (F.col("inserted") + F.col("duplicates") == F.col("submitted")) & signs
    seen = runs.groupBy("case_id", "method", "repetition").agg(F.count(F.lit(1)).alias("n"), F.bool_and(sums).alias("adds_up"), F.bool_and(_correct()).alias("correct"))
    j = grid.withColumn("planned", F.lit(True)).join(seen, ["case_id", "method", "repetition"], "full")
    fault = (
        F.when(F.col("n").isNull(), "missing").when(F.col("planned").isNull(), "unknown")
        .when(F.col("n") > 1, "repeated").when(~F.col("adds_up"), "counts").when(~F.col("correct"), "incorrect")
    )
    return j.select("case_id", "method", "repetition", fault.alias("fault")).where("fault IS NOT NULL")


def completed_repetitions(runs: DataFrame) -> DataFrame:
    """Repetitions of a case that hold correct runs of all three methods."""
    return runs.where(_correct()).groupBy("case_id", "repetition").agg(F.countDistinct("method").alias("methods")).where(
        F.col("methods") == len(METHODS)
    ).drop("methods")


def completed_runs(runs: DataFrame) -> DataFrame:
    """Completed repetitions of cases of any ``kind``: a database case needs correct runs of all three methods, others one correct run.

    ``runs`` has (kind, case_id, method, repetition, correct); a pipeline or recovery repetition that was kept twice comes twice.
    """
    database = completed_repetitions(runs.where("kind = 'database'")).select(F.lit("database").alias("kind"), "case_id", "repetition")
    return database.unionByName(runs.where(F.col("kind").isin("pipeline", "recovery") & _correct()).select("kind", "case_id", "repetition"))


def repetition_sets(runs: DataFrame, repetitions: int) -> DataFrame:
    """Whether a case has each repetition exactly once, and all of them correct."""
    g = runs.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct("repetition").alias("distinct"),
        F.min("repetition").alias("low"), F.max("repetition").alias("high"), F.bool_and(_correct()).alias("correct"),
    )
    ok = (F.col("runs") == repetitions) & (F.col("distinct") == repetitions) & (F.col("low") == 1) & (F.col("high") == repetitions)
    ok = ok & F.col("correct")
    return g.select("case_id", ok.alias("complete"))


def ranges(runs: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))])


def mean_acquisition_ms(total_ns: Column, requests: Column) -> Column:
    return total_ns / F.greatest(F.lit(1), requests) / F.lit(1e6)


def session_groups(sessions: DataFrame, own_application: str) -> DataFrame:
    """Sessions by user, own application or ``other``, and state; a missing state stays NULL."""
    app = F.when(F.col("application") == own_application, F.col("application")).otherwise("other")
    return sessions.groupBy("user_name", app.alias("application"), "state").agg(F.count(F.lit(1)).alias("n"))


def audit_totals(cases: DataFrame) -> DataFrame:
    """Runs per kind and the number of limited cases."""
    return cases.groupBy().agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("runs"))), F.lit(0)).alias(f"{k}_runs") for k in ("database", "pipeline", "recovery")],
        F.count_if(F.col("status") == "limited").alias("limited_cases"),
    )


def resource_summary(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.min("memory_free").alias("min_memory_free"), F.max("rss_kib").alias("max_rss_kib"),
        F.max("load").alias("max_load"), F.coalesce(F.bool_or(F.col("stop_reason").isNotNull()), F.lit(False)).alias("triggered"),
    )


SAMPLE_FIELDS = ("ack_ns", "visibility_ns", "backlog", "request_samples", "batch_ns")


def strip_samples(df: DataFrame, nested: Sequence[str] = ()) -> DataFrame:
    """Reports without raw samples: the fields stay, with NULL in them, at the top and in nested structs."""
    types = dict(df.dtypes)
    cols = [F.lit(None).cast(types[c]).alias(c) if c in SAMPLE_FIELDS else F.col(c) for c in df.columns]
    out = df.select(*cols)
    for n in nested:
        for f in df.schema[n].dataType.fields:
            if f.name in SAMPLE_FIELDS:
                out = out.withColumn(n, F.when(F.col(n).isNotNull(), F.col(n).withField(f.name, F.lit(None).cast(f.dataType))))
    return out


# The configuration fields a report may show.
PUBLIC_FIELDS = (
    "http_max_conns_per_host", "http_max_idle_conns_per_host", "observer_reconnect", "namespace", "payload_profile", "https",
    "tenant", "pattern", "seed", "target_events_per_second", "concurrency", "http_batch_size", "payload_bytes", "repetitions",
    "window_ns", "warmup_ns", "drain_deadline_ns", "poll_interval_ns",
)


def safe_fields(config: DataFrame, keys: Sequence[str] = ("run_id",), url: str = "api_url") -> DataFrame:
    """Only allow-listed fields; of the address, whether it is https."""
    shown = config.withColumn("https", F.col(url).startswith("https://")) if url in config.columns else config
    return shown.select(*keys, *[c for c in PUBLIC_FIELDS if c in shown.columns])
