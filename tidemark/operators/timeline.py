"""Ordered analytics over requests, observations, polls and intervals.

Times are BIGINT nanoseconds from the run's start. Every cumulative or
previous-row computation goes through ``running``, so a run may hold any share
of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import join_nullsafe, running


def accepted() -> Column:
    return F.coalesce(F.col("status") == 202, F.lit(False))


def ack_series(requests: DataFrame) -> DataFrame:
    """Cumulative acknowledged events by finish time."""
    return running(requests.where(accepted()), ["run_id"], "finished_ns", sums={"acknowledged": F.col("events")})


def backlog(samples: DataFrame, requests: DataFrame, observations: DataFrame) -> DataFrame:
    """At each sample: events accepted so far and acknowledged but not yet observed.

    ``observations`` has one row per accepted request with ``observed_ns`` (NULL when
    never seen). Pending rises at an acknowledgement that is not yet observed and
    falls at the observation. Ties count: an acknowledgement at the sample's own
    time is before it.
    """
    acks = requests.where(accepted()).join(observations, ["run_id", "request_id"], "left")
    waits = F.col("observed_ns").isNull() | (F.col("observed_ns") > F.col("finished_ns"))
    none = F.lit(0).cast("bigint")
    up = acks.select("run_id", F.col("finished_ns").alias("at"), F.col("events").alias("acc"), F.when(waits, F.col("events")).otherwise(none).alias("pend"))
    down = acks.where(waits & F.col("observed_ns").isNotNull()).select(
        "run_id", F.col("observed_ns").alias("at"), none.alias("acc"), (-F.col("events")).alias("pend")
    )
    marks = samples.select("run_id", F.col("sample_ns").alias("at"), none.alias("acc"), none.alias("pend"))
    line = running(
        up.unionByName(down).unionByName(marks), ["run_id"], "at",
        sums={"accepted": F.col("acc"), "pending": F.col("pend")},
    ).withColumnRenamed("at", "sample_ns")
    return join_nullsafe(samples, line, ["run_id", "sample_ns"], "inner")


def backlog_at(acks: DataFrame, end_ns: int) -> DataFrame:
    """Per run: events acknowledged by the window's end and not observed by then."""
    open_then = (F.col("finished_ns") <= end_ns) & (F.col("observed_ns").isNull() | (F.col("observed_ns") > end_ns))
    return acks.groupBy("run_id").agg(F.coalesce(F.sum(F.when(open_then, F.col("events"))), F.lit(0)).alias("backlog"))


def window_side(ns: Column, window_ns: int) -> Column:
    """Exactly at the end is inside."""
    return F.when(ns <= window_ns, "inside").otherwise("tail")


def window_split(requests: DataFrame, window_ns: int) -> DataFrame:
    """Event totals by outcome and window side; starts decide attempts, finishes decide acceptance."""
    ev = F.col("events")
    inside_start, inside_finish = F.col("started_ns") <= window_ns, F.col("finished_ns") <= window_ns

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, ev)), F.lit(0))

    lost = F.col("status").isNull() | ((F.col("status") != 202) & (F.col("status") >= 500))
    turned_down = F.coalesce((F.col("status") != 202) & (F.col("status") < 500), F.lit(False))
    return requests.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(ev).alias("attempted"),
        total(inside_start).alias("attempted_in_window"),
        total(~inside_start).alias("attempted_after_window"),
        total(accepted()).alias("accepted"),
        total(accepted() & inside_finish).alias("accepted_in_window"),
        total(accepted() & ~inside_finish).alias("accepted_after_window"),
        total(lost).alias("ambiguous"),
        total(turned_down).alias("rejected"),
    )


def poll_gaps(polls: DataFrame, interval_ns: int) -> DataFrame:
    """Per run: polls, late gaps (more than twice the interval) and the largest gap."""
    prev = running(polls, ["run_id"], "started_ns", sums={"here": F.lit(1)}, before_maxes={"previous": F.col("started_ns")})
    per_time = polls.groupBy("run_id", "started_ns").agg(F.count(F.lit(1)).alias("copies"))
    j = join_nullsafe(prev, per_time, ["run_id", "started_ns"], "inner")
    gap = F.col("started_ns") - F.col("previous")
    return j.groupBy("run_id").agg(
        F.sum("copies").alias("polls"),
        F.count_if(gap > 2 * interval_ns).alias("late_polls"),
        F.coalesce(F.max(gap), F.lit(0)).alias("max_gap_ns"),
    )


def poll_stats(polls: DataFrame, interval_ns: int) -> DataFrame:
    """Per run: polls, query time in total and at most, slow queries, outages."""
    took = F.col("finished_ns") - F.col("started_ns")
    return polls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("polls"),
        F.sum(took).alias("query_ns"),
        F.max(took).alias("max_query_ns"),
        F.count_if(took > 2 * interval_ns).alias("slow_queries"),
        F.count_if(~F.col("available")).alias("outages"),
    )


def peak_overlap(intervals: DataFrame, start: str = "started_ns", end: str = "finished_ns") -> DataFrame:
    """Per run: most intervals open at once, and those never closed (NULL end).

    An interval that ends when another starts does not overlap it.
    """
    one = F.lit(1).cast("bigint")
    opens = intervals.select("run_id", F.col(start).alias("at"), one.alias("d"))
    closes = intervals.where(F.col(end).isNotNull()).select("run_id", F.col(end).alias("at"), (-one).alias("d"))
    level = running(opens.unionByName(closes), ["run_id"], "at", sums={"level": F.col("d")})
    peaks = level.groupBy("run_id").agg(F.max("level").alias("peak"), F.max_by("level", "at").alias("still_open"))
    return peaks


def monotonic(points: DataFrame, position: str = "position") -> DataFrame:
    """Per run: whether elapsed time and visible rows never decrease, in recorded order."""
    before = {"pe": F.col("elapsed_ns"), "pv": F.col("visible")}
    j = running(points, ["run_id"], position, before_maxes=before, unique=True, keep=["elapsed_ns", "visible"])
    ok = lambda now, before: F.coalesce(F.col(now) >= F.col(before), F.lit(True))
    return j.groupBy("run_id").agg(
        F.bool_and(ok("elapsed_ns", "pe")).alias("time_ordered"), F.bool_and(ok("visible", "pv")).alias("visible_ordered")
    )


def schedule_lateness(batches: DataFrame, plan: dict) -> DataFrame:
    """Per run: late batches and missed events against the offered schedule.

    ``batches`` has (run_id, first, events, started_ns), ``first`` being the index of
    the batch's first event. ``plan``: rate per second, window_ns, batch, pattern. A
    burst offers everything in the first quarter of the window.
    """
    count = int(plan["rate"] * plan["window_ns"] / 1e9)
    active = plan["window_ns"] // 4 if plan["pattern"] == "burst" else plan["window_ns"]
    due = (F.col("first").cast("double") / F.lit(float(count)) * F.lit(float(active))).cast("bigint")
    interval = int(plan["batch"] / count * active)
    late = F.col("started_ns") - due > interval
    missed = F.col("started_ns") > active
    return batches.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("batches"),
        F.count_if(late).alias("late"),
        F.coalesce(F.sum(F.when(missed, F.col("events"))), F.lit(0)).alias("missed_events"),
    )


def completion(observations: DataFrame) -> DataFrame:
    """Per run: when the last accepted row was observed; NULL while any is unobserved."""
    return observations.groupBy("run_id").agg(
        F.when(F.count_if(F.col("observed_ns").isNull()) == 0, F.max("observed_ns")).alias("completed_ns")
    )


def observed_curve(points: DataFrame) -> DataFrame:
    """Curve points in seconds: unavailable ones are NULL, the final check is a series of its own."""
    return points.select(
        "run_id",
        F.when(F.col("final"), "verified").otherwise("observed").alias("series"),
        (F.col("elapsed_ns") / F.lit(1e9)).alias("seconds"),
        F.when(F.col("available"), F.col("visible")).alias("visible"),
    )


def request_positions(requests: DataFrame, order: str = "request_id", sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds ``first``: the position of each request's first event in its run's attempted list; ``sums`` are running totals made along with it."""
    others = [c for c in requests.columns if c not in ("run_id", order)]
    upto = running(requests, ["run_id"], order, sums={"upto": F.col("events"), **(sums or {})}, unique=True, keep=others)
    return upto.withColumn("first", F.col("upto") - F.col("events")).drop("upto")


def request_ids(requests: DataFrame, attempted: DataFrame, order: str = "request_id") -> DataFrame:
    """Joins each attempted ID (run_id, position, event_id) to the request that sent it.

    A request holds at most a batch of events, so its positions are listed and the
    join is on equal positions.
    """
    spans = request_positions(requests, order).where("events > 0")
    listed = spans.select(
        "run_id", order, "status", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("events") - 1)).alias("position")
    )
    return join_nullsafe(listed, attempted, ["run_id", "position"], "inner")


def attach_samples(samples: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """Samples (at) inside each run's window [start, start + total], with seconds since its start.

    Runs are listed per time slot of ``width``; the join is on equal slots.
    """
    slots = runs.withColumn(
        "__slot", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("total")) / width)))
    )
    s = samples.withColumn("__slot", F.floor(F.col("at") / width))
    x = F.col("at") - F.col("start")
    return s.join(slots, "__slot").where((x >= 0) & (x <= F.col("total"))).withColumn("offset", x).drop("__slot")


def consecutive_breaches(samples: DataFrame, order: str, value: str, limit: float, by: str = "run_id") -> DataFrame:
    """Rows above the limit whose previous row was above it too: where a guard stops the run."""
    over = F.col(value) > limit
    others = [c for c in samples.columns if c not in (by, order)]
    j = running(samples, [by], order, before_maxes={"prev": F.struct(F.col(order), over.alias("over"))}, unique=True, keep=others)
    return j.where(over & F.col("prev.over")).drop("prev")
