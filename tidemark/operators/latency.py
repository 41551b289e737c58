"""Latencies, histograms and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Histogram bounds in seconds and in events.
DEFAULT_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
RECEIPT_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
BATCH_BOUNDS = (1.0, 10.0, 50.0, 100.0, 250.0, 500.0)


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets in long form: (by, le, cumulative, count, total); le NULL is the open bucket.

    One aggregation with a counter per bound; rows are never multiplied.
    """
    v = F.col(value)
    g = df.groupBy(*by).agg(
        F.count(v).alias("count"),
        F.sum(v.cast("double")).alias("total"),
        *[F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
    )
    pairs = ", ".join([f"CAST({b!r} AS DOUBLE), b{i}" for i, b in enumerate(bounds)] + ["CAST(NULL AS DOUBLE), count"])
    return g.selectExpr(*by, "count", "total", f"stack({len(bounds) + 1}, {pairs}) AS (le, cumulative)")


def receipt_latency(rows: DataFrame, received: str, stored: str) -> DataFrame:
    """Seconds from receipt to storage; a clock running ahead counts as 0."""
    micros = F.unix_micros(F.col(stored).cast("timestamp")) - F.unix_micros(F.col(received).cast("timestamp"))
    return rows.withColumn("seconds", F.greatest(F.lit(0), micros) / F.lit(1e6))


def visibility(observations: DataFrame, by: Sequence[str], received_ns: str, observed_ns: str) -> DataFrame:
    """Per group: usable samples, and whether clocks disagreed. A negative latency is an error, not 0."""
    lat = F.col(observed_ns) - F.col(received_ns)
    return observations.groupBy(*by).agg(
        F.count_if(lat >= 0).alias("samples"),
        F.coalesce(F.bool_or(lat < 0), F.lit(False)).alias("clocks_disagree"),
        F.coalesce(F.sum(F.when(lat >= 0, lat)), F.lit(0)).alias("latency_ns"),
    )


def rates(runs: DataFrame) -> DataFrame:
    """Two rates over different denominators: accepted in the window, stored over the whole run."""
    def per_second(count: Column, ns: Column) -> Column:
        return F.when(ns > 0, count.cast("double") * F.lit(1e9) / ns).otherwise(F.lit(0.0))

    return runs.withColumn("accepted_eps", per_second(F.col("accepted_in_window"), F.col("window_ns"))).withColumn(
        "verified_eps", per_second(F.col("persisted"), F.col("total_ns"))
    )


def counters(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def count_map(df: DataFrame, by: Sequence[str], label: Column, out: str) -> DataFrame:
    """A map of bounded label to count per group."""
    counts = df.where(label.isNotNull()).groupBy(*by, label.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "n")))).alias(out))
