"""Log positions: lag, catching up, and segments between poison records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import running

# Fixed value: partitions of the event log, unless the caller names another number.
LOG_PARTITIONS = 3


def _all_parts(partitions: int) -> Column:
    """Whether the ends are of exactly the partitions 0 to ``partitions - 1``."""
    return F.array_sort(F.map_keys("end")) == F.expr(f"transform(sequence(0, {partitions - 1}), p -> cast(p AS int))")


def snapshots(positions: DataFrame, partitions: int = LOG_PARTITIONS) -> DataFrame:
    """Map form (snapshot_id, status, end, committed) from rows per partition."""
    return positions.groupBy("snapshot_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "end_off")))).alias("end"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("committed_off").isNotNull(), F.struct("part", "committed_off"))))
        ).alias("committed"),
    ).withColumn("status", F.when(_all_parts(partitions), "available").otherwise("unavailable"))


def _ends() -> Column:
    return F.map_entries("end")


def offset_lag(snaps: DataFrame, partitions: int = LOG_PARTITIONS) -> DataFrame:
    """Records behind per snapshot. NULL when unavailable, partitions differ, or positions are impossible."""
    same = F.array_sort(F.map_keys("end")) == F.array_sort(F.map_keys("committed"))
    possible = F.forall(
        _ends(),
        lambda e: (e["value"] >= 0) & (F.col("committed")[e["key"]] >= -1) & (F.col("committed")[e["key"]] <= e["value"]),
    )
    lag = F.aggregate(
        _ends(), F.lit(0).cast("bigint"), lambda s, e: s + e["value"] - F.greatest(F.lit(0), F.col("committed")[e["key"]])
    )
    usable = (F.col("status") == "available") & _all_parts(partitions) & same & possible
    return snaps.withColumn("lag", F.when(usable, lag))


def caught_up(snaps: DataFrame) -> DataFrame:
    """Whether every partition is committed to its end; an empty one may have no commit."""
    def done(e: Column) -> Column:
        c = F.col("committed")[e["key"]]
        empty = (e["value"] == 0) & (c.isNull() | (c == -1))
        return (e["value"] >= 0) & (empty | F.coalesce(c == e["value"], F.lit(False)))

    return snaps.withColumn("caught_up", (F.size("end") > 0) & F.forall(_ends(), done))


def progress(end: DataFrame, committed: DataFrame) -> DataFrame:
    """Per partition: end, committed (NULL if none) and the records between."""
    return end.join(committed, "part", "left").withColumn(
        "behind", F.col("end_off") - F.greatest(F.lit(0), F.coalesce("committed_off", F.lit(0)))
    )


def segments(log: DataFrame, batch_size: int) -> DataFrame:
    """Write batches of an ordered log: poison stands alone and closes the batch before it.

    (part, first_off, last_off, records, kind). A batch also closes at ``batch_size``.
    A partition may hold any share of the log: positions come from running counts.
    """
    good = F.col("valid").cast("bigint")
    at = running(log, ["part"], "off", sums={"poison": 1 - good, "good": good}, unique=True, keep=["valid"])
    # Good records before the latest poison record: where the current run of batches starts counting.
    j = running(at, ["part"], "off", maxes={"base": F.when(~F.col("valid"), F.col("good"))}, unique=True, keep=["valid", "poison", "good"])
    chunk = F.floor((F.col("good") - F.coalesce("base", F.lit(0)) - 1) / batch_size)
    j = j.withColumn("chunk", F.when(F.col("valid"), chunk).otherwise(F.lit(-1)))
    return j.groupBy("part", "poison", "chunk").agg(
        F.min("off").alias("first_off"), F.max("off").alias("last_off"), F.count(F.lit(1)).alias("records"),
        F.when(F.min("valid"), "store").otherwise("quarantine").alias("kind"),
    ).drop("poison", "chunk")
