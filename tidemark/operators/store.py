"""First-write-wins storage: the batch form of an insert that ignores conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

EVENT_KEY = ("tenant_id", "event_id")


def first_wins(df: DataFrame, keys: Sequence[str] = EVENT_KEY, order_cols: Sequence[str] = ("part", "off")) -> DataFrame:
    """The first row of each key. Spark limits each key before the shuffle, so many
    copies of one key never meet in one task."""
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def insert_if_absent(staged: DataFrame, existing: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Rows of ``staged`` whose key is not stored. ``existing`` is read for its keys only."""
    return staged.join(existing.select(*keys), list(keys), "left_anti")


def merge_first_wins(
    existing: DataFrame, staged: DataFrame, keys: Sequence[str] = EVENT_KEY, order_cols: Sequence[str] = ("part", "off")
) -> DataFrame:
    """The table after a whole staged load: what was stored stays, new keys get their first row."""
    fresh = insert_if_absent(first_wins(staged, keys, order_cols), existing, keys)
    return existing.unionByName(fresh.select(*existing.columns))


def write_accounting(batches: DataFrame, keys: Sequence[str], batch: str, order_cols: Sequence[str]) -> DataFrame:
    """Rows, inserted and duplicates of each batch when batches are stored in order.

    A key is inserted by the earliest batch that holds it; every other row of it is a duplicate.
    """
    firsts = first_wins(batches.select(*keys, batch, *order_cols), keys, [batch, *order_cols])
    inserted = firsts.groupBy(batch).agg(F.count(F.lit(1)).alias("inserted"))
    rows = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(inserted, batch, "left").select(
        batch,
        "rows",
        F.coalesce("inserted", F.lit(0)).alias("inserted"),
        (F.col("rows") - F.coalesce("inserted", F.lit(0))).alias("duplicates"),
    )


def events_by_type(table: DataFrame, tenant: str) -> DataFrame:
    return table.where(F.col("tenant_id") == tenant).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def tenant_summary(table: DataFrame, persisted: str = "persisted_at") -> DataFrame:
    return table.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.max(persisted).alias("latest"))


def tenant_events(table: DataFrame, tenant: str) -> DataFrame:
    """A tenant's events in a fixed order, cheap to read when the table is stored by tenant."""
    return table.where(F.col("tenant_id") == tenant).orderBy("occurred_at", "event_id")


def latest(table: DataFrame, n: int, by: str = "persisted_at", tie: str = "event_id") -> DataFrame:
    """Top n by time; Spark keeps n rows per task and never sorts the table."""
    return table.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n)


def purge(table: DataFrame, cutoff, column: str = "received_at") -> DataFrame:
    """What the table keeps under a retention cut-off. A date partition column prunes the scan."""
    return table.where(F.col(column) >= cutoff)


def lost_ranges(committed: DataFrame, earliest: DataFrame, partition: str = "part") -> DataFrame:
    """Offsets a consumer can no longer read: its next position up to the earliest kept one."""
    j = committed.join(earliest, partition)
    return j.where(F.col("earliest_off") > F.greatest(F.col("committed_off"), F.lit(0))).select(
        partition,
        F.greatest(F.col("committed_off"), F.lit(0)).alias("first_lost"),
        (F.col("earliest_off") - 1).alias("last_lost"),
        (F.col("earliest_off") - F.greatest(F.col("committed_off"), F.lit(0))).alias("lost"),
    )


def snapshot_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys on one side only and keys whose content differs; NULL equals NULL.

    Both sides are tagged and grouped by key once. ``copies_a``/``copies_b`` show repeats.
    """
    def tagged(d: DataFrame, side: str) -> DataFrame:
        text = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
        return d.select(*keys, F.lit(side).alias("side"), F.sha2(text, 256).alias("h"))

    both = tagged(a, "a").unionByName(tagged(b, "b"))
    in_a, in_b = F.col("side") == "a", F.col("side") == "b"
    g = both.groupBy(*keys).agg(
        F.count_if(in_a).alias("copies_a"),
        F.count_if(in_b).alias("copies_b"),
        F.min("h").alias("low"),
        F.max("h").alias("high"),
    )
    state = (
        F.when(F.col("copies_b") == 0, "only_a")
        .when(F.col("copies_a") == 0, "only_b")
        .when(F.col("low") != F.col("high"), "content")
        .when(F.col("copies_a") != F.col("copies_b"), "copies")
    )
    return g.select(*keys, state.alias("difference")).where("difference IS NOT NULL")
