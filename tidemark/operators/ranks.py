"""Exact order statistics without gathering a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.ordered import join_nullsafe

# Slices per unit of ln(value): neighbouring slices differ by 1/16384, so a
# BIGINT column has fewer than 720,000 of them per sign.
SLICES = 16384


def slice_of(value: Column) -> Column:
    """A non-decreasing BIGINT function of a number (Math.log1p is semi-monotonic)."""
    size = F.floor(F.log1p(F.abs(value.cast("double"))) * F.lit(float(SLICES)))
    return (F.when(value < 0, -size).otherwise(size)).cast("bigint")


def select_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per group: the values at the given 1-based ranks, and the row count ``n``.

    A rank is an expression over ``n``. Rows are first merged to (group, value,
    count), which combines before the shuffle and spreads a hot group by value.
    Slice counts locate each rank; only the rows of the located slice are ordered.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__s", slice_of(F.col("__v")))
    )
    slices = counts.groupBy(*by, "__s").agg(F.sum("__c").alias("__c"))
    ahead = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    slices = slices.select(
        *by,
        "__s",
        F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__before"),
        F.col("__c").alias("__in"),
        F.sum("__c").over(whole).alias("n"),
    )
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()])
    targets = (
        slices.withColumn(
            "__want",
            F.filter(wanted, lambda w: (w["rank"] > F.col("__before")) & (w["rank"] <= F.col("__before") + F.col("__in"))),
        )
        .where(F.size("__want") > 0)
        .drop("__in")
    )
    hits = join_nullsafe(counts, targets, by + ["__s"], "inner")
    upto = Window.partitionBy(*by, "__s").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("__last", F.col("__before") + F.sum("__c").over(upto))
    picked = hits.select(*by, "n", "__v", F.col("__last"), (F.col("__last") - F.col("__c")).alias("__first"), F.explode("__want").alias("w"))
    picked = picked.where((F.col("w.rank") > F.col("__first")) & (F.col("w.rank") <= F.col("__last")))
    return picked.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("w.name") == k, F.col("__v"))).alias(k) for k in ranks],
    )


def nearest_rank(df: DataFrame, value: str, by: Sequence[str], ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, no interpolation: the value at ceil(n*p), at least the first.

    Groups without a value get 0, not NULL.
    """
    by = list(by)
    found = select_ranks(
        df, by, value, {k: F.greatest(F.lit(1), F.ceil(F.col("n").cast("double") * F.lit(p))) for k, p in ps.items()}
    )
    if not by:
        one = found.groupBy().agg(F.max("n").alias("n"), *[F.max(k).alias(k) for k in ps])
        return one.select(F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(k, F.lit(0)).alias(k) for k in ps])
    groups = df.select(*by).distinct()
    out = join_nullsafe(groups, found, by, "left")
    return out.select(*by, F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(k, F.lit(0)).alias(k) for k in ps])


def upper_median(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """The element at zero-based index n/2 of the sorted values."""
    return select_ranks(df, by, value, {out: F.floor(F.col("n") / 2) + 1}).select(*by, out)
