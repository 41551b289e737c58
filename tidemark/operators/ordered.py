"""Running totals, maxima and previous values over long ordered series.

A plain ``Window.partitionBy(run).orderBy(time)`` sends a whole run to one task.
Here the order column (BIGINT) is read as digits of ``RADIX_BITS`` bits. Each
level sums the level below, so every window partition holds at most
``2**RADIX_BITS`` rows whatever the run's size, and three levels cover any
BIGINT. Rows with the same order value are merged first, which also makes ties
inclusive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

RADIX_BITS = 20


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on equally named keys where NULL equals NULL; keeps the left keys."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    before_maxes: Mapping[str, Column] | None = None,
    unique: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per (keys, order) with running aggregates up to that order value.

    ``sums`` and ``maxes`` include the row's own order value; ``before_maxes``
    cover strictly smaller ones. The maximum of ``struct(order, value)`` is the
    latest value, so ``before_maxes`` also serves as ``lag``. Set ``unique`` when
    (keys, order) identifies a row, to save the merge of ties; then columns in ``keep``
    come along, which saves a join back.
    """
    if keep and not unique:
        raise ValueError("rows of one order value are merged: their other columns can't be kept")
    sums, maxes, before = dict(sums or {}), dict(maxes or {}), dict(before_maxes or {})
    keys = list(keys)
    measures = {**{n: F.sum for n in sums}, **{n: F.max for n in maxes}, **{n: F.max for n in before}}
    exprs = {**sums, **maxes, **before}

    keep = list(keep)
    base = df.select(*keys, order, *keep, *[c.alias(n) for n, c in exprs.items()])
    if not unique:
        base = base.groupBy(*keys, order).agg(*[f(n).alias(n) for n, f in measures.items()])

    def coarser(d: DataFrame, col: str, out: str) -> DataFrame:
        up = d.withColumn(out, F.shiftright(F.col(col), RADIX_BITS))
        return up.groupBy(*keys, out).agg(*[f(n).alias(n) for n, f in measures.items()])

    level1 = coarser(base, order, "__b1")
    level2 = coarser(level1, "__b1", "__b2")

    def earlier(d: DataFrame, part: list[str], col: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
        return d.select(*part, col, *[f(n).over(w).alias(n) for n, f in measures.items()])

    def combine(n: str, a: Column, b: Column) -> Column:
        if measures[n] is F.sum:
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.greatest(a, b)

    def add_carry(d: DataFrame, carry: DataFrame, part: list[str], rest: list[str]) -> DataFrame:
        carry = carry.select(*part, *[F.col(n).alias(f"__c_{n}") for n in measures])
        joined = join_nullsafe(d, carry, part, "left")
        return joined.select(*rest, *[combine(n, F.col(n), F.col(f"__c_{n}")).alias(n) for n in measures])

    carry2 = earlier(level2, keys, "__b2")
    inside1 = earlier(level1.withColumn("__b2", F.shiftright("__b1", RADIX_BITS)), keys + ["__b2"], "__b1")
    carry1 = add_carry(inside1, carry2, keys + ["__b2"], keys + ["__b1"])

    part0 = keys + ["__b1"]
    upto = Window.partitionBy(*part0).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    under = Window.partitionBy(*part0).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside0 = base.withColumn("__b1", F.shiftright(F.col(order), RADIX_BITS)).select(
        *part0,
        order,
        *keep,
        *[measures[n](n).over(under if n in before else upto).alias(n) for n in measures],
    )
    return add_carry(inside0, carry1, part0, keys + [order] + keep)


def prefix_sum(df: DataFrame, run: str, t: str, v: str) -> DataFrame:
    """Cumulative ``v`` by ``t`` within each ``run``; equal times share one row."""
    return running(df, [run], t, sums={"total": F.col(v)})
