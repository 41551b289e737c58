"""Per-key stateful decisions over ordered operations: token bucket, alert cooldown, health.

The bucket and the cooldown are sequential by definition, but their state is
known at some rows whatever came before. Keys are cut there, so one hot tenant or
operation kind becomes many independent pieces, each folded by one task in
constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import OPERATION_KINDS
from tidemark.operators.ordered import join_nullsafe, running

SECOND_NS = 1_000_000_000
BUCKET_TTL_NS = 300 * SECOND_NS
COOLDOWN_NS = 10 * SECOND_NS


def bucket_step(tokens: float, last: int, now: int, rps: int) -> tuple[float, bool, int]:
    """(tokens after, allowed, remaining) of one request: refill, cap at ``rps``, take one."""
    tokens = min(float(rps), tokens + (now - last) / SECOND_NS * rps)
    if tokens >= 1:
        return tokens - 1, True, int(tokens - 1)
    return tokens, False, 0


def _fold_bucket(rps: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, float(rps), 0
        for pdf in batches:
            allowed = np.empty(len(pdf), dtype=bool)
            remaining = np.empty(len(pdf), dtype=np.int64)
            rows = zip(pdf["tenant_id"], pdf["piece"], pdf["at_ns"].to_numpy(), strict=True)
            for i, (tenant, piece, now) in enumerate(rows):
                now = int(now)
                if key != (tenant, piece):
                    key, tokens, last = (tenant, piece), float(rps), now
                tokens, allowed[i], remaining[i] = bucket_step(tokens, last, now, rps)
                last = now
            yield pdf.drop(columns=["piece"]).assign(allowed=allowed, remaining=remaining)

    return fold


def token_bucket(requests: DataFrame, rps: int) -> DataFrame:
    """Decision and remaining tokens of each request (tenant_id, at_ns, request_id).

    After a pause of a second the bucket is full again, whatever it held, so a
    tenant is cut at such pauses. (The idle eviction after five minutes falls into
    that rule.) Requests at one instant are taken in ``request_id`` order. A tenant
    that never pauses stays one piece: that chain is sequential in itself.
    """
    r = requests.select("tenant_id", "at_ns", "request_id")
    prev = running(r, ["tenant_id"], "at_ns", sums={"n": F.lit(1)}, before_maxes={"prev": F.col("at_ns")})
    starts = prev.select(
        "tenant_id", "at_ns",
        F.when(F.col("prev").isNull() | (F.col("at_ns") - F.col("prev") >= SECOND_NS), F.col("at_ns")).alias("start"),
    )
    pieces = running(starts, ["tenant_id"], "at_ns", maxes={"piece": F.col("start")}, unique=True)
    cut = join_nullsafe(r, pieces, ["tenant_id", "at_ns"], "inner")
    cut = cut.repartition(F.col("tenant_id"), F.col("piece")).sortWithinPartitions("tenant_id", "piece", "at_ns", "request_id")
    schema = "tenant_id string, at_ns bigint, request_id bigint, allowed boolean, remaining bigint"
    return cut.mapInPandas(_fold_bucket(rps), schema)


def _fold_cooldown(cooldown_ns: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            rows = zip(pdf["kind"], pdf["piece"], pdf["at_ns"].to_numpy(), strict=True)
            for i, (kind, piece, now) in enumerate(rows):
                if key != (kind, piece) or now - last >= cooldown_ns:
                    keep[i] = True
                    key, last = (kind, piece), now
            yield pdf.loc[keep, ["kind", "seq", "at_ns", "failures"]]

    return fold


def alert_cooldown(operations: DataFrame, cooldown_ns: int = COOLDOWN_NS) -> DataFrame:
    """Alert lines (kind, seq, at_ns, state, suppressed) of an operation log (kind, seq, at_ns, failed).

    The first failure of an episode is reported; later ones within the cooldown of
    the last report are counted; a success ends the episode with one ``recovered``
    line. A failure is surely reported after a success or after a pause of the
    cooldown since the failure before it, so kinds are cut there.
    """
    ops = operations.where(F.col("kind").isin(*OPERATION_KINDS)).select("kind", "seq", "at_ns", "failed")
    failure = F.col("failed").cast("bigint")
    now = F.struct("seq", "failed", "at_ns")
    line = running(ops, ["kind"], "seq", sums={"failures": failure}, before_maxes={"prev": now}, unique=True, keep=["failed", "at_ns"])
    after_failure = F.coalesce(F.col("prev.failed"), F.lit(False))
    sure = F.col("failed") & (~after_failure | (F.col("at_ns") - F.col("prev.at_ns") >= cooldown_ns))
    line = line.select("kind", "seq", "at_ns", "failed", "failures", after_failure.alias("after_failure"), F.when(sure, F.col("seq")).alias("start"))
    kept = ["at_ns", "failed", "failures", "after_failure"]
    line = running(line, ["kind"], "seq", maxes={"piece": F.col("start")}, unique=True, keep=kept)
    failed = line.where("failed").select("kind", "seq", "at_ns", "failures", "piece")
    ordered = failed.repartition(F.col("kind"), F.col("piece")).sortWithinPartitions("kind", "piece", "seq")
    reported = ordered.mapInPandas(_fold_cooldown(cooldown_ns), "kind string, seq bigint, at_ns bigint, failures bigint").withColumn("failed", F.lit(True))
    lines = reported.unionByName(line.where("NOT failed AND after_failure").select("kind", "seq", "at_ns", "failures", "failed"))
    # Failures since the line before: between two reports all but the new one, before a recovery all of them.
    out = running(lines, ["kind"], "seq", before_maxes={"prior": F.struct("seq", "failures", "failed")}, unique=True, keep=["at_ns", "failures", "failed"])
    gap = F.col("failures") - F.col("failed").cast("bigint") - F.col("prior.failures")
    within = F.coalesce(F.col("prior.failed"), F.lit(False))
    return out.select(
        "kind", "seq", "at_ns", F.when(F.col("failed"), "failed").otherwise("recovered").alias("state"),
        F.when(within, gap).otherwise(F.lit(0)).cast("bigint").alias("suppressed"),
    )


def health(operations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ready when no operation's latest result is a failure."""
    by = list(by)
    latest = operations.groupBy(*by, "kind").agg(F.max_by("failed", "seq").alias("failed"))
    return latest.groupBy(*by).agg(
        (~F.bool_or("failed")).alias("ready"), F.count_if("failed").alias("failed_kinds")
    )


def health_timeline(operations: DataFrame, kinds: Sequence[str] = OPERATION_KINDS) -> DataFrame:
    """Ready flag after each operation of the whole log, in ``seq`` order."""
    def result(k: str) -> Column:
        return F.when(F.col("kind") == k, F.struct("seq", "failed"))

    line = running(operations, [], "seq", maxes={f"k_{i}": result(k) for i, k in enumerate(kinds)}, unique=True)
    failed = sum((F.coalesce(F.col(f"k_{i}.failed"), F.lit(False)).cast("bigint") for i in range(len(kinds))), F.lit(0).cast("bigint"))
    return line.select("seq", failed.alias("failed_kinds")).withColumn("ready", F.col("failed_kinds") == 0)
