"""API keys, delivery outcomes and retries of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.text import bounded_text
from tidemark.operators.ordered import running


def resolve_tenant(requests: DataFrame, keys: DataFrame, header: str = "authorization") -> DataFrame:
    """Adds ``tenant_id`` and ``auth``: ok, missing header or invalid key (both 401).

    The key table is small in practice, but nothing here assumes it: Spark
    broadcasts it only below its own size threshold.
    """
    known = keys.select(F.col("api_key").alias("__key"), "tenant_id")
    j = requests.withColumn("__k", labels.bearer_key(F.col(header))).join(known, F.col("__k") == F.col("__key"), "left")
    auth = (
        F.when(F.coalesce(F.col(header), F.lit("")) == "", "missing")
        .when(F.col("tenant_id").isNull(), "invalid")
        .otherwise("ok")
    )
    return j.withColumn("auth", auth).withColumn("tenant_id", F.when(auth == "ok", F.col("tenant_id"))).drop("__k", "__key")


def key_map_faults(keys: DataFrame) -> DataFrame:
    """Faults of a key-to-tenant mapping: repeated or empty keys, unusable tenants."""
    g = keys.groupBy("api_key").agg(F.count(F.lit(1)).alias("copies"), F.min(bounded_text(F.col("tenant_id"))).alias("tenant_ok"))
    fault = (
        F.when(F.col("copies") > 1, "duplicate")
        .when(F.coalesce(F.col("api_key"), F.lit("")) == "", "empty_key")
        .when(~F.col("tenant_ok"), "tenant")
    )
    return g.select("api_key", fault.alias("fault")).where("fault IS NOT NULL")


def classify_delivery(requests: DataFrame) -> DataFrame:
    """Adds ``outcome`` from ``status``, ``transport_error`` and the ordered ID lists sent and returned."""
    same = F.col("returned_ids") == F.col("sent_ids")
    return requests.withColumn("outcome", labels.delivery(F.col("status"), F.col("transport_error"), same))


def classify_retry(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("retryable", labels.retryable(F.col("status"), F.col("failure")))


# Delays and window of the storage writer, delays and attempts of the client.
WRITER_POLICY = {"min_ms": 100, "max_ms": 2000, "window_ms": 15000, "attempts": None}
CLIENT_POLICY = {"min_ms": 100, "max_ms": 200, "window_ms": None, "attempts": 3}


def retry_audit(attempts: DataFrame, policy: dict) -> DataFrame:
    """Per attempt: its number, the delay due after it and whether the item is then exhausted.

    ``attempts`` has (item, at_ms). Delays double from ``min_ms`` up to ``max_ms``.
    An item is exhausted when its waiting passes the window or its attempts run out.
    """
    n = running(attempts, ["item"], "at_ms", sums={"attempt": F.lit(1)})
    num = F.col("attempt")
    cap, low = policy["max_ms"], policy["min_ms"]
    doubled = F.least(F.lit(cap), (F.lit(low) * F.pow(F.lit(2), F.least(num - 1, F.lit(40)))).cast("bigint"))
    # Doublings before the cap, then a constant: the total wait needs no second pass.
    ramp = 0
    while low * 2**ramp < cap:
        ramp += 1
    short = F.least(num, F.lit(ramp)).cast("bigint")
    waited = (F.lit(low) * (F.pow(F.lit(2), short) - 1)).cast("bigint") + F.greatest(num - ramp, F.lit(0)) * cap
    over = F.lit(False)
    if policy["window_ms"] is not None:
        over = over | (waited > policy["window_ms"])
    if policy["attempts"] is not None:
        over = over | (num >= policy["attempts"])
    return n.select("item", "at_ms", "attempt", doubled.alias("delay_ms"), waited.alias("waited_ms"), over.alias("exhausted"))
