"""The outbox ledger: order admission, dispatch results and their current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.text import bounded_text

MAX_DISPATCH = 100


def order_input_valid(order_id: Column, amount_cents: Column) -> Column:
    """Order id of 1 to 128 bytes without NUL, amount a non-negative BIGINT."""
    return bounded_text(order_id) & F.coalesce(amount_cents >= 0, F.lit(False))


def admit_orders(requests: DataFrame, order_cols=("attempt",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, outbox, conflicts). The first request of an order fixes its amount and event.

    A later request with the same amount is answered with the first event; with
    another amount it is a conflict. Orders and outbox rows come from one DataFrame,
    so neither exists without the other.
    """
    w = Window.partitionBy("order_id").orderBy(*order_cols)
    first = requests.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    orders = first.select("order_id", "amount_cents", F.concat(F.lit("ev-"), F.col("order_id").cast("string")).alias("event_id"))
    outbox = orders.select(
        "event_id", "order_id",
        F.to_json(F.struct("order_id", "amount_cents")).alias("body"),
        F.lit("pending").alias("state"), F.lit(0).cast("bigint").alias("attempts"),
        F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("acknowledged_at"),
    )
    known = orders.select("order_id", F.col("amount_cents").alias("first_amount"), "event_id")
    conflicts = requests.join(known, "order_id").where("amount_cents <> first_amount")
    return orders, outbox, conflicts


def dispatch_outcome(status: Column, exact_ids: Column) -> tuple[Column, Column]:
    """(state, error) of one dispatch: exact ordered IDs acknowledge; 400 and 413 reject; all else stays pending."""
    acknowledged = (status == 202) & exact_ids
    known = F.when((status >= 100) & (status <= 599) & ~((status == 202) & ~exact_ids), status)
    state = F.when(acknowledged, "acknowledged").when(status.isin(400, 413), "rejected").otherwise("pending")
    error = F.when(F.coalesce(acknowledged, F.lit(False)), F.lit(None)).otherwise(
        F.coalesce(F.concat(F.lit("http_"), known.cast("string")), F.lit("delivery_uncertain"))
    )
    return state, error


def outbox_state(feed: DataFrame) -> DataFrame:
    """Latest state per event from its change feed; every change after the first is an attempt."""
    return feed.groupBy("event_id").agg(
        F.max_by("state", "seq").alias("state"),
        F.max_by(F.struct("error"), "seq").getField("error").alias("last_error"),
        F.count_if(F.col("seq") > 0).alias("attempts"),
    )


def apply_dispatch(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """Outbox after a dispatch: only pending rows change, each attempted row counts one attempt."""
    r = results.select("event_id", F.col("state").alias("__state"), F.col("error").alias("__error"), F.col("at").alias("__at"))
    hit = (F.col("state") == "pending") & F.col("__state").isNotNull()
    j = outbox.join(r, "event_id", "left")
    cols = {
        "state": F.when(hit, F.col("__state")).otherwise(F.col("state")),
        "attempts": F.col("attempts") + F.when(hit, 1).otherwise(0),
        "last_error": F.when(hit, F.col("__error")).otherwise(F.col("last_error")),
        "acknowledged_at": F.when(hit & (F.col("__state") == "acknowledged"), F.col("__at")).otherwise(F.col("acknowledged_at")),
    }
    # Acknowledged time is reset by every applied result, as the row update sets all four fields.
    cols["acknowledged_at"] = F.when(hit & (F.col("__state") != "acknowledged"), F.lit(None)).otherwise(cols["acknowledged_at"])
    return j.select(*[cols.get(c, F.col(c)).alias(c) for c in outbox.columns])


def dispatch_summary(dispatches: DataFrame, by: list[str]) -> DataFrame:
    """Attempted, acknowledged, rejected and still pending rows, with the outcome's error."""
    return dispatches.groupBy(*by).agg(
        F.count_if(F.col("attempted")).alias("attempted"),
        F.count_if(F.col("attempted") & (F.col("state") == "acknowledged")).alias("acknowledged"),
        F.count_if(F.col("attempted") & (F.col("state") == "rejected")).alias("rejected"),
        F.count_if(F.col("state") == "pending").alias("pending"),
        F.max(F.when(F.col("attempted"), F.col("error"))).alias("error"),
    )


def outbox_status(outbox: DataFrame) -> DataFrame:
    """One row per state, zero included."""
    counts = outbox.groupBy().agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "acknowledged", "rejected")])
    return counts.selectExpr("stack(3, 'pending', pending, 'acknowledged', acknowledged, 'rejected', rejected) AS (state, n)")


def next_pending(outbox: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The oldest pending rows for one dispatch."""
    if not 1 <= n <= MAX_DISPATCH:
        raise ValueError(f"n must be 1..{MAX_DISPATCH}")
    return outbox.where("state = 'pending'").orderBy(order).limit(n)


def first_issues(outbox: DataFrame, order: str = "seq") -> DataFrame:
    """The first hundred rows that carry an error, in insertion order."""
    return outbox.where("last_error IS NOT NULL").orderBy(order).limit(MAX_DISPATCH)
