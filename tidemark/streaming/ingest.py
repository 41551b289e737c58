"""Streams over the log: ingest, bounded dedupe, pending observation and live counters."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException, PySparkTypeError, PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.store import merge_first_wins
from tidemark.operators.tenancy import WRITER_POLICY
from tidemark.operators.validation import validate_events
from tidemark.sources.sink import BUCKETS, quarantine_rows, write_batch
from tidemark.streaming.stateful import first_within, observed_stream


#: Read what is there and stop. Give ``{"processingTime": "5 seconds"}`` for a stream that keeps running.
DRAIN = {"availableNow": True}
#: Retry waits of the storage writer, and how long one attempt may take before its jobs are cancelled.
STORAGE_POLICY = {**WRITER_POLICY, "attempt_ms": 600_000}
#: What no second attempt can mend: wrong plans, arguments and rights.
PERMANENT = (AnalysisException, ParseException, IllegalArgumentException, PySparkTypeError, PySparkValueError, TypeError, ValueError, KeyError, PermissionError)


class AttemptTimeout(Exception):
    """An attempt was cancelled at its deadline."""


def _attempt(work: Callable[[], dict | None], spark: SparkSession | None, attempt_ms: int | None) -> dict | None:
    """Run ``work``; at the deadline all Spark jobs that it has started and starts are cancelled."""
    if spark is None or attempt_ms is None:
        return work()
    tag, over = f"attempt-{uuid.uuid4().hex}", threading.Event()
    done = threading.Event()

    def cancel() -> None:
        if done.wait(attempt_ms / 1000):
            return
        over.set()
        while not done.wait(0.05):  # a job may begin after the first call
            context.cancelJobsWithTag(tag)

    context = spark.sparkContext
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)  # also a task that waits for its Python worker ends
    watch = threading.Thread(target=cancel, daemon=True)
    watch.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise AttemptTimeout(f"no result within {attempt_ms} ms") from e
        raise
    finally:
        done.set()
        watch.join()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)


def with_retries(
    work: Callable[[], dict | None], policy: dict = WRITER_POLICY, sleep=time.sleep, clock=time.monotonic,
    spark: SparkSession | None = None, on_retry: Callable[[Exception], None] | None = None,
) -> dict | None:
    """Run a batch write again after a failure, waiting longer each time, within the policy's window.

    With ``spark`` an attempt is cancelled after the policy's ``attempt_ms`` and may be tried again. Errors that can never succeed (``PERMANENT``) are
    raised at once. When the window is used up the last error is raised: the batch fails, the stream stops, and its progress
    stays where it was.
    """
    start, wait = clock(), policy["min_ms"] / 1000
    while True:
        try:
            return _attempt(work, spark, policy.get("attempt_ms"))
        except PERMANENT:
            raise
        except Exception as e:
            if clock() - start + wait > policy["window_ms"] / 1000:
                raise
            if on_retry is not None:
                on_retry(e)
            sleep(wait)
            wait = min(wait * 2, policy["max_ms"] / 1000)


def start_ingest(
    spark: SparkSession,
    source: DataFrame,
    table: str,
    quarantine: str,
    checkpoint: str,
    metrics: str | None = None,
    dedupe_horizon: str | None = None,
    after_write: Callable[[int], None] | None = None,
    policy: dict = STORAGE_POLICY,
    trigger: dict = DRAIN,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Log stream to table and quarantine; progress is saved only after both are written.

    ``buckets`` is the number of key index buckets of a table that does not exist yet. With ``dedupe_horizon`` repeats are told by bounded state
    instead of by the table: cheaper, but a repeat later than the horizon is stored again, and a row that comes later than the horizon
    after the newest one is dropped by the watermark. ``metrics`` gets one row for each batch.
    ``after_write`` runs between the write and the saved progress.
    """
    write = _store if dedupe_horizon is None else _store_first
    rows = source if dedupe_horizon is None else first_within(validate_events(source, "value", kind="envelope"), dedupe_horizon)

    def store(batch: DataFrame, batch_id: int) -> None:
        began, retries = time.monotonic(), []
        result = with_retries(lambda: write(batch, batch_id, table, quarantine, buckets), policy, spark=batch.sparkSession, on_retry=retries.append)
        if metrics is not None:
            result = {**result, "retries": len(retries), "elapsed_ms": int(1000 * (time.monotonic() - began))}
            row = spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in result.items() if k != "batch_id"])
            row.write.mode("overwrite").parquet(f"{metrics}/batch_id={batch_id}")
        if after_write is not None:
            after_write(batch_id)

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _store(batch: DataFrame, batch_id: int, table: str, quarantine: str, buckets: int) -> dict:
    return write_batch(batch, batch_id, table, quarantine, buckets)


def _store_first(batch: DataFrame, batch_id: int, table: str, quarantine: str, buckets: int) -> dict:
    """Poison to the quarantine and first contents to plain folders, whole ones each, so a replay changes nothing."""
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        quarantine_rows(batch.where("kind = 'poison'")).write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
        first = batch.where("kind = 'first'")
        first.select("tenant_id", "event_id", "event_type", "occurred_at", "received_at", "payload").write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        n = batch.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("copies"))), F.lit(0)).alias(k) for k in ("first", "repeat", "poison"))).first()
    finally:
        batch.unpersist()
    return {"batch_id": batch_id, "rows": n["first"] + n["repeat"], "inserted": n["first"], "duplicates": n["repeat"], "quarantined": n["poison"]}


def replay_gap(log: DataFrame, table: DataFrame, order_cols=("part", "off")) -> DataFrame:
    """A restored table after a read of the whole log from its start; what it held stays."""
    return merge_first_wins(table, log, order_cols=order_cols)


def start_observer(
    spark: SparkSession, stored: DataFrame, pending: DataFrame, out: str, checkpoint: str, keys=("event_id",), trigger: dict = DRAIN, pages: int | None = None
) -> StreamingQuery:
    """Record, batch by batch, which pending IDs have become visible; each is recorded once.

    The IDs still pending are the stream's state, set up from ``pending`` when it first starts and shrinking from then on, so a batch reads its own
    rows and their state, never earlier output. ``out/batch_id=N`` holds the IDs first seen in batch N. With ``pages`` IDs share so many states.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("observed_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    seen = observed_stream(stored, pending, list(keys), pages)
    return seen.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(**trigger).start()


# Upper bounds, in seconds, of the receipt-to-storage histogram.
RECEIPT_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10, 30, 60)


def bucket_name(bound: float) -> str:
    """``le_0_25`` for 0.25."""
    return f"le_{bound}".replace(".", "_")


def histogram(value: str, bounds=RECEIPT_BOUNDS) -> list:
    """Cumulative bucket counts of a column; a value on a bound belongs to it, one above all bounds only to the total count."""
    return [F.count_if(F.col(value) <= b).alias(bucket_name(b)) for b in bounds]


def start_counters(stream: DataFrame, by: list[str], out: str, checkpoint: str, aggregates: list, trigger: dict = DRAIN) -> StreamingQuery:
    """Running counters per bounded label: every batch writes all labels it knows to ``out/version=N``."""
    counts = stream.groupBy(*by).agg(*aggregates)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return (
        counts.writeStream.outputMode("complete").foreachBatch(publish)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
