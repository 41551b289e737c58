"""Live streams with keyed state: token bucket, alert cooldown, first content within a horizon, pending IDs."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tidemark.functions.labels import OPERATION_KINDS
from tidemark.operators import folds
from tidemark.operators.folds import COOLDOWN_NS, bucket_step

# Spark first runs a processor beside the driver, where shipped packages are not on the path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(folds)

BUCKET_TTL_MS = 300_000
PAGES = 1 << 16  # of state that keys are dealt over
PENDING_PAGES = 1 << 14  # fewer, as a pending key is nothing but its name
POISON = "poison"  # begins the key of a row that is no event; event IDs are UUIDs

BUCKET_OUT = StructType([
    StructField("tenant_id", StringType()), StructField("at_ns", LongType()), StructField("request_id", LongType()),
    StructField("allowed", BooleanType()), StructField("remaining", LongType()),
])
ALERT_OUT = StructType([
    StructField("kind", StringType()), StructField("seq", LongType()), StructField("at_ns", LongType()),
    StructField("state", StringType()), StructField("suppressed", LongType()),
])


HELD_ROWS = 1_000_000  # rows of one key that are ordered in memory; more go through the state by slots of the order column
SLOT_BITS = 30  # about a second of nanoseconds


class _Ordered:
    """A key's rows of one micro-batch in order, whatever their number: ``(order, tie, value)`` of whole numbers.

    Few rows are sorted as one array. Beyond ``held`` rows the arrays go to map state, one list for each slot of the order column, and come back slot
    by slot, so memory is bounded by the rows of one slot.
    """

    SLOT = StructType([StructField("slot", LongType())])
    ROWS = StructType([StructField("rows", ArrayType(LongType()))])

    def __init__(self, slots, held: int = HELD_ROWS):
        self.slots, self.limit = slots, held
        self.parts, self.size, self.used = [], 0, set()

    def add(self, *columns) -> None:
        self.parts.append(np.stack([np.asarray(c, np.int64) for c in columns], 1))
        self.size += len(self.parts[-1])
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        rows = np.concatenate(self.parts)
        slot = rows[:, 0] >> SLOT_BITS
        for s in np.unique(slot).tolist():
            own = rows[slot == s].ravel().tolist()
            if s in self.used:
                own = list(self.slots.getValue((s,))[0]) + own
            self.slots.updateValue((s,), (own,))
            self.used.add(s)
        self.parts, self.size = [], 0

    def sorted(self) -> Iterator[np.ndarray]:
        if not self.used:
            yield self._in_order(np.concatenate(self.parts))
            return
        if self.parts:
            self._spill()
        for s in sorted(self.used):
            yield self._in_order(np.array(self.slots.getValue((s,))[0], np.int64).reshape(-1, 3))
            self.slots.removeKey((s,))

    @staticmethod
    def _in_order(rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


class BucketProcessor(StatefulProcessor):
    def __init__(self, rps: int, idle_ttl_ms: int | None, held: int = HELD_ROWS):
        self.rps = rps
        self.idle_ttl_ms = idle_ttl_ms
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("tokens", DoubleType()), StructField("last", LongType())])
        self.state = handle.getValueState("bucket", schema, ttlDurationMs=self.idle_ttl_ms)
        self.slots = handle.getMapState("slots", _Ordered.SLOT, _Ordered.ROWS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ordered = _Ordered(self.slots, self.held)
        for pdf in rows:
            ordered.add(pdf["at_ns"], pdf["request_id"], np.zeros(len(pdf)))
        tokens, last = self.state.get() if self.state.exists() else (float(self.rps), None)
        for part in ordered.sorted():
            allowed, remaining = [], []
            for now in part[:, 0].tolist():
                tokens, ok, left = bucket_step(tokens, now if last is None else last, now, self.rps)
                last = now
                allowed.append(ok)
                remaining.append(left)
            yield pd.DataFrame({"tenant_id": key[0], "at_ns": part[:, 0], "request_id": part[:, 1], "allowed": allowed, "remaining": remaining})
        self.state.update((float(tokens), last))

    def close(self) -> None:
        pass


class AlertProcessor(StatefulProcessor):
    def __init__(self, cooldown_ns: int, held: int = HELD_ROWS):
        self.cooldown_ns = cooldown_ns
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("failed", BooleanType()), StructField("last", LongType()), StructField("held", LongType())])
        self.state = handle.getValueState("alert", schema)
        self.slots = handle.getMapState("slots", _Ordered.SLOT, _Ordered.ROWS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ordered = _Ordered(self.slots, self.held)
        for pdf in rows:
            ordered.add(pdf["seq"], pdf["failed"], pdf["at_ns"])
        failing, last, held = self.state.get() if self.state.exists() else (False, 0, 0)
        for part in ordered.sorted():
            lines = []
            for seq, failed, now in part.tolist():
                if not failed:
                    if failing:
                        lines.append((key[0], seq, now, "recovered", held))
                        failing, last, held = False, 0, 0
                elif failing and now - last < self.cooldown_ns:
                    held += 1
                else:
                    lines.append((key[0], seq, now, "failed", held))
                    failing, last, held = True, now, 0
            yield pd.DataFrame(lines, columns=ALERT_OUT.fieldNames())
        self.state.update((bool(failing), int(last), int(held)))

    def close(self) -> None:
        pass


class FirstProcessor(StatefulProcessor):
    """Of a key's rows the first by log position, once within the horizon; repeats are one row with their number.

    Keys share a page of state, which is read and written once for all of its keys in a micro-batch, with one timer for the key that expires first.
    """

    PAGE = StructType([StructField("keys", ArrayType(StringType())), StructField("ms", ArrayType(LongType()))])

    def __init__(self, fields: list[str], horizon_ms: int):
        self.fields, self.horizon_ms = fields, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", self.PAGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found: dict[str, list] = {}  # first row, copies, newest receipt
        for r in rows:
            if r["__event"].startswith(POISON):
                yield self._row("poison", 1, r)
                continue
            name, newest = f"{r['__event']}:{r['__tenant']}", int(r["received_at"].timestamp() * 1000)
            seen = found.get(name)
            if seen is None:
                found[name] = [r, 1, newest]
                continue
            seen[1] += 1
            seen[2] = max(seen[2], newest)
            if (r["partition"], r["offset"]) < (seen[0]["partition"], seen[0]["offset"]):
                seen[0] = r
        if not found:
            return
        page = self._page()
        due = min(page.values(), default=None)
        for name, (first, copies, newest) in found.items():
            known, until = name in page, newest + self.horizon_ms
            page[name] = max(until, page[name]) if known else until
            if not known:
                yield self._row("first", 1, first)
            if copies > (not known):
                yield self._row("repeat", copies - (not known), None)
        self._keep(page, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        page = {name: ms for name, ms in self._page().items() if ms > now and ms >= watermark}
        if page:
            self._keep(page, None)  # the timer that went off is gone
        else:
            self.until.clear()
        return iter(())

    def _page(self) -> dict[str, int]:
        held = self.until.get()
        return dict(zip(held[0], held[1], strict=True)) if held is not None else {}

    def _keep(self, page: dict[str, int], due: int | None) -> None:
        self.until.update((list(page), list(page.values())))
        first = min(page.values())
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)

    def _row(self, kind: str, copies: int, r: Row | None) -> Row:
        return Row(kind=kind, copies=copies, **{f: r[f] if r is not None else None for f in self.fields})

    def close(self) -> None:
        pass


class PendingProcessor(StatefulProcessor):
    """Keys that wait are the state; the first stored row of one is passed on, and the key waits no longer."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", StructType([StructField("since", LongType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.waiting.update((0,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min((r["received_at"] for r in rows if r["received_at"] is not None), default=None)
        if self.waiting.exists():
            self.waiting.clear()
            yield Row(**dict(zip(self.keys, key, strict=True)), received_at=first)

    def close(self) -> None:
        pass


class PendingPageProcessor(StatefulProcessor):
    """As ``PendingProcessor``, with the waiting keys of a page as one state, which is read and written once for all of its keys in a micro-batch."""

    def __init__(self, keys: list[str], fields: list[StructField]):
        self.keys = keys
        self.page = StructType([StructField(f.name, ArrayType(f.dataType)) for f in fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", self.page)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.waiting.update(tuple(initialState[k] for k in self.keys))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first: dict[tuple, object] = {}
        for r in rows:
            name, at = tuple(r[k] for k in self.keys), r["received_at"]
            known = first.setdefault(name, at)
            if known is None or (at is not None and at < known):
                first[name] = at
        held = self.waiting.get()
        if held is None:
            return
        left = []
        for name in zip(*held, strict=True):
            if name in first:
                yield Row(**dict(zip(self.keys, name, strict=True)), received_at=first[name])
            else:
                left.append(name)
        if not left:
            self.waiting.clear()
        elif len(left) < len(held[0]):
            self.waiting.update(tuple(list(column) for column in zip(*left, strict=True)))

    def close(self) -> None:
        pass


def token_bucket_stream(requests: DataFrame, rps: int, idle_ttl_ms: int | None = BUCKET_TTL_MS, held: int = HELD_ROWS) -> DataFrame:
    """Decisions over a live stream of (tenant_id, at_ns, request_id); idle state is dropped after five minutes.

    State expiry follows the wall clock, so such a stream runs until it is stopped.
    For a bounded run pass ``idle_ttl_ms=None``: the decisions are the same, because
    a bucket is full again after one second.
    """
    return requests.groupBy("tenant_id").transformWithStateInPandas(
        BucketProcessor(rps, idle_ttl_ms, held), outputStructType=BUCKET_OUT, outputMode="Append",
        timeMode="None" if idle_ttl_ms is None else "ProcessingTime",
    )


def alert_stream(operations: DataFrame, cooldown_ns: int = COOLDOWN_NS, held: int = HELD_ROWS) -> DataFrame:
    """Alert lines over a live stream of (kind, seq, at_ns, failed)."""
    known = operations.where(F.col("kind").isin(*OPERATION_KINDS))
    return known.groupBy("kind").transformWithStateInPandas(
        AlertProcessor(cooldown_ns, held), outputStructType=ALERT_OUT, outputMode="Append", timeMode="None"
    )


def first_within(checked: DataFrame, horizon: str, pages: int = PAGES) -> DataFrame:
    """Validated log rows, each with ``kind``: ``first`` of its key within the horizon, ``repeat`` or ``poison``, and ``copies``.

    The first is the earliest by (partition, offset) of a micro-batch, whatever order its rows arrive in. State of a key is dropped once the watermark
    has passed its newest receipt time by the horizon. Poison passes the state untouched. Keys are dealt over ``pages`` of state by their hash: a stream that
    was started with another number, or by a key of its own, can't be resumed.
    """
    fields = ["topic", "partition", "offset", "key", "headers", "value", "error", "tenant_id", "event_id", "event_type", "occurred_at", "received_at", "payload"]
    place = F.concat_ws(":", F.lit(POISON), "topic", "partition", "offset")
    rows = checked.select(
        F.when(F.col("valid"), F.col("tenant_id")).otherwise("").alias("__tenant"), F.when(F.col("valid"), F.col("event_id").cast("string")).otherwise(place).alias("__event"),
        *(F.when(F.col("valid"), F.col(c)).alias(c) if c == "received_at" else F.col(c) for c in fields),
    ).withWatermark("received_at", horizon)
    out = StructType([StructField("kind", StringType()), StructField("copies", LongType()), *(StructField(f.name, f.dataType) for f in rows.select(*fields).schema)])
    horizon_ms = int(pd.Timedelta(horizon).total_seconds() * 1000)
    page = F.pmod(F.xxhash64("__tenant", "__event"), F.lit(pages))
    return rows.withColumn("__page", page).groupBy("__page").transformWithState(FirstProcessor(fields, horizon_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")


def observed_stream(stored: DataFrame, pending: DataFrame, keys: list[str], pages: int | None = None) -> DataFrame:
    """(keys, received_at) of pending keys as they become visible in the stream ``stored``, each once.

    Each pending key is a state of its own. With ``pages`` keys, which must be text, whole numbers or the like, are dealt over so many states by their
    hash: for many keys, as a state costs far more than a key in it. A stream that was started with another number can't be resumed.
    """
    out = StructType([*(stored.schema[k] for k in keys), stored.schema["received_at"]])
    rows, waiting = stored.select(*keys, "received_at"), pending.select(*keys).dropna()
    if pages is None:
        by, processor, initial = keys, PendingProcessor(keys), waiting.distinct().groupBy(*keys)
    else:
        page = F.pmod(F.xxhash64(*keys), F.lit(pages)).alias("__page")
        by, processor, rows = ["__page"], PendingPageProcessor(keys, [stored.schema[k] for k in keys]), rows.select("*", page)
        names = waiting.select("*", page).groupBy("__page").agg(F.collect_set(F.struct(*keys)).alias("__names"))
        initial = names.select("__page", *[F.col(f"__names.{k}").alias(k) for k in keys]).groupBy("__page")
    return rows.groupBy(*by).transformWithState(processor, outputStructType=out, outputMode="Append", timeMode="None", initialState=initial)
