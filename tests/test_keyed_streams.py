"""Streams whose state is carried from batch to batch and over restarts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_ingest import UUIDS, run, value, write_log
from tests.test_sink import batch, doc, uid
from tidemark.operators import folds
from tidemark.session import ROCKSDB_PROVIDER
from tidemark.sources import feed, sink
from tidemark.streaming import ingest, stateful


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # state stores cost more than these few rows
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def written(spark, path, parts):
    for rows, schema in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drained(stream, path, limit=None):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]


@pytest.mark.parametrize("held", [1_000_000, 3])
def test_bucket_stream_equals_the_fold(spark, tmp_path, held):
    """Also when all rows of a key go through the state, slot by slot."""
    rng = random.Random(2)
    at, rows = 0, []
    for i in range(400):
        at += rng.choice([0, 10_000_000, 300_000_000, 2_000_000_000])
        rows.append((f"t{rng.randrange(3)}", at, i))
    schema = "tenant_id string, at_ns long, request_id long"
    cuts = [0, 90, 200, 310, 400]
    shuffled = [rng.sample(rows[a:b], b - a) for a, b in zip(cuts, cuts[1:])]
    # no instant may lie in two files
    shuffled = [[r for r in part if n == len(shuffled) - 1 or r[1] < min(x[1] for x in shuffled[n + 1])] for n, part in enumerate(shuffled)]
    written(spark, f"{tmp_path}/in", [(p, schema) for p in shuffled])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert drained(stateful.token_bucket_stream(stream, 2, None, held), tmp_path) == [len(p) for p in shuffled]
    whole = spark.createDataFrame([r for p in shuffled for r in p], schema)
    want = folds.token_bucket(whole, 2)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want.collect())
    state = spark.read.format("statestore").option("stateVarName", "bucket").load(f"{tmp_path}/ckpt")
    last = {t: max(a for x, a, _ in sum(shuffled, []) if x == t) for t in {r[0] for r in rows}}
    assert {r.key["tenant_id"]: r.value["last"] for r in state.collect()} == last
    slots = spark.read.format("statestore").option("stateVarName", "slots").load(f"{tmp_path}/ckpt")
    assert slots.count() == 0


@pytest.mark.parametrize("held", [1_000_000, 2])
def test_alert_stream_equals_the_fold(spark, tmp_path, held):
    rng = random.Random(3)
    rows = [(rng.choice(["storage", "progress", "other"]), i, i * 3_000_000_000, rng.random() < 0.8) for i in range(300)]
    schema = "kind string, seq long, at_ns long, failed boolean"
    parts = [rng.sample(rows[a : a + 60], 60) for a in range(0, 300, 60)]
    written(spark, f"{tmp_path}/in", [(p, schema) for p in parts])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert drained(stateful.alert_stream(stream, held=held), tmp_path) == [60] * 5
    want = folds.alert_cooldown(spark.createDataFrame(rows, schema))
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want.select("kind", "seq", "at_ns", "state", "suppressed").collect())
    state = spark.read.format("statestore").option("stateVarName", "alert").load(f"{tmp_path}/ckpt").collect()
    assert {r.key["kind"] for r in state} == {"storage", "progress"}


def test_bounded_dedupe_keeps_the_first_by_offset(spark, tmp_path):
    d = str(tmp_path)
    write_log(spark, f"{d}/log", [(3, value(0, "later")), (1, value(0, "first")), (2, value(1, "first")), (0, b"not-json")])
    write_log(spark, f"{d}/log", [(4, value(0, "again")), (5, value(2, "first"))])
    write_log(spark, f"{d}/log", [(6, value(2, "again")), (7, value(1, "again")), (8, value(3, "first")), (9, b"bad")])
    write_log(spark, f"{d}/log", [(10, value(3, "again")), (11, value(0, "again"))])
    assert run(spark, d, dedupe_horizon="7 days") == [4, 2, 4, 2]
    rows = spark.read.parquet(f"{d}/table").collect()
    assert sorted((r.event_id, r.event_type) for r in rows) == [(UUIDS[i], "first") for i in range(4)]
    metrics = {r.batch_id: (r["rows"], r.inserted, r.duplicates, r.quarantined, r.retries) for r in spark.read.parquet(f"{d}/metrics").collect()}
    assert metrics == {0: (3, 2, 1, 1, 0), 1: (2, 1, 1, 0, 0), 2: (3, 1, 2, 1, 0), 3: (2, 0, 2, 0, 0)}
    assert sorted((r.offset, bytes(r.value), bytes(r.key)) for r in spark.read.parquet(f"{d}/bad").collect()) == [(0, b"not-json", b"original"), (9, b"bad", b"original")]
    assert spark.read.format("statestore").option("stateVarName", "until").load(f"{d}/ckpt").count() == 4


def test_bounded_dedupe_forgets_behind_the_horizon(spark, tmp_path):
    d = str(tmp_path)

    def at(i, day, kind):
        return value(i, kind).replace(b'"received_at":"2026-01-01', f'"received_at":"2026-01-{day:02d}'.encode())

    for n, (day, i, kind) in enumerate([(1, 0, "first"), (2, 0, "repeat"), (20, 1, "other"), (21, 2, "other"), (22, 0, "anew")]):
        write_log(spark, f"{d}/log", [(n, at(i, day, kind))])
    run(spark, d, dedupe_horizon="3 days")
    assert sorted((r.event_id, r.event_type) for r in spark.read.parquet(f"{d}/table").collect()) == [
        (UUIDS[0], "anew"), (UUIDS[0], "first"), (UUIDS[1], "other"), (UUIDS[2], "other")]


def test_observer_state_is_what_is_pending(spark, tmp_path):
    d = str(tmp_path)
    pending = spark.createDataFrame([(uid(i),) for i in (1, 2, 11, 11, 21, 99)] + [(None,)], "event_id string")

    def observe():
        q = ingest.start_observer(spark, feed.table_stream(spark, f"{d}/table"), pending, f"{d}/seen", f"{d}/ckpt")
        q.awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{d}/ckpt")
        return {int(r.key["event_id"][:8]) for r in state.collect()}

    left = []
    for n in range(4):
        sink.write_batch(batch(spark, [10 * n + k for k in range(4)]), n, f"{d}/table", f"{d}/bad", buckets=4)
        left.append(observe())
    assert left == [{11, 21, 99}, {21, 99}, {99}, {99}]
    seen = spark.read.parquet(f"{d}/seen").collect()
    assert sorted((int(r.event_id[:8]), r.batch_id) for r in seen) == [(1, 0), (2, 0), (11, 1), (21, 2)]
    assert all(r.observed_at >= r.received_at for r in seen)


def test_histogram_bounds(spark):
    rows = spark.createDataFrame([(x,) for x in (0.001, 0.0011, 0.5, 59.9, 61.0)], "seconds double")
    got = rows.agg(F.count("*").alias("n"), *ingest.histogram("seconds")).first()
    assert (got["n"], got["le_0_001"], got["le_0_005"], got["le_0_5"], got["le_60"]) == (5, 1, 2, 3, 4)
