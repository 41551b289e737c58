"""Keys that share a page of state are told apart and forgotten one by one."""

import datetime as dt

import pytest

from tests.test_ingest import UUIDS, value, write_log
from tidemark.operators.validation import validate_events
from tidemark.plans import streams
from tidemark.sources import files
from tidemark.streaming import ingest, stateful


@pytest.mark.parametrize("pages", [1, 3])
def test_pages_hold_many_keys(spark, tmp_path, pages):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB_PROVIDER)
    d = str(tmp_path)

    def at(i, day, kind):
        return value(i, kind).replace(b'"received_at":"2026-01-01', f'"received_at":"2026-01-{day:02d}'.encode())

    days = [[(1, 0, "first"), (1, 1, "first"), (1, 0, "again")], [(2, 1, "again"), (2, 2, "first")], [(20, 3, "first")], [(21, 3, "again")], [(22, 0, "anew"), (22, 2, "anew"), (22, 3, "again")]]
    offset = 0
    for rows in days:
        write_log(spark, f"{d}/log", [(offset + n, at(i, day, kind)) for n, (day, i, kind) in enumerate(rows)])
        offset += len(rows)
    log = files.read_log(spark, f"{d}/log", streaming=True, max_files=1)
    out = stateful.first_within(validate_events(log, "value", kind="envelope"), "3 days", pages=pages)
    q = out.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{d}/out").collect()
    assert sorted((r.event_id, r.event_type) for r in rows if r.kind == "first") == sorted(
        [(UUIDS[i], "first") for i in range(4)] + [(UUIDS[0], "anew"), (UUIDS[2], "anew")])
    assert sum(r.copies for r in rows if r.kind == "repeat") == 4
    state = spark.read.format("statestore").option("stateVarName", "until").load(f"{d}/ckpt").collect()
    assert len(state) <= pages and sum(len(r.value["keys"]) for r in state) == 3


@pytest.mark.parametrize("pages", [1, 3])
def test_pending_ids_share_pages(spark, tmp_path, pages):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB_PROVIDER)
    d, schema = str(tmp_path), "tenant_id string, event_id long, received_at timestamp"
    pending = spark.createDataFrame([("a", i) for i in (1, 2, 3, 3, 4, 5)] + [("b", 1), ("b", None), (None, 7)], "tenant_id string, event_id long")
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    batches = [[("a", 1, at(5)), ("a", 1, None), ("a", 1, at(3)), ("a", 9, at(1)), (None, 7, at(1))], [("a", 1, at(1)), ("b", 1, None), ("a", 3, at(9))],
               [("a", 2, None), ("a", 2, at(4)), ("b", None, at(2))]]
    left, output = [], f"{d}/seen"
    for rows in batches:  # the stream starts anew for each
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
        stored = spark.readStream.schema(schema).parquet(f"{d}/in")
        ingest.start_observer(spark, stored, pending, output, f"{d}/ckpt", keys=("tenant_id", "event_id"), pages=pages).awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{d}/ckpt").collect()
        assert len(state) <= pages
        left.append({k for r in state for k in zip(r.value["tenant_id"], r.value["event_id"])})
    assert left == [{("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 1)}, {("a", 2), ("a", 4), ("a", 5)}, {("a", 4), ("a", 5)}]
    seen = spark.read.parquet(output).collect()
    assert {(r.tenant_id, r.event_id, r.received_at and r.received_at.second, r.batch_id) for r in seen} == {
        ("a", 1, 3, 0), ("b", 1, None, 1), ("a", 3, 9, 1), ("a", 2, 4, 2)} and len(seen) == 4
