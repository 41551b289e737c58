"""The event table's manifest, key index, merges and feed; publishing; retries with a deadline."""

import dataclasses
import json
import threading
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.test_ingest import ONCE, UUIDS, run, value, write_log
from tidemark.operators import validation
from tidemark.sources import feed, files, manifest, sink
from tidemark.streaming import ingest


def uid(i):
    return f"{i:08d}-0000-4000-8000-000000000001"


def doc(i, kind="a"):
    return value(0, kind).replace(UUIDS[0].encode(), uid(i).encode())


def batch(spark, ids, kind="a", first=0):
    return spark.createDataFrame([("log", 0, first + n, b"k", [], doc(i, kind)) for n, i in enumerate(ids)], files.LOG_SCHEMA)


def kinds(spark, table):
    rows = sink.read_table(spark, table).collect()
    assert len(rows) == len({r.event_id for r in rows})
    return {int(r.event_id[:8]): r.event_type for r in rows}


def test_first_content_stays_through_all_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "FAN", 2)
    monkeypatch.setattr(sink, "FOLDERS", 3)
    table, bad, want = f"{tmp_path}/table", f"{tmp_path}/bad", {}
    for n in range(12):
        ids = [(7 * n + 3 * k) % 40 for k in range(6)]
        got = sink.write_batch(batch(spark, ids, f"k{n}"), n, table, bad, buckets=4)
        fresh = {i: f"k{n}" for i in ids if i not in want}
        want.update(fresh)
        assert (got["inserted"], got["duplicates"]) == (len(fresh), len(ids) - len(fresh))
    assert kinds(spark, table) == want
    live = manifest.newest(spark, table)
    assert live.batches == ((0, 11),) and live.buckets == 4
    assert max(r["level"] for r in live.index) >= 2 and max(e["level"] for e in live.data) >= 1
    assert len(live.data) < 8 and len(live.index) <= 4  # neither grows with the number of batches
    again = sink.write_batch(batch(spark, [1, 2, 3], "late"), 5, table, bad)
    assert again["batch_id"] == 5 and again["rows"] == 6 and manifest.newest(spark, table).version == live.version
    assert manifest.vacuum(spark, table, keep=0) and kinds(spark, table) == want


def test_index_is_joined_as_it_lies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "FAN", 2)
    table = f"{tmp_path}/table"
    for n in range(4):
        sink.write_batch(batch(spark, [10 * n + k for k in range(5)]), n, table, f"{tmp_path}/bad", buckets=4)
    live = manifest.newest(spark, table)
    late = dataclasses.replace(live, data=tuple({**e, "indexed": True} for e in live.data))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([("t", uid(i)) for i in (3, 99)], sink.KEY_SCHEMA)
        left = sink.absent(rows, late)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert [r.event_id for r in left.collect()] == [uid(99)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and len(late.index) >= 1


def test_compaction_beside_a_running_stream(spark, tmp_path, monkeypatch):
    """Batches that are committed while a merge is at work stay, and so does what it merged."""
    monkeypatch.setattr(sink, "FAN", 3)
    d = str(tmp_path)
    for n in range(4):
        write_log(spark, f"{d}/log", [(10 * n + k, doc(10 * n + k)) for k in range(5)])
    source = files.read_log(spark, f"{d}/log", True, 1)
    q = ingest.start_ingest(spark, source, f"{d}/table", f"{d}/bad", f"{d}/ckpt", policy=ONCE, trigger={"processingTime": "50 milliseconds"}, buckets=4)
    try:
        q.processAllAvailable()
        stop = threading.Event()

        def compactions():
            while not stop.is_set():
                sink.compact(spark, f"{d}/table")

        beside = threading.Thread(target=compactions)
        beside.start()
        for n in range(4, 9):
            write_log(spark, f"{d}/log", [(10 * n + k, doc(10 * n + k)) for k in range(5)] + [(10 * n + 5, doc(10 * (n - 4), "late"))])
            q.processAllAvailable()
        stop.set()
        beside.join()
        assert q.isActive
    finally:
        q.stop()
    sink.compact(spark, f"{d}/table")
    assert kinds(spark, f"{d}/table") == {10 * n + k: "a" for n in range(9) for k in range(5)}
    live = manifest.newest(spark, f"{d}/table")
    assert len(live.data) == 1 and len(live.index) == 1
    run(spark, d)  # the same stream again: nothing new
    assert len(kinds(spark, f"{d}/table")) == 45


def test_two_writers_store_a_key_once(spark, tmp_path, monkeypatch):
    table, bad, real, met = f"{tmp_path}/table", f"{tmp_path}/bad", sink.absent, []

    def absent(rows, live):
        if not met:  # another writer commits between the look and the commit of this one
            met.append(1)
            sink.write_batch(batch(spark, [1, 2], "other"), 100, table, bad, buckets=4)
        return real(rows, live)

    monkeypatch.setattr(sink, "absent", absent)
    got = sink.write_batch(batch(spark, [2, 3], "own"), 0, table, bad, buckets=4)
    assert got["inserted"] == 1 and kinds(spark, table) == {1: "other", 2: "other", 3: "own"}
    assert sink.committed_batches(spark, table) == [(0, 0), (100, 100)]


def test_a_version_is_claimed_once(spark, tmp_path):
    path = f"{tmp_path}/x/7.json"
    assert manifest.claim(spark, path, "one") and not manifest.claim(spark, path, "two")
    assert manifest.read_text(spark, path) == "one" and manifest.read_text(spark, f"{path}0") is None
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")] == ["7.json"]


def test_feed_gives_each_committed_row_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "FAN", 2)
    monkeypatch.setattr(sink, "FOLDERS", 2)
    table = f"{tmp_path}/table"

    def drain():
        q = feed.table_stream(spark, table).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    for n in range(3):
        sink.write_batch(batch(spark, [10 * n + k for k in range(4)]), n, table, f"{tmp_path}/bad", buckets=4)
    drain()
    for n in range(3, 6):
        sink.write_batch(batch(spark, [10 * n + k for k in range(4)]), n, table, f"{tmp_path}/bad")
    sink.compact(spark, table)
    drain()
    drain()
    got, want = spark.read.parquet(f"{tmp_path}/out"), sink.read_table(spark, table)
    columns = [c for c in want.columns if c != "persisted_at"]
    assert got.count() == 24 and sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


def envelopes(spark, ids, long=0):
    rows = [(uid(i), "a", "2026-01-01 00:00:00", '{"x":"' + "y" * long + '"}', "t", "2026-01-01 00:00:00") for i in ids]
    df = spark.createDataFrame(rows, "event_id string, event_type string, occurred_at string, payload string, tenant_id string, received_at string")
    return validation.encode_envelopes(df.withColumns({c: F.to_timestamp(c) for c in ("occurred_at", "received_at")}))


def test_publish_whole_or_not_at_all(spark, tmp_path):
    log = f"{tmp_path}/log"
    assert feed.read_published(spark, log).count() == 0
    feed.publish(envelopes(spark, range(20)).repartition(3), log, "lake.events")
    rows = feed.read_published(spark, log).collect()
    assert {bytes(r.key).decode() for r in rows} == {f"t:{uid(i)}" for i in range(20)} and {r.topic for r in rows} == {"lake.events"}
    assert all(json.loads(bytes(r.value))["event_id"] == bytes(r.key).decode()[2:] for r in rows)
    assert len({(r.partition, r.position) for r in rows}) == 20
    with pytest.raises(Exception, match="too_large"):
        feed.publish(envelopes(spark, range(20, 30)).unionAll(envelopes(spark, [30], 300_000)).repartition(1), log)
    assert feed.read_published(spark, log).count() == 20
    assert len(list((tmp_path / "log" / "records").iterdir())) == len(list((tmp_path / "log" / "commits").iterdir())) * 3
    feed.publish(envelopes(spark, [50]), log, writer="w")
    feed.publish(envelopes(spark, [51]), log, writer="w")  # that writer's batch is in already
    assert feed.read_published(spark, log).where("writer = 'w'").count() == 1


def test_a_repeated_batch_is_published_once(spark, tmp_path):
    envelopes(spark, range(5)).coalesce(1).write.parquet(f"{tmp_path}/in")
    envelopes(spark, range(5, 9)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema

    def drain():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        feed.publish_stream(source, f"{tmp_path}/log", f"{tmp_path}/ckpt", "q").awaitTermination()

    drain()
    (tmp_path / "ckpt" / "commits" / "1").unlink()  # as if the stream had ended between its publish and its progress
    (tmp_path / "ckpt" / "commits" / ".1.crc").unlink(missing_ok=True)
    drain()
    rows = feed.read_published(spark, f"{tmp_path}/log").collect()
    assert len(rows) == 9 and {r.batch for r in rows} == {0, 1}


def slow(spark, seconds):
    import pandas as pd

    @F.pandas_udf("long")
    def wait(x: pd.Series) -> pd.Series:
        time.sleep(seconds)
        return x

    return spark.range(4).select(wait("id").alias("x")).agg(F.sum("x")).first()[0]


def test_a_hanging_attempt_is_cancelled_and_tried_again(spark):
    seen, times = [], iter([60, 0])
    policy = {"min_ms": 1, "max_ms": 1, "window_ms": 60_000, "attempt_ms": 8_000}
    slow(spark, 0)
    began = time.monotonic()
    got = ingest.with_retries(lambda: {"sum": slow(spark, next(times))}, policy, spark=spark, on_retry=seen.append)
    assert got == {"sum": 6} and time.monotonic() - began < 40
    assert [type(e) for e in seen] == [ingest.AttemptTimeout]
    assert not [t for t in spark.sparkContext.getJobTags() if t.startswith("attempt-")]


def test_errors_that_stay_are_not_tried_again(spark):
    tries = []

    def wrong():
        tries.append(1)
        return spark.range(1).select("no_such_column").count()

    with pytest.raises(AnalysisException):
        ingest.with_retries(wrong, {"min_ms": 1, "max_ms": 1, "window_ms": 10_000, "attempt_ms": None})
    assert len(tries) == 1
