"""Crash, poison and replay of the ingest stream."""

import pytest

from tidemark.sources import files, manifest, sink
from tidemark.streaming import ingest

UUIDS = [f"{i:08d}-0000-4000-8000-000000000001" for i in range(12)]
ONCE = {"min_ms": 1, "max_ms": 1, "window_ms": 0, "attempts": None}


def value(i, kind="a"):
    return (f'{{"event_id":"{UUIDS[i]}","event_type":"{kind}","occurred_at":"2026-01-01T00:00:00Z","payload":{{"i":{i}}},'
            f'"tenant_id":"t","received_at":"2026-01-01T00:00:00Z"}}').encode()


def write_log(spark, path, rows):
    data = [("log", 0, off, b"original", [("h", b"x")], v) for off, v in rows]
    spark.createDataFrame(data, files.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, d, **kw):
    q = ingest.start_ingest(spark, files.read_log(spark, f"{d}/log", True, 1), f"{d}/table", f"{d}/bad", f"{d}/ckpt", f"{d}/metrics", policy=ONCE, **{"buckets": 4, **kw})
    q.awaitTermination()
    return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]


def test_crash_after_write_changes_nothing(spark, tmp_path):
    d = str(tmp_path)
    write_log(spark, f"{d}/log", [(i, value(i)) for i in range(6)] + [(6, value(0, "late")), (7, b"not-json")])
    write_log(spark, f"{d}/log", [(8 + i, value(i, "again")) for i in range(8)])

    def crash(batch_id):
        if batch_id == 1:
            raise RuntimeError("lost before progress was saved")

    with pytest.raises(Exception):
        run(spark, d, after_write=crash)
    run(spark, d)
    rows = sink.read_table(spark, f"{d}/table").collect()
    assert len(rows) == len({(r.tenant_id, r.event_id) for r in rows}) == 8
    assert {r.event_type for r in rows if r.event_id in UUIDS[:6]} == {"a"}
    m = {r.batch_id: (r.inserted, r.duplicates) for r in spark.read.parquet(f"{d}/metrics").collect()}
    assert m == {0: (6, 1), 1: (2, 6)}
    bad = spark.read.parquet(f"{d}/bad").collect()
    assert [(r.offset, bytes(r.value), bytes(r.key)) for r in bad] == [(7, b"not-json", b"original")]


def test_quarantine_failure_keeps_the_position(spark, tmp_path):
    d = str(tmp_path)
    write_log(spark, f"{d}/log", [(0, value(0)), (1, b"bad")])
    (tmp_path / "bad").write_text("a file where the folder should be")
    with pytest.raises(Exception):
        run(spark, d)
    assert sink.committed_batches(spark, f"{d}/table") == []


def test_half_written_batch_is_not_read(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    write_log(spark, f"{d}/log", [(0, value(0))])
    with monkeypatch.context() as m, pytest.raises(Exception):
        m.setattr(manifest, "commit", lambda *a: 1 / 0)
        run(spark, d)
    assert list((tmp_path / "table" / "data").iterdir())
    assert sink.read_table(spark, f"{d}/table").count() == 0 and sink.committed_batches(spark, f"{d}/table") == []
    run(spark, d)
    assert sink.read_table(spark, f"{d}/table").count() == 1 and sink.committed_batches(spark, f"{d}/table") == [(0, 0)]


def test_any_split_gives_the_same_table(spark, tmp_path):
    log = spark.createDataFrame([("log", 0, off, b"k", [], value(off % 5, f"v{off}")) for off in range(15)], files.LOG_SCHEMA)
    for n, cuts in enumerate([(15,), (4, 15), (7, 9, 15)]):
        d, low = f"{tmp_path}/{n}", 0
        for b, high in enumerate(cuts):
            part = log.where(f"offset >= {low} AND offset < {high}")
            sink.write_batch(part, b, f"{d}/table", f"{d}/bad")
            sink.write_batch(part, b, f"{d}/table", f"{d}/bad")
            low = high
        got = {(r.event_id, r.event_type) for r in sink.read_table(spark, f"{d}/table").collect()}
        assert got == {(UUIDS[i], f"v{i}") for i in range(5)}


def test_bounded_dedupe_keeps_poison(spark, tmp_path):
    d = str(tmp_path)
    write_log(spark, f"{d}/log", [(i, value(i)) for i in range(4)] + [(4, b"not-json")])
    write_log(spark, f"{d}/log", [(5 + i, value(i, "again")) for i in range(6)])
    written = []
    run(spark, d, dedupe_horizon="7 days", after_write=written.append)
    assert written[:2] == [0, 1]
    assert {(r.event_id, r.event_type) for r in spark.read.parquet(f"{d}/table").collect()} == {
        (UUIDS[i], "a" if i < 4 else "again") for i in range(6)}
    assert [r.offset for r in spark.read.parquet(f"{d}/bad").collect()] == [4]


def test_a_stream_keeps_running(spark, tmp_path):
    d = str(tmp_path)
    write_log(spark, f"{d}/log", [(0, value(0))])
    source = files.read_log(spark, f"{d}/log", True, 1)
    q = ingest.start_ingest(spark, source, f"{d}/table", f"{d}/bad", f"{d}/ckpt", policy=ONCE, trigger={"processingTime": "100 milliseconds"})
    try:
        q.processAllAvailable()
        write_log(spark, f"{d}/log", [(1, value(1)), (2, value(0, "again"))])
        q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()
    assert {(r.event_id, r.event_type) for r in sink.read_table(spark, f"{d}/table").collect()} == {(UUIDS[0], "a"), (UUIDS[1], "a")}


def test_retries_stop_at_the_window():
    clock, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 3))
        clock[0] += s

    def fail():
        raise OSError("down")

    with pytest.raises(OSError):
        ingest.with_retries(fail, sleep=sleep, clock=lambda: clock[0])
    assert waits[:6] == [0.1, 0.2, 0.4, 0.8, 1.6, 2.0] and sum(waits) <= 15
