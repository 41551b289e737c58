"""Goldens and brute-force checks of the operators."""

import hashlib
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, generate, offsets, ranks, reconcile, timeline
from tidemark.operators.latency import rates, receipt_latency
from tidemark.operators.ordered import RADIX_BITS, running
from tidemark.operators.outbox import admit_orders
from tidemark.sources import files


def test_running_over_far_apart_orders(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0, 1 << RADIX_BITS, 1 << 45, -(1 << 41)]) + rng.randrange(5), rng.randrange(9)) for k in "ab" for _ in range(200)]
    got = running(spark.createDataFrame(rows, "k string, o bigint, v bigint"), ["k"], "o", sums={"s": F.col("v")}, before_maxes={"p": F.col("o")}).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.k]
        assert r.s == sum(v for _, o, v in mine if o <= r.o)
        assert r.p == max((o for _, o, _ in mine if o < r.o), default=None)


def test_nearest_rank(spark):
    rng = random.Random(5)
    ps = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    sets = {"five": [5, 1, 4, 3, 2], "hundred": list(range(1, 101)), "ties": [7] * 50 + [9], "wide": [rng.randrange(1 << 50) for _ in range(997)]}
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k string, v bigint")
    for r in ranks.nearest_rank(df, "v", ["k"], ps).collect():
        vs = sorted(sets[r.k])
        assert [r[p] for p in ps] == [vs[max(0, math.ceil(len(vs) * p) - 1)] for p in ps.values()]
    none = ranks.nearest_rank(df.where("false"), "v", [], ps).first()
    assert (none.n, none.p50, none.p99) == (0, 0, 0)


def test_reconcile_and_digest(spark):
    rows = [("r", "attempted", "a"), ("r", "accepted", "a"), ("r", "stored", "b"), ("r", "stored", "b"), ("d", "stored", "b"), ("d", "stored", "a"), ("d", "stored", "a")]
    sets = spark.createDataFrame(rows, "run_id string, set_name string, event_id string")
    r = {x.run_id: x for x in reconcile.reconcile(sets).collect()}
    assert (r["r"].missing, r["r"].unexpected, r["r"].duplicates, r["r"].correct) == (1, 1, 1, False)
    d = {(x.run_id, x.set_name): x.sha256 for x in reconcile.set_digest(sets).collect()}
    assert d[("d", "stored")] == hashlib.sha256(b"a\nb").hexdigest()


def test_rates_and_clamped_latency(spark):
    r = rates(spark.createDataFrame([(1, 1, 10**9, 2 * 10**9)], "accepted_in_window bigint, persisted bigint, window_ns bigint, total_ns bigint")).first()
    assert (r.accepted_eps, r.verified_eps) == (1.0, 0.5)
    df = spark.sql("SELECT TIMESTAMP'2026-01-01 00:00:01' AS r, TIMESTAMP'2026-01-01 00:00:00' AS s")
    assert receipt_latency(df, "r", "s").first().seconds == 0


def test_offsets(spark):
    df = spark.createDataFrame(
        [("lag", "available", {0: 10, 1: 8, 2: 4}, {0: 9, 1: 3, 2: 4}), ("gone", "unavailable", {}, {}), ("race", "available", {0: 10, 1: 8, 2: 4}, {0: 12, 1: 3, 2: 4}),
         ("c1", "available", {0: 10, 1: 0, 2: 7}, {0: 9, 2: 7}), ("c2", "available", {0: 10, 1: 0, 2: 7}, {0: 10, 2: 7}), ("c3", "available", {0: 10, 1: 0, 2: 7}, {0: 10, 1: -1, 2: 7})],
        "id string, status string, end map<int,bigint>, committed map<int,bigint>",
    )
    lag = {r.id: r.lag for r in offsets.offset_lag(df).collect()}
    assert (lag["lag"], lag["gone"], lag["race"]) == (6, None, None)
    done = {r.id: r.caught_up for r in offsets.caught_up(df).collect()}
    assert (done["c1"], done["c2"], done["c3"], done["gone"]) == (False, True, True, False)


def test_segments(spark):
    log = spark.createDataFrame([(0, 0, True), (0, 1, False), (0, 2, True)], "part int, off bigint, valid boolean")
    got = sorted((r.first_off, r.kind) for r in offsets.segments(log, 500).collect())
    assert got == [(0, "store"), (1, "quarantine"), (2, "store")]


def test_alert_golden(spark):
    at = lambda s: int(s * 10**9)
    ops = [(i, at(100), True) for i in range(100)] + [(100, at(111), True), (101, at(111), False), (102, at(111), False), (103, at(111), True)]
    df = spark.createDataFrame([("storage", *o) for o in ops] + [("secret", 9, 1, True)], "kind string, seq bigint, at_ns bigint, failed boolean")
    got = sorted((r.seq, r.state, r.suppressed) for r in folds.alert_cooldown(df).collect())
    assert got == [(0, "failed", 0), (100, "failed", 99), (101, "recovered", 0), (103, "failed", 0)]


def test_token_bucket_equals_single_fold(spark):
    rng = random.Random(1)
    rows, now = [], {"a": 0, "b": 0}
    for i in range(600):
        t = rng.choice("aab")
        now[t] += rng.choice([0, 10**6, 2 * 10**8, 15 * 10**8])
        rows.append((t, now[t], i))
    got = {(r.tenant_id, r.request_id): (r.allowed, r.remaining) for r in folds.token_bucket(spark.createDataFrame(rows, "tenant_id string, at_ns bigint, request_id bigint"), 3).collect()}
    state = {}
    for t, at, i in sorted(rows):
        tokens, last = state.get(t, (3.0, at))
        tokens, ok, left = folds.bucket_step(tokens, last, at, 3)
        state[t] = (tokens, at)
        assert got[(t, i)] == (ok, left)


def test_observed_curve_golden(spark):
    pts = spark.createDataFrame([("r", 10**9, 4, True, False), ("r", 2 * 10**9, 4, False, False), ("r", 3 * 10**9, 7, True, True)],
                                "run_id string, elapsed_ns bigint, visible bigint, available boolean, final boolean")
    got = sorted((r.seconds, r.visible, r.series) for r in timeline.observed_curve(pts).collect())
    assert got == [(1.0, 4, "observed"), (2.0, None, "observed"), (3.0, 7, "verified")]


def test_generator_bytes(spark):
    spec = generate.DatasetSpec(count=20, payload_bytes=256, seed=42, namespace="n", payload_profile="varied", duplicate_fraction=0.25)
    rows = generate.event_dataset(spark, spec).orderBy("position").collect()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
    data = b"".join(hashlib.sha256(f"n/42/3/{o}".encode()).digest() for o in range(0, 245, 32))[:245]
    assert rows[3].payload == '{"data":"' + "".join(letters[b & 63] for b in data) + '"}'
    assert rows[3].event_id == str(uuid.uuid5(uuid.NAMESPACE_OID, "n/42/3"))
    assert rows[15].event_id == rows[0].event_id and rows[15].payload == rows[0].payload


def test_orders_conflict(spark):
    req = spark.createDataFrame([("order-1", 2500, 0), ("order-1", 2500, 1), ("order-1", 2600, 2)], "order_id string, amount_cents bigint, attempt bigint")
    orders, outbox, conflicts = admit_orders(req)
    assert orders.count() == outbox.count() == 1 and [r.amount_cents for r in conflicts.collect()] == [2600]


def test_inventory_and_metrics(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_bytes(b"hello")
    (tmp_path / "m.txt").write_text('lake_stored_total 3\nlake_db_pool_max +Inf\nlake_stored_total{tenant="x"} 1\nother 2\n')
    got = {r.path: (r.size, r.sha256) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert got["sub/a.json"] == (5, hashlib.sha256(b"hello").hexdigest())
    m = {(r.metric, r.value, r.status) for r in files.read_metrics_text(spark, str(tmp_path / "m.txt"), "lake_").collect()}
    assert m == {("lake_stored_total", 3.0, "number"), ("lake_db_pool_max", None, "unlimited")}


def test_study_audit_takes_the_rules_whose_tables_are_given(spark):
    from tidemark.operators import audit

    studies = spark.createDataFrame([("a", "full"), ("b", "smoke")], "run_id string, mode string")
    cases = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 1), ("b", 1)], "study_id string, case_id int")
    texts = spark.createDataFrame([("x", "see postgres://host"), ("y", "clean")], "name string, text string")
    got = audit.audit_study({"studies": studies, "registry": cases, "texts": texts}).collect()
    assert sorted((r.subject, r.rule, r.passed, r.detail) for r in got) == [
        ("a", "R12", True, ""), ("b", "R12", False, "mode,unique"), ("study", "R17", False, "1"), ("x", "R17", False, "postgres://")]
    with pytest.raises(ValueError, match="R1 needs"):
        audit.audit_study({"texts": texts}, ["R1"])


def test_running_keeps_columns(spark):
    rows = [(k, i * 700_000, f"{k}{i}", None if i % 5 == 0 else i) for k in ("a", None) for i in range(60)]
    frame = spark.createDataFrame(rows, "k string, o long, name string, v long").repartition(3)
    got = running(frame, ["k"], "o", sums={"total": F.col("v")}, before_maxes={"prev": F.struct("o", "name")}, unique=True, keep=["name", "v"])
    for r in got.collect():
        i = r.o // 700_000
        assert (r.name, r.v) == (f"{r.k}{i}", None if i % 5 == 0 else i) and r.total == sum(x for x in range(i + 1) if x % 5)
        assert (r.prev and r.prev.name) == (f"{r.k}{i - 1}" if i else None)
    with pytest.raises(ValueError):
        running(frame, ["k"], "o", sums={"total": F.col("v")}, keep=["name"])
