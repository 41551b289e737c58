"""What is moved between tasks, and how much one of them holds."""

import re

from pyspark.sql import functions as F

from tidemark.operators import audit, reconcile
from tidemark.plans import evidence


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_digests_move_members_once_and_never_by_set(spark, capsys):
    sets = spark.range(100).select((F.col("id") % 3).alias("run_id"), (F.col("id") % 2).cast("string").alias("set_name"), F.col("id").alias("event_id"))
    text = plan(reconcile.tree_digest(sets), capsys)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert not re.search(r"hashpartitioning\([^)]*leaf", text)


def test_digests_move_members_without_their_place(spark, capsys):
    sets = spark.range(100).select((F.col("id") % 3).alias("run_id"), (F.col("id") % 2).cast("string").alias("set_name"), F.col("id").alias("event_id"))
    text = plan(reconcile.tree_digest(sets), capsys)
    assert "REPARTITION_BY_COL" in text and not re.search(r"Exchange hashpartitioning\([^)]*(node|leaf)#", text)


def test_only_sets_that_may_be_wide_are_counted(spark):
    """A set of many copies has many rows and few members: its leaves stay those of a small set."""
    rows = [("a", f"{i % 40}") for i in range(300)] + [("b", f"{i}") for i in range(120)] + [("c", f"{i}") for i in range(20)] + [("c", None), (None, "7")]
    sets = spark.createDataFrame(rows, "run_id string, event_id string")
    got = {r.run_id: (r.ids, r.tree_sha256) for r in reconcile.tree_digest(sets, ["run_id"], wide=100).collect()}
    ids = sets.where("event_id IS NOT NULL").distinct().withColumn("h", F.sha2("event_id", 256))
    want = {r.run_id: (r.members, r.root) for r in reconcile.hash_tree(ids, ["run_id"], "h", "event_id", wide=100).collect()}
    assert got == want and {k: v[0] for k, v in got.items()} == {"a": 40, "b": 120, "c": 20, None: 1}
    eight = {r.run_id: r.root for r in reconcile.hash_tree(ids, ["run_id"], "h", "event_id", wide=0).collect()}
    assert [got[s][1] == eight[s] for s in ("a", "b", "c")] == [False, True, False]


def test_window_audit_keeps_latencies(spark, capsys):
    """Columns of a request come along with its place instead of by a join on its ID."""
    requests = [(run, n, 10 * n, 10 * n + 5, 5 + n, 2, n % 3 != 0, False) for run in (1, 2) for n in range(12)]
    acks = [(run, p, e + (run == 2 and p == 3)) for run in (1, 2) for p, e in enumerate(r[4] for r in requests if r[0] == run and r[6])]
    sets = [(run, s, i) for run in (1, 2) for s, k in (("accepted", 16), ("attempted", 24)) for i in range(k)]
    tables = {
        "requests": spark.createDataFrame(requests, "run_id long, request_id long, started_ns long, finished_ns long, elapsed_ns long, events long, accepted boolean, ambiguous boolean"),
        "acks": spark.createDataFrame(acks, "run_id long, position long, latency_ns long"),
        "sets": spark.createDataFrame(sets, "run_id long, set_name string, event_id long"),
        "runs": spark.createDataFrame([(run, 50, 6, 12, 10, 12) for run in (1, 2)],
                                      "run_id long, window_ns long, accepted_in_window long, attempted_in_window long, accepted_after_window long, attempted_after_window long"),
    }
    got = audit.r6_window(tables)
    assert not re.search(r"Join[^\n]*request_id", plan(got, capsys))
    assert {r.run_id: r.detail for r in got.collect()} == {1: "", 2: "acks"}


def test_registered_cases_are_dealt_before_they_are_counted(spark, capsys):
    studies = spark.createDataFrame([(1, "smoke"), (2, "connections"), (3, "full"), (4, "smoke")], "run_id long, mode string")
    cases = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (2, None), (4, None), (4, 1)], "study_id long, case_id long")
    got = audit.r12_registry(studies, cases, publication=False)
    counted = plan(got, capsys).split("REPARTITION_BY_NUM")
    assert len(counted) == 2 and "HashAggregate" not in counted[1] and "Expand" not in counted[1]
    assert {r.run_id: r.detail for r in got.collect()} == {1: "", 2: "cardinality,unique", 3: "cardinality", 4: "unique"}


class Requests:
    def __init__(self, frame):
        self.v_areq = frame


def test_events_count_on_from_their_request(spark, capsys):
    rows = [(run, n, 1 + n % 3, n % 5 < 2, n % 5 == 3) for run in (0, 1) for n in range(60)] + [(1, None, None, None, None)]
    frame = spark.createDataFrame(rows, "run_id long, request_id long, events long, accepted boolean, ambiguous boolean")
    lists = evidence.event_lists(Requests(frame))
    got = {(r.run_id, r.position): (r.event_id, r.a, r.u) for r in lists.collect()}
    want = {}
    for run in (0, 1):
        at = a = u = 0
        for n in range(60):
            for k in range(1 + n % 3):
                a, u = a + (n % 5 < 2), u + (n % 5 == 3)
                want[run, at] = (n * 4 + k, a, u)
                at += 1
    assert got == want
