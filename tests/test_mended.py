"""Faults once found: each test fails on the code before its mending."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions.json_text import number_fits
from tidemark.operators import diffs, offsets, reconcile, runs
from tidemark.sources import files, sink


def test_gzip_members_are_summed_and_cut_files_found():
    whole = gzip.compress(b"12345") + gzip.compress(b"67890")
    assert files._unpacked(whole) == 10
    assert files._unpacked(whole[:-3]) == -1 and files._unpacked(b"no gzip") == -1


def test_quarantine_cuts_between_characters(spark):
    rows = spark.createDataFrame([("t", 0, 1, None, None, b"x", "a" * 1023 + "é"), ("t", 0, 2, None, None, b"x", "short")], "topic string, partition int, offset long, key binary, headers string, value binary, error string")
    assert [r.error for r in sink.quarantine_rows(rows).orderBy("offset").collect()] == ["a" * 1023, "short"]


def test_lag_needs_the_very_partitions(spark):
    rows = [("right", p, 5, 4) for p in (0, 1, 2)] + [("wrong", p, 5, 4) for p in (0, 1, 7)]
    df = spark.createDataFrame(rows, "snapshot_id string, part int, end_off long, committed_off long")
    assert {r.snapshot_id: r.lag for r in offsets.offset_lag(offsets.snapshots(df)).collect()} == {"right": 3, "wrong": None}


def test_one_sided_keys_differ(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "id int, x int"), spark.createDataFrame([(1, 2), (3, 4)], "id int, x int")
    assert sorted(tuple(r) for r in diffs.identity_diff(a, b, "id", {"x": "x"}).collect()) == [(2, "x"), (3, "x")]


def test_flat_digest_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ids = [(r, s, f"{i:04d}") for r in ("a", "b") for s in ("accepted", "stored") for i in range(100)]
        got = reconcile.set_digest(spark.createDataFrame(ids * 2, "run_id string, set_name string, event_id string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = hashlib.sha256("\n".join(f"{i:04d}" for i in range(100)).encode()).hexdigest()
    assert len(got) == 4 and all(r.sha256 == want and r.ids == 100 for r in got)


@pytest.mark.parametrize("text", ["0", "-1.50", "1e10", "1E-5", "0e00005", "1" * 5000])
def test_numbers_that_fit(text):
    assert number_fits(text)


@pytest.mark.parametrize("text", ["1e999999999999999999", "1e-999999999999999999", "1e200000", "0." + "1" * 20000])
def test_numbers_that_do_not(text):
    assert not number_fits(text)


def test_completeness_judges_signs_and_verdicts(spark):
    rows = [(1, m, r, 10, 10, 0, 5, True) for m in runs.METHODS for r in (1, 2)]
    rows[0], rows[1] = (*rows[0][:4], 11, -1, 5, True), (*rows[1][:7], False)
    df = spark.createDataFrame(rows, "case_id long, method string, repetition long, submitted long, inserted long, duplicates long, elapsed_ns long, correct boolean")
    assert sorted((r.repetition, r.fault) for r in runs.completeness(df, df, 2).collect()) == [(1, "counts"), (2, "incorrect")]
    assert [r.repetition for r in runs.completed_repetitions(df).collect()] == [1]
    one = df.where("method = 'copy-merge'")
    assert runs.repetition_sets(one, 2).first().complete
    assert not runs.repetition_sets(df.where("method = 'insert'"), 2).first().complete


def test_hash_trees_of_wide_sets(spark):
    import random

    rng = random.Random(4)
    rows = [(s, f"{rng.randrange(5_000)}") for s in ("a", "b") for _ in range(3_000 if s == "a" else 40)] + [("c", None)]
    frame = spark.createDataFrame(rows, "run_id string, m string").withColumn("h", F.sha2("m", 256)).distinct().where("m IS NOT NULL")

    def digest(lines):
        return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()

    def plain(members, digits):
        leaves, nodes = {}, {}
        for m in members:
            leaves.setdefault(hashlib.sha256(m.encode()).hexdigest()[:digits], []).append(m)
        for leaf, own in leaves.items():
            nodes.setdefault(leaf[:4], []).append((leaf, digest(own)))
        return digest(f"{node}:{own[0][1] if digits == 4 else digest([f'{x}:{d}' for x, d in own])}" for node, own in nodes.items())

    sets = {s: {m for x, m in rows if x == s} for s in ("a", "b")}
    for wide, digits in ((1 << 26, {"a": 4, "b": 4}), (100, {"a": 8, "b": 4}), (0, {"a": 8, "b": 8})):
        got = {r.run_id: (r.members, r.root) for r in reconcile.hash_tree(frame, ["run_id"], "h", "m", wide=wide).collect()}
        assert got == {s: (len(sets[s]), plain(sets[s], digits[s])) for s in sets}
