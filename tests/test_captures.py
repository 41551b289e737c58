"""Captures piece by piece: any cut of the text, nested samples, malformed documents, round trips."""

import gzip
import json
import random

import pytest

from tidemark.sources import captures

DOC = {"a": 1, "ack_ns": [1, -2.5e3, "x\"]}", {"k": [1, 2]}, None], "inner": {"backlog": [], "stored": "é, {", "deep": {"ack_ns": [12, 345], "z": [1, 2]}}, "empty": {}, "last": 1234}
ROWS = [("a", None, 1), *[("ack_ns", i, v) for i, v in enumerate(DOC["ack_ns"])], ("inner.stored", None, "é, {"), ("inner.deep.ack_ns", 0, 12), ("inner.deep.ack_ns", 1, 345),
        ("inner.deep.z", None, [1, 2]), ("last", None, 1234)]


@pytest.mark.parametrize("indent", [None, 1])
def test_any_cut_gives_the_same_rows(indent):
    text = json.dumps(DOC, indent=indent, ensure_ascii=False) + "\n "
    for step in (1, 2, 3, 7, 50, len(text)):
        blocks = (text[i : i + step] for i in range(0, len(text), step))
        assert [(p, i, json.loads(v)) for p, i, v in captures.capture_rows(blocks)] == ROWS


@pytest.mark.parametrize("text", ["", "[1]", '{"a":1', '{"a":1}{', '{"a" 1}', '{"ack_ns":[1 2]}', '{"ack_ns":[1,]}', '{"a":tru}', '{a:1}', '{"a":1,}', '{"a":1 "b":2}', '{"ack_ns":[1'])
def test_malformed_captures_fail(text):
    for step in (1, 100):
        with pytest.raises(ValueError):
            list(captures.capture_rows(text[i : i + step] for i in range(0, len(text), step)))


def test_round_trip_of_long_runs(spark, tmp_path):
    rng = random.Random(3)
    rows = [("one", "ack_ns", i, str(i * i)) for i in range(25_000)] + [("one", "in.er", None, "1"), ("one", "in.backlog", 5, '"b"'), ("one", "in.backlog", 3, '{"q":[1]}')]
    rows += [("two", "x", None, "null"), ("two", "in.deep.ack_ns", 0, "7"), ("two", "in.deep.ack_ns", 1, "8"), ("two", "in.z", None, '"é"'), ("three", "ack_ns", 4, "4")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "file string, path string, index long, value string").repartition(5)
    assert captures.write_captures(frame, f"{tmp_path}/c") == 3
    document = json.loads(gzip.decompress((tmp_path / "c" / "two.json.gz").read_bytes()))
    assert document == {"in": {"deep": {"ack_ns": [7, 8]}, "z": "é"}, "x": None}
    assert (tmp_path / "c" / "one.json.gz").read_bytes()[4:8] == bytes(4)
    got = {(r.file, r.path, r["index"]): r.value for r in captures.read_capture_rows(spark, f"{tmp_path}/c").collect()}
    dense = {("one", "in.backlog", 0): '{"q":[1]}', ("one", "in.backlog", 1): '"b"', ("three", "ack_ns", 0): "4"}
    want = {(f, p, i): v for f, p, i, v in rows if p != "in.backlog" and f != "three"} | dense
    assert got == want
    left = captures.strip_sample_rows(captures.read_capture_rows(spark, f"{tmp_path}/c")).collect()
    assert sorted((r.file, r.path) for r in left) == [("one", "in.er"), ("two", "in.z"), ("two", "x")]
