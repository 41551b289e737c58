"""Accept and reject literals of the event rules."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import json_text
from tidemark.operators import validation as v

UUID = "00000000-0000-4000-8000-000000000001"


def doc(payload="{}", extra="", event_id=UUID, kind="order_completed", at="2026-11-03T00:00:00Z"):
    return f'{{"event_id":"{event_id}","event_type":"{kind}","occurred_at":"{at}","payload":{payload}{extra}}}'.encode()


REJECT = {
    b"unicode": ['{"s":"\\u0000"}', '{"s":"\\ud800"}', '{"s":"\\udc00"}', '{"s":"\\ud800\\u0041"}'],
    b"payload_storable": ['{"n":1e1000000}', '{"n":1e-1000000}', '{"n":1e131072}', '{"n":1e-16384}', '{"n":' + "[" * 64 + "0" + "]" * 64 + "}"],
    b"payload_object": ["null", "[1]", "12"],
}
ACCEPT = ['{"s":"\\ud83d\\ude00"}', '{"s":"\\\\u0000"}', '{"s":"\\/"}', '{"n":1e131071}', '{"n":1e-16383}',
          '{"n":' + "[" * 63 + "0" + "]" * 63 + "}", '{"n":' + "9" * 5000 + "}"]


def classes(spark, docs, kind="event"):
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(docs)], "i int, raw binary")
    return [r.error_class for r in v.validate_events(df, "raw", kind=kind).orderBy("i").collect()]


def test_payload_literals(spark):
    want, docs = [], []
    for name, payloads in REJECT.items():
        docs += [doc(p) for p in payloads]
        want += [name.decode()] * len(payloads)
    docs += [doc(p) for p in ACCEPT]
    want += [None] * len(ACCEPT)
    assert classes(spark, docs) == want


def test_envelope_literals(spark):
    cases = [
        (doc().replace(b'"event_id":"' + UUID.encode() + b'",', b""), "event_id"), (doc(event_id="00000000-0000-0000-0000-000000000000"), "event_id"),
        (doc(event_id="bad"), "json"), (doc(kind=""), "event_type"), (doc(kind="x" * 129), "event_type"), (doc(at="no"), "json"),
        (doc(extra=',"tenant_id":"evil"'), "json"), (doc(extra=',"received_at":"2026-11-03T00:00:00Z"'), "json"), (doc() + b" {}", "trailing"),
        (doc('{"s":"\xff"}').replace("ÿ".encode(), b"\xff"), "unicode"), (doc('{"x":"' + "界" * 131072 + '"}'), "too_large"),
        (doc(), None), (doc().replace(b"event_type", b"EVENT_Type"), None), (doc(event_id="{" + UUID + "}"), None),
        (doc(event_id="urn:uuid:" + UUID), None), (doc(at="2026-11-03T25:00:00Z"), "json"), (doc(at="0001-01-01T00:00:00Z"), "occurred_at"),
    ]
    assert classes(spark, [d for d, _ in cases]) == [c for _, c in cases]


def test_log_envelope(spark):
    server = ',"tenant_id":"demo","received_at":"2026-11-03T00:00:00Z"'
    docs = [doc(extra=server), doc(extra=server.replace("demo", "")), doc()]
    assert classes(spark, docs, "envelope") == [None, "identity", "identity"]


@pytest.mark.parametrize("n,ok", [(100, True), (101, False), (0, False)])
def test_batch_sizes(spark, n, ok):
    body = b'{"events":[' + b",".join([doc()] * n) + b"]}"
    df = spark.createDataFrame([(1, bytearray(body))], "request_id int, body binary")
    rows = v.explode_batches(df, "body").collect()
    assert {r.request_valid for r in rows} == {ok}
    assert len(rows) == (n if ok else 1)


def test_batch_is_rejected_as_a_whole(spark):
    bodies = [b'{"events":[' + doc() + b",{}]}", b'{"events":[' + doc('{"x":"' + "x" * 262144 + '"}') + b"]}", b" " * 1048577]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "request_id int, body binary")
    got = {r.request_id: r.request_error for r in v.explode_batches(df, "body").collect()}
    assert got == {0: "event_id", 1: "too_large", 2: "too_large"}


def test_slices_keep_their_bytes():
    items = json_text.split_batch(b'{"events":[{"n":1e131071} , {"a" : 1.50}]}')[1]
    assert items == [b'{"n":1e131071}', b'{"a" : 1.50}']


def test_canonical_json_compares_as_float64():
    assert json_text.canonical('{"b":1.0,"a":-0}') == json_text.canonical('{"a":0,"b":1e0}')
    assert json_text.canonical('{"a":1e400}') is None  # valid to store, never equal


def test_encoded_envelope_validates_again(spark):
    df = spark.createDataFrame([(UUID, 'a"b<', "t")], "event_id string, event_type string, tenant string")
    at = F.lit("2026-01-02 03:04:05.5").cast("timestamp")
    log = v.encode_envelopes(df.select("event_id", "event_type", F.lit('{"x":1}').alias("payload"), F.col("tenant").alias("tenant_id"),
                                       at.alias("occurred_at"), at.alias("received_at")))
    row = v.validate_events(log.select("value"), "value", kind="envelope").first()
    assert row.valid and row.event_type == 'a"b<' and row.tenant_id == "t"


def test_documents_cut_where_a_value_is_due(spark):
    """The scanner says so by StopIteration, which must not leave its generator."""
    whole = doc().decode()
    docs = [whole[:at].encode() for at in range(1, len(whole))] + [doc(""), doc('{"a":}'), doc().replace(b":{}", b":,")]
    assert classes(spark, docs) == ["json"] * len(docs)
