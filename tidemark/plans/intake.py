"""Validation, acceptance and publication of raw documents."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import validation as v
from tidemark.plans.catalog import query

FAULTS = """CASE
  WHEN fault IN (3, 4, 22, 23, 8, 10, 20) THEN 'json' WHEN fault = 2 THEN 'event_id' WHEN fault IN (5, 6) THEN 'event_type'
  WHEN fault IN (7, 16) THEN 'unicode' WHEN fault = 9 THEN 'occurred_at' WHEN fault IN (11, 12, 13) THEN 'payload_object'
  WHEN fault IN (14, 15, 17) THEN 'payload_storable' WHEN fault = 21 THEN 'trailing' END"""


@query("s1_single_events", f"""
SELECT event_id AS source_id, {FAULTS} IS NULL AS valid, {FAULTS} AS error_class,
       CASE WHEN {FAULTS} IS NULL THEN concat(lpad(CAST(event_id AS STRING), 8, '0'), '-0000-4000-8000-000000000001') END AS event_id,
       CASE WHEN {FAULTS} IS NULL THEN event_type END AS event_type
FROM (SELECT r.event_id, r.fault, e.event_type FROM v_raw r JOIN events e ON e.event_id = r.event_id)""")
def _(t):
    raw = t.v_raw.select(F.col("event_id").alias("source_id"), "raw")
    return v.validate_events(raw, "raw").select("source_id", "valid", "error_class", "event_id", "event_type")


@query("v13_log_revalidation", f"""
SELECT CASE WHEN fault = 20 THEN 'valid' ELSE coalesce({FAULTS}, CASE WHEN event_id % 5 = 1 THEN 'identity' END, 'valid') END AS outcome, count(*) AS n
FROM v_raw GROUP BY 1""")
def _(t):
    """The same rules over log values: a caller document plus the server's fields. Of a name given twice the last one counts."""
    raw = t.v_raw.select(
        F.when(
            F.col("raw").startswith("{"),
            F.concat(
                F.lit('{"tenant_id":"'), F.when(F.col("event_id") % 5 == 1, "").otherwise("t"),
                F.lit('","received_at":"2024-01-02T00:00:00Z",'), F.expr("substr(raw, 2)"),
            ),
        ).otherwise(F.col("raw")).alias("value")
    )
    return (
        v.validate_events(raw, "value", kind="envelope")
        .groupBy(F.coalesce("error_class", F.lit("valid")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


VIEW_BATCHES = """batches AS (
  SELECT CAST(floor(event_id / 20.0) AS BIGINT) AS request_id, count(*) AS items,
         min(CASE WHEN fault >= 2 AND fault NOT IN (18, 19) THEN event_id END) AS first_bad,
         bool_or(fault IN (7, 16)) AS unicode, bool_or(fault IN (21, 22, 23)) AS broken
  FROM v_raw GROUP BY 1)"""


@query("s2_batch_requests", f"""WITH {VIEW_BATCHES}
SELECT b.request_id, b.first_bad IS NULL AS request_valid,
       CASE WHEN b.unicode THEN 'unicode' WHEN b.broken THEN 'json' ELSE (SELECT {FAULTS} FROM v_raw r WHERE r.event_id = b.first_bad) END AS request_error,
       CASE WHEN b.unicode OR b.broken THEN CAST(0 AS BIGINT) ELSE b.items END AS items
FROM batches b""")
def _(t):
    """Twenty documents to a request; one bad item or a damaged body rejects the request."""
    bodies = (
        t.v_raw.groupBy(F.floor(F.col("event_id") / 20).alias("request_id"))
        .agg(F.array_sort(F.collect_list(F.struct("event_id", "raw"))).alias("docs"))
        .select("request_id", F.concat(F.lit('{"events":['), F.concat_ws(",", "docs.raw"), F.lit("]}")).alias("body"))
    )
    return (
        v.explode_batches(bodies, "body")
        .groupBy("request_id", "request_valid", "request_error")
        .agg(F.count("position").alias("items"))
    )


@query("v1_byte_limits", """
SELECT doc_id, octet_length(encode(repeat(text, CAST(1 + doc_id % 8 AS INTEGER)))) AS bytes,
       octet_length(encode(repeat(text, CAST(1 + doc_id % 8 AS INTEGER)))) > 262144 AS event_too_large,
       octet_length(encode(repeat(text, CAST(1 + doc_id % 8 AS INTEGER)))) > 266240 AS envelope_too_large,
       octet_length(encode(repeat(text, CAST(1 + doc_id % 8 AS INTEGER)))) > 1048576 AS request_too_large
FROM documents""")
def _(t):
    size = F.octet_length(F.repeat("text", (1 + F.col("doc_id") % 8).cast("int")))
    return t.documents.select(
        "doc_id", size.cast("bigint").alias("bytes"), *[(size > n).alias(f"{k}_too_large") for k, n in v.LIMITS.items()]
    )


@query("v2_utf8", "SELECT doc_id, doc_id % 10 <> 3 AS valid FROM documents")
def _(t):
    raw = F.encode("text", "utf-8")
    damaged = F.when(F.col("doc_id") % 10 == 3, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return t.documents.select("doc_id", F.is_valid_utf8(damaged).alias("valid"))


@query("v6_event_id", """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (5, 6, 7) THEN NULL
    ELSE concat(lpad(CAST(o_orderkey AS STRING), 8, '0'), '-00ab-4000-8000-000000000001') END AS event_id, o_orderkey % 8 NOT IN (4, 5, 6, 7) AS valid
FROM orders WHERE o_orderkey % 8 <> 4
UNION ALL SELECT o_orderkey, '00000000-0000-0000-0000-000000000000', false FROM orders WHERE o_orderkey % 8 = 4""")
def _(t):
    key = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    plain = F.concat(key, F.lit("-00ab-4000-8000-000000000001"))
    form = F.col("o_orderkey") % 8
    text = (
        F.when(form == 0, plain).when(form == 1, F.upper(plain)).when(form == 2, F.concat(F.lit("urn:uuid:"), plain))
        .when(form == 3, F.when(F.col("o_orderkey") % 16 == 3, F.concat(F.lit("{"), plain, F.lit("}"))).otherwise(F.replace(plain, F.lit("-"), F.lit(""))))
        .when(form == 4, F.lit(tx.NIL_UUID)).when(form == 5, F.concat(plain, F.lit("0"))).when(form == 6, F.lit(""))
    )
    return t.orders.select("o_orderkey", tx.uuid_text(text).alias("event_id"), v.event_id_rule(text).alias("valid"))


@query("v7_event_type", """
SELECT event_id, event_id % 4 IN (0, 3) AS valid FROM events""")
def _(t):
    case = F.col("event_id") % 4
    text = (
        F.when(case == 0, F.col("event_type")).when(case == 1, F.repeat(F.lit("é"), F.lit(65)))
        .when(case == 2, F.concat(F.col("event_type"), F.lit("\0"))).otherwise(F.repeat(F.lit("é"), F.lit(64)))
    )
    return t.events.select("event_id", tx.bounded_text(text).alias("valid"))


@query("v8_occurred_at", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN date_trunc('second', ts)
    WHEN event_id % 6 = 1 THEN ts WHEN event_id % 6 = 2 THEN ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE END AS occurred_at FROM events""")
def _(t):
    case = F.col("event_id") % 6
    clock = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(case == 0, F.concat(clock, F.lit("Z"))).when(case == 1, F.concat(micros, F.lit("999Z")))
        .when(case == 2, F.concat(micros, F.lit("+05:30"))).when(case == 3, F.date_format("ts", "yyyy-MM-dd"))
        .when(case == 4, F.lit(tx.ZERO_TIME)).otherwise(F.concat(F.replace(clock, F.lit("T"), F.lit(" ")), F.lit("Z")))
    )
    return t.events.select("event_id", tx.rfc3339(text).cast("timestamp_ntz").alias("occurred_at"))


@query("v12_tenant", """
SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AS accepted FROM customer""")
def _(t):
    key = F.col("c_custkey")
    rows = t.customer.select(
        "c_custkey",
        F.when(key % 3 == 0, F.when(key % 2 == 0, "").otherwise(F.repeat(F.lit("t"), F.lit(129)))).otherwise(F.col("c_name")).alias("tenant"),
        F.when(key % 7 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("at"),
    )
    return v.accept(rows, "tenant", "at").select("c_custkey", "accepted")


@query("v14_http_outcomes", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 6 = 5 THEN 401 WHEN o_orderkey % 11 = 0 THEN 429 WHEN o_orderkey % 13 = 0 THEN 413
  WHEN o_orderkey % 7 = 0 THEN 400 WHEN o_orderkey % 17 = 0 THEN 503 ELSE 202 END AS status FROM orders) GROUP BY status""")
def _(t):
    key = F.col("o_orderkey")
    error = F.when(key % 13 == 0, "too_large").when(key % 7 == 0, "json")
    status = v.http_outcome(error, F.col("o_custkey") % 6 != 5, key % 11 == 0, key % 17 != 0)
    return t.orders.select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("p1_accept", """
SELECT r.event_id AS source_id, ok AS accepted, CASE WHEN ok THEN concat('t', CAST(r.event_id % 5 AS STRING)) END AS tenant_id,
       CASE WHEN ok THEN TIMESTAMP '2024-02-01 00:00:00' END AS received_at,
       CASE WHEN r.fault = 18 THEN concat('{"n":', repeat('[', 63), '0', repeat(']', 63), '}') WHEN r.fault = 19 THEN '{"n":1e131071}' WHEN ok THEN e.props END AS payload,
       CASE WHEN ok THEN TIMESTAMP '2023-12-31 22:00:00' + INTERVAL 1 SECOND * (r.event_id % 60) + INTERVAL 500 MILLISECOND END AS occurred_at
FROM (SELECT *, fault IN (0, 1, 18, 19) AS ok FROM v_raw) r JOIN events e ON e.event_id = r.event_id""")
def _(t):
    """Every document: those that are not accepted stay, without their fields."""
    raw = t.v_raw.select(
        F.col("event_id").alias("source_id"), "raw", F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("tenant"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("at"),
    )
    ok = F.col("valid") & F.col("accepted")
    done = v.accept(v.validate_events(raw, "raw"), "tenant", "at").withColumns({
        "received_at": F.col("received_at").cast("timestamp_ntz"), "occurred_at": F.col("occurred_at").cast("timestamp_ntz"),
    })
    return done.select("source_id", ok.alias("accepted"), *[F.when(ok, F.col(c)).alias(c) for c in ("tenant_id", "received_at", "payload", "occurred_at")])


@query("s4_log_publish", """
SELECT concat(tenant_id, ':', CAST(event_id AS STRING)) AS "key",
       concat('{"event_id":"', CAST(event_id AS STRING), '","event_type":"', event_type, '","occurred_at":"2024-01-01T00:00:00.5Z","payload":', payload,
              ',"tenant_id":"', tenant_id, '","received_at":"2024-01-02T00:00:00Z"}', chr(10)) AS "value", false AS too_large
FROM v_log WHERE valid""")
def _(t):
    log = t.v_log.where("valid").select(
        "tenant_id", "event_id", "event_type", "payload",
        F.lit("2024-01-01 00:00:00.5").cast("timestamp").alias("occurred_at"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("received_at"),
    )
    return v.encode_envelopes(log).select(F.col("key").cast("string"), F.col("value").cast("string"), "too_large")


@query("v15_order_input", """
SELECT o_orderkey, o_orderkey % 5 NOT IN (1, 2, 3) AS valid FROM orders""")
def _(t):
    from tidemark.operators.outbox import order_input_valid

    case = F.col("o_orderkey") % 5
    ident = F.when(case == 1, "").when(case == 2, F.repeat(F.lit("o"), F.lit(129))).otherwise(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")))
    amount = F.when(case == 3, F.lit(-1)).otherwise(F.col("o_orderkey"))
    return t.orders.select("o_orderkey", order_input_valid(ident, amount).alias("valid"))
