"""Set and content reconciliation, tenancy, delivery outcomes and bounded labels."""

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import reconcile as r
from tidemark.operators import tenancy
from tidemark.operators import outbox as ob
from tidemark.operators.latency import count_map
from tidemark.plans.catalog import query
from tidemark.plans.delivery import STORED, stored

FLAGS = """flags AS (SELECT run_id, event_id, bool_or(set_name = 'attempted') AS att, bool_or(set_name = 'accepted') AS acc,
  bool_or(set_name = 'ambiguous') AS amb, bool_or(set_name = 'stored') AS sto, count(*) FILTER (WHERE set_name = 'stored') AS copies
  FROM v_sets GROUP BY run_id, event_id)"""


@query("a3_set_sizes", """
SELECT run_id, set_name, count(DISTINCT event_id) AS ids, count(*) - count(DISTINCT event_id) AS duplicates FROM v_sets GROUP BY run_id, set_name""")
def _(t):
    return r.set_sizes(t.v_sets)


@query("a4_reconcile", f"""WITH {FLAGS},
g AS (SELECT run_id, count(*) FILTER (WHERE att) AS attempted, count(*) FILTER (WHERE acc) AS accepted, count(*) FILTER (WHERE amb) AS ambiguous,
  count(*) FILTER (WHERE sto) AS stored, count(*) FILTER (WHERE acc AND NOT sto) AS missing,
  count(*) FILTER (WHERE sto AND NOT att AND NOT acc) AS unexpected, CAST(sum(copies) AS BIGINT) - count(*) FILTER (WHERE sto) AS duplicates,
  count(*) FILTER (WHERE amb AND sto) AS ambiguous_persisted, count(*) FILTER (WHERE amb AND NOT sto) AS ambiguous_unobserved
  FROM flags GROUP BY run_id)
SELECT *, missing = 0 AND unexpected = 0 AND duplicates = 0 AS correct FROM g""")
def _(t):
    return r.reconcile(t.v_sets)


@query("a5_set_digest", """
WITH ids AS (SELECT DISTINCT run_id, set_name, CAST(event_id AS STRING) AS m FROM v_sets),
leaves AS (SELECT run_id, set_name, left(sha256(m), 4) AS leaf, sha256(string_agg(m, chr(10) ORDER BY m)) AS d FROM ids GROUP BY 1, 2, 3),
tree AS (SELECT run_id, set_name, sha256(string_agg(concat(leaf, ':', d), chr(10) ORDER BY leaf)) AS tree_sha256 FROM leaves GROUP BY 1, 2)
SELECT i.run_id, i.set_name, count(*) AS ids, sha256(string_agg(m, chr(10) ORDER BY m)) AS sha256, max(tree_sha256) AS tree_sha256
FROM ids i JOIN tree t ON t.run_id = i.run_id AND t.set_name = i.set_name GROUP BY i.run_id, i.set_name""")
def _(t):
    return r.set_digest(t.v_sets)


@query("j5_missing", """
SELECT DISTINCT run_id, event_id FROM v_sets a WHERE set_name = 'accepted' AND NOT EXISTS (
  SELECT 1 FROM v_sets s WHERE s.set_name = 'stored' AND s.run_id = a.run_id AND s.event_id = a.event_id)""")
def _(t):
    return r.id_flags(t.v_sets).where(r.is_missing()).select("run_id", "event_id")


@query("j6_unexpected", """
SELECT DISTINCT run_id, event_id FROM v_sets a WHERE set_name = 'stored' AND NOT EXISTS (
  SELECT 1 FROM v_sets s WHERE s.set_name IN ('attempted', 'accepted') AND s.run_id = a.run_id AND s.event_id = a.event_id)""")
def _(t):
    return r.id_flags(t.v_sets).where(r.is_unexpected()).select("run_id", "event_id")


@query("j7_ambiguous", """
SELECT DISTINCT run_id, event_id, EXISTS (SELECT 1 FROM v_sets s WHERE s.set_name = 'stored' AND s.run_id = a.run_id AND s.event_id = a.event_id) AS stored
FROM v_sets a WHERE set_name = 'ambiguous'""")
def _(t):
    return r.id_flags(t.v_sets).where("ambiguous").select("run_id", "event_id", "stored")


@query("o1_distinct_ids", "SELECT DISTINCT run_id, set_name, event_id FROM v_sets")
def _(t):
    return t.v_sets.dropDuplicates(["run_id", "set_name", "event_id"])


RULES = f"""WITH {FLAGS}, wide AS (SELECT run_id, count(*) FILTER (WHERE acc AND NOT att) AS a, count(*) FILTER (WHERE amb AND NOT att) AS b,
  count(*) FILTER (WHERE acc AND NOT sto) AS c, count(*) FILTER (WHERE sto AND NOT att) AS d, count(*) FILTER (WHERE acc AND amb) AS e FROM flags GROUP BY run_id)
SELECT run_id, rule, violations = 0 AS passed, violations FROM (
  SELECT run_id, 'accepted_in_attempted' AS rule, a AS violations FROM wide UNION ALL SELECT run_id, 'ambiguous_in_attempted', b FROM wide
  UNION ALL SELECT run_id, 'accepted_in_stored', c FROM wide UNION ALL SELECT run_id, 'stored_in_attempted', d FROM wide
  UNION ALL SELECT run_id, 'accepted_ambiguous_disjoint', e FROM wide)"""


@query("o2_subset_rules", RULES + " WHERE rule <> 'accepted_ambiguous_disjoint'")
def _(t):
    return r.set_rules(t.v_sets).where("rule <> 'accepted_ambiguous_disjoint'")


@query("o3_disjoint_rule", RULES + " WHERE rule = 'accepted_ambiguous_disjoint'")
def _(t):
    return r.set_rules(t.v_sets).where("rule = 'accepted_ambiguous_disjoint'")


@query("o4_exact_sets", """
WITH ids AS (SELECT run_id, event_id, bool_or(set_name = 'accepted') AS e, count(*) FILTER (WHERE set_name = 'stored') AS a FROM v_sets
  WHERE set_name IN ('accepted', 'stored') GROUP BY 1, 2),
g AS (SELECT run_id, count(*) FILTER (WHERE e AND a = 0) AS missing, count(*) FILTER (WHERE NOT e) AS unexpected, count(*) FILTER (WHERE a > 1) AS repeated FROM ids GROUP BY 1)
SELECT *, missing + unexpected + repeated = 0 AS equal FROM g""")
def _(t):
    return r.exact_set(t.v_sets.where("set_name = 'accepted'"), t.v_sets.where("set_name = 'stored'"), ["run_id"], "event_id")


@query("o5_union_with_extras", """
SELECT run_id, set_name, event_id FROM v_sets WHERE event_id % 4 <> 0 UNION ALL SELECT run_id, set_name, event_id FROM v_sets WHERE event_id % 4 = 0""")
def _(t):
    return t.v_sets.where("event_id % 4 <> 0").unionByName(t.v_sets.where("event_id % 4 = 0"))


@query("o6_expected_first", """
SELECT tenant_id, event_id, event_type, payload FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY off) AS rn FROM v_log) WHERE rn = 1""")
def _(t):
    from tidemark.operators.store import first_wins

    return first_wins(t.v_log, ["event_id"], ["off"]).select("tenant_id", "event_id", "event_type", "payload")


def content_case(t):
    """Stored rows with planted faults: changed type, changed payload, other key order, absent, unknown and repeated rows."""
    e = t.events
    expected = e.where("event_id % 11 <> 0").select(
        "event_id", "event_type", F.col("ts").alias("occurred_at"), F.col("ts").alias("received_at"),
        F.expr("concat('{\"a\": 1.0, \"p\": ', props, '}')").alias("payload"), F.col("event_id").alias("position"),
    )
    kept = e.where("event_id % 101 <> 7").select(
        "event_id", F.expr("CASE WHEN event_id % 53 = 2 THEN 'other' ELSE event_type END").alias("event_type"),
        F.expr("CASE WHEN event_id % 59 = 3 THEN ts + INTERVAL 1 SECOND ELSE ts END").alias("occurred_at"),
        F.expr("CASE WHEN event_id % 61 = 4 THEN ts + INTERVAL 1 SECOND ELSE ts END").alias("received_at"),
        F.expr("CASE WHEN event_id % 47 = 5 THEN concat('{\"a\": 1.5, \"p\": ', props, '}') ELSE concat('{\"p\":', props, ',\"a\":1e0}') END").alias("payload"),
    )
    again = kept.where("event_id % 67 = 6")
    return kept.unionByName(again), expected


CONTENT = """WITH s AS (SELECT event_id, CASE WHEN event_id % 67 = 6 THEN 2 ELSE 1 END AS copies,
    event_id % 53 = 2 OR event_id % 59 = 3 OR event_id % 47 = 5{strict} AS bad FROM events WHERE event_id % 101 <> 7)
SELECT event_id, 'unexpected' AS finding, CAST(copies AS BIGINT) AS "rows" FROM s WHERE event_id % 11 = 0
UNION ALL SELECT event_id, 'mismatch', CAST(copies AS BIGINT) FROM s WHERE event_id % 11 <> 0 AND bad
UNION ALL SELECT event_id, 'missing', CAST(1 AS BIGINT) FROM events WHERE event_id % 11 <> 0 AND event_id % 101 = 7"""


@query("j4_verify_content", CONTENT.replace("{strict}", ""))
def _(t):
    have, want = content_case(t)
    return r.verify_content(have, want, want)


@query("j8_strict_table", CONTENT.replace("{strict}", " OR event_id % 61 = 4") + """
UNION ALL SELECT event_id, 'repeated', CAST(1 AS BIGINT) FROM s WHERE copies = 2""")
def _(t):
    have, want = content_case(t)
    return r.strict_table_check(have, want, ["event_id"])


@query("p4_case_population", f"""WITH {STORED}
SELECT event_id, event_type FROM stored WHERE tenant_id = 't3' AND (event_type = 'click' OR event_id IN (SELECT event_id FROM events WHERE event_id % 4 = 1))""")
def _(t):
    return r.case_population(stored(t), "t3", "click", t.events.where("event_id % 4 = 1")).select("event_id", "event_type")


@query("p5_payload_prefix", f"""WITH {STORED}
SELECT event_id, payload FROM stored WHERE tenant_id = 't3' AND (left(payload->>'k', 1) = '4' OR event_id IN (SELECT event_id FROM events WHERE event_id % 50 = 3))""")
def _(t):
    return r.prefix_population(stored(t), "t3", "$.k", "4", t.events.where("event_id % 50 = 3")).select("event_id", "payload")


@query("p6_payload_field", f"""WITH {STORED} SELECT event_id, payload->>'k' AS k FROM stored""")
def _(t):
    return stored(t).select("event_id", F.get_json_object("payload", "$.k").alias("k"))


@query("j3_observe_pending", f"""WITH {STORED}, pending AS (SELECT DISTINCT event_id FROM v_log)
SELECT p.event_id, s.occurred_at AS received_at, s.event_id IS NOT NULL AS observed FROM pending p LEFT JOIN stored s ON s.event_id = p.event_id""")
def _(t):
    table = stored(t).withColumnRenamed("occurred_at", "received_at")
    seen, waiting = r.observe_pending(t.v_log, table)
    return seen.withColumn("observed", F.lit(True)).unionByName(
        waiting.withColumn("observed", F.lit(False)), allowMissingColumns=True
    )


@query("j1_resolve_tenant", """
SELECT request_id, tenant_id, CASE WHEN request_id % 19 = 0 THEN 'missing' WHEN tenant_id IS NULL THEN 'invalid' ELSE 'ok' END AS auth FROM (
  SELECT q.request_id, CASE WHEN q.request_id % 19 = 0 THEN NULL ELSE k.tenant_id END AS tenant_id FROM v_requests q LEFT JOIN v_keymap k ON k.api_key = q.api_key)""")
def _(t):
    rid = F.col("request_id")
    header = F.when(rid % 38 == 0, F.lit(None)).when(rid % 19 == 0, "").when(rid % 2 == 0, F.concat(F.lit("Bearer "), "api_key")).otherwise(F.col("api_key"))
    return tenancy.resolve_tenant(t.v_requests.withColumn("authorization", header), t.v_keymap).select("request_id", "tenant_id", "auth")


@query("p16_auth_header", """SELECT request_id, api_key AS "key" FROM v_requests""")
def _(t):
    header = F.when(F.col("request_id") % 2 == 0, F.concat(F.lit("Bearer "), "api_key")).otherwise(F.col("api_key"))
    return t.v_requests.select("request_id", labels.bearer_key(header).alias("key"))


@query("v18_key_map", """
WITH keys AS (SELECT concat('k', CAST(c_custkey % 700 AS STRING)) AS api_key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS tenant_id FROM customer),
g AS (SELECT api_key, count(*) AS copies, bool_and(octet_length(encode(tenant_id)) BETWEEN 1 AND 128) AS ok FROM keys GROUP BY api_key)
SELECT api_key, CASE WHEN copies > 1 THEN 'duplicate' ELSE 'tenant' END AS fault FROM g WHERE copies > 1 OR NOT ok""")
def _(t):
    keys = t.customer.select(
        F.concat(F.lit("k"), (F.col("c_custkey") % 700).cast("string")).alias("api_key"),
        F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("tenant_id"),
    )
    return tenancy.key_map_faults(keys)


@query("p13_delivery_outcome", """
SELECT request_id, CASE WHEN request_id % 23 = 0 OR status IS NULL OR status >= 500 THEN 'ambiguous' WHEN status <> 202 THEN 'rejected'
  WHEN request_id % 29 = 0 THEN 'ambiguous' ELSE 'accepted' END AS outcome FROM v_requests""")
def _(t):
    rid = F.col("request_id")
    sent = F.array(rid, rid + 1)
    q = t.v_requests.select(
        "request_id", "status", sent.alias("sent_ids"), (rid % 23 == 0).alias("transport_error"),
        F.when(rid % 29 == 0, F.reverse(sent)).otherwise(sent).alias("returned_ids"),
    )
    return tenancy.classify_delivery(q).select("request_id", "outcome")


@query("p14_retryable", """
SELECT request_id, CASE WHEN request_id % 23 = 0 THEN true WHEN request_id % 31 = 0 THEN false
  ELSE coalesce(status = 429 OR status >= 500, false) END AS retryable FROM (
  SELECT request_id, CASE WHEN request_id % 37 = 0 THEN 429 ELSE status END AS status FROM v_requests)""")
def _(t):
    rid = F.col("request_id")
    failure = F.when(rid % 23 == 0, F.when(rid % 2 == 0, "connection").otherwise("bad_acknowledgement")).when(rid % 31 == 0, "tls")
    q = t.v_requests.withColumn("failure", failure).withColumn("status", F.when(rid % 37 == 0, 429).otherwise(F.col("status")))
    return tenancy.classify_retry(q).select("request_id", "retryable")


@query("p15_outbox_outcome", """
SELECT request_id, CASE WHEN status = 202 AND request_id % 29 <> 0 THEN 'acknowledged' WHEN status IN (400, 413) THEN 'rejected' ELSE 'pending' END AS state,
  CASE WHEN status = 202 AND request_id % 29 <> 0 THEN NULL WHEN status = 202 OR status IS NULL THEN 'delivery_uncertain'
       ELSE concat('http_', CAST(status AS STRING)) END AS error FROM v_requests""")
def _(t):
    state, error = ob.dispatch_outcome(F.col("status"), F.col("request_id") % 29 != 0)
    return t.v_requests.select("request_id", state.alias("state"), error.alias("error"))


@query("w14_retry_audit", """
WITH a AS (SELECT o_custkey AS item, o_orderkey AS at_ms, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt FROM orders),
d AS (SELECT item, at_ms, attempt, CAST(least(2000, 100 * pow(2, attempt - 1)) AS BIGINT) AS delay_ms FROM a),
w AS (SELECT *, CAST(sum(delay_ms) OVER (PARTITION BY item ORDER BY attempt) AS BIGINT) AS waited_ms FROM d)
SELECT *, waited_ms > 15000 AS exhausted FROM w""")
def _(t):
    attempts = t.orders.select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("at_ms"))
    return tenancy.retry_audit(attempts, tenancy.WRITER_POLICY)


@query("w14_client_retries", """
WITH a AS (SELECT o_custkey AS item, o_orderkey AS at_ms, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt FROM orders),
d AS (SELECT item, at_ms, attempt, CAST(least(200, 100 * pow(2, attempt - 1)) AS BIGINT) AS delay_ms FROM a)
SELECT *, CAST(sum(delay_ms) OVER (PARTITION BY item ORDER BY attempt) AS BIGINT) AS waited_ms, attempt >= 3 AS exhausted FROM d""")
def _(t):
    attempts = t.orders.select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("at_ms"))
    return tenancy.retry_audit(attempts, tenancy.CLIENT_POLICY)


@query("p7_bounded_labels", """
SELECT page_id, CASE WHEN page_id % 7 < 5 THEN ['single', 'batch', 'health', 'ready', 'metrics'][CAST(page_id % 7 + 1 AS INTEGER)] ELSE 'other' END AS route,
  CASE WHEN page_id % 4 = 0 THEN '202' WHEN page_id % 4 = 1 THEN '503' ELSE 'other' END AS status,
  CASE WHEN page_id % 3 = 0 THEN 'timeout' WHEN page_id % 3 = 1 THEN 'saturated' ELSE 'error' END AS outcome,
  CASE WHEN page_id % 3 = 0 THEN 'timeout' WHEN page_id % 3 = 1 THEN 'buffer_saturated' ELSE 'broker_error' END AS reason FROM pages""")
def _(t):
    pid = F.col("page_id")
    named = F.get(F.array(*[F.lit(x) for x in labels.ROUTES]), (pid % 7).cast("int"))
    route = F.coalesce(named, F.col("url"))
    status = F.when(pid % 4 == 0, "202").when(pid % 4 == 1, "503").when(pid % 4 == 2, "418").otherwise("arbitrary")
    outcome = F.when(pid % 3 == 0, "timeout").when(pid % 3 == 1, "saturated").otherwise(F.col("url"))
    reason = F.when(pid % 3 == 0, "timeout").when(pid % 3 == 1, "buffer_saturated").otherwise(F.col("url"))
    return t.pages.select(
        "page_id", labels.route(route).alias("route"), labels.status(status).alias("status"),
        labels.outcome(outcome).alias("outcome"), labels.failure_reason(reason).alias("reason"),
    )


@query("p8_error_class", """
SELECT seq, CASE seq % 6 WHEN 0 THEN 'deadline' WHEN 1 THEN 'canceled' WHEN 2 THEN 'database' WHEN 3 THEN 'network' ELSE 'operation' END AS error_class,
  CASE WHEN seq % 6 = 2 AND seq % 4 = 2 THEN '42501' END AS sqlstate FROM v_operations WHERE failed""")
def _(t):
    n = F.col("seq") % 6
    cause = F.when(n == 0, "deadline").when(n == 1, "canceled").when(n == 2, "database").when(n == 3, "network").otherwise("secret text")
    code = F.when(F.col("seq") % 4 == 2, "42501").otherwise("private:1")
    return t.v_operations.where("failed").select("seq", labels.error_class(cause).alias("error_class"), labels.sqlstate(cause, code).alias("sqlstate"))


CODES = ("EMFILE", "ENFILE", "EADDRNOTAVAIL", "EADDRINUSE", "ECONNREFUSED", "canceled", "deadline", "ETIMEDOUT", "dns", "EPIPE")
CLASS_SQL = """CASE WHEN request_id % 3 = 0 THEN NULL ELSE ['fd_limit', 'fd_limit', 'address_unavailable', 'address_unavailable', 'connection_refused',
  'cancelled', 'timeout', 'timeout', 'dns', 'other'][CAST(request_id % 10 + 1 AS INTEGER)] END"""


def socket_code():
    rid = F.col("request_id")
    return F.when(rid % 3 != 0, F.get(F.array(*[F.lit(c) for c in CODES]), (rid % 10).cast("int")))


@query("p9_connection_errors", f"SELECT request_id, {CLASS_SQL} AS error FROM v_requests")
def _(t):
    return t.v_requests.select("request_id", labels.connection_error(socket_code()).alias("error"))


@query("a29_count_maps", f"""
WITH c AS (SELECT run_id, {CLASS_SQL} AS error, count(*) AS n FROM v_requests GROUP BY 1, 2)
SELECT run_id, string_agg(concat(error, '=', CAST(n AS STRING)), ',' ORDER BY error) AS errors FROM c WHERE error IS NOT NULL GROUP BY run_id""")
def _(t):
    maps = count_map(t.v_requests, ["run_id"], labels.connection_error(socket_code()), "m")
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return maps.select("run_id", text.alias("errors"))


@query("p12_safe_names", """
SELECT page_id, CASE WHEN regexp_full_match(name, '[a-zA-Z0-9._-]{1,249}') THEN name END AS topic
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE concat('events.', CAST(page_id AS STRING)) END AS name FROM pages)""")
def _(t):
    name = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("events."), F.col("page_id").cast("string")))
    return t.pages.select("page_id", labels.safe_name(name).alias("topic"))
