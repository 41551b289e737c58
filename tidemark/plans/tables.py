"""The given parquet tables and the derived inputs, as lazy DataFrames.

Derived views are plain SQL with integer arithmetic, the same text for every
engine; ``with_views`` puts the ones a statement uses in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import scratch_dir, ship_package

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

# Delivery log: every 7th event comes again later with other content, every 13th is poison.
VIEWS["v_log"] = """
SELECT concat('t', CAST(event_id % 5 AS STRING)) AS tenant_id, event_id, event_type, ts AS occurred_at, props AS payload,
       event_id % 3 AS part, event_id AS off, CAST(0 AS BIGINT) AS attempt, event_id % 13 <> 0 AS valid
FROM events
UNION ALL
SELECT concat('t', CAST(event_id % 5 AS STRING)), event_id, 'replayed', ts, '{"k": -1}',
       event_id % 3, event_id + 1000000000, CAST(1 AS BIGINT), event_id % 13 <> 0
FROM events WHERE event_id % 7 = 0"""

# One request per order in four runs: 12 s of starts against a 10 s window.
VIEWS["v_requests"] = """
SELECT o_orderkey AS request_id, o_custkey % 4 AS run_id,
       (o_orderkey * 7919000) % 12000000000 AS started_ns,
       (o_orderkey * 104729) % 500000000 + 1 AS elapsed_ns,
       (o_orderkey * 7919000) % 12000000000 + (o_orderkey * 104729) % 500000000 + 1 AS finished_ns,
       1 + o_orderkey % 100 AS events,
       CASE WHEN o_orderkey % 10 = 7 THEN 503 WHEN o_orderkey % 10 = 8 THEN 400 WHEN o_orderkey % 10 = 9 THEN NULL ELSE 202 END AS status,
       concat('k', CAST(o_custkey % 6 AS STRING)) AS api_key
FROM orders"""

# k5 has no tenant.
VIEWS["v_keymap"] = """
SELECT DISTINCT concat('k', CAST(c_custkey % 5 AS STRING)) AS api_key, concat('t', CAST(c_custkey % 5 AS STRING)) AS tenant_id
FROM customer"""

# ID sets of four runs, with missing, unexpected and repeated rows.
VIEWS["v_sets"] = """
SELECT user_id % 4 AS run_id, 'attempted' AS set_name, event_id FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT user_id % 4, 'accepted', event_id FROM events WHERE event_id % 11 <> 0 AND event_id % 10 < 7
UNION ALL SELECT user_id % 4, 'ambiguous', event_id FROM events WHERE event_id % 11 <> 0 AND event_id % 10 = 7
UNION ALL SELECT user_id % 4, 'stored', event_id FROM events WHERE event_id % 11 <> 0 AND event_id % 10 < 7 AND event_id % 101 <> 0
UNION ALL SELECT user_id % 4, 'stored', event_id FROM events WHERE event_id % 11 <> 0 AND event_id % 20 = 7
UNION ALL SELECT user_id % 4, 'stored', event_id FROM events WHERE event_id % 11 = 0 AND event_id % 9 = 0
UNION ALL SELECT user_id % 4, 'stored', event_id FROM events
          WHERE event_id % 11 <> 0 AND event_id % 10 = 3 AND event_id % 50 = 3 AND event_id % 101 <> 0"""

VIEWS["v_samples"] = """
SELECT c_custkey AS sample_id, c_custkey % 4 AS run_id, (c_custkey * 7777777) % 13000000000 AS sample_ns, c_custkey % 13 <> 0 AS available
FROM customer"""

# Log positions: some snapshots lag, some race ahead, some lack a partition.
VIEWS["v_offsets"] = """
SELECT o_custkey AS snapshot_id, o_orderkey % 3 AS part, max(o_orderkey) AS end_off,
       max(o_orderkey) - (o_custkey % 5) + CASE WHEN o_custkey % 17 = 0 THEN 9 ELSE 0 END AS committed_off
FROM orders GROUP BY o_custkey, o_orderkey % 3"""

VIEWS["v_operations"] = """
SELECT event_id AS seq, ts AS at, concat('t', CAST(user_id % 5 AS STRING)) AS tenant_id,
       CASE WHEN user_id % 4 = 0 THEN 'startup' WHEN user_id % 4 = 1 THEN 'storage' WHEN user_id % 4 = 2 THEN 'quarantine' ELSE 'progress' END AS kind,
       event_type = 'error' AS failed
FROM events"""

# Order admissions: every 9th order twice, every 27th with another amount.
VIEWS["v_order_requests"] = """
SELECT o_orderkey AS order_id, CAST(o_orderkey * 37 % 100000 AS BIGINT) AS amount_cents, CAST(0 AS BIGINT) AS attempt FROM orders
UNION ALL
SELECT o_orderkey, CAST(o_orderkey * 37 % 100000 + CASE WHEN o_orderkey % 27 = 0 THEN 1 ELSE 0 END AS BIGINT), CAST(1 AS BIGINT)
FROM orders WHERE o_orderkey % 9 = 0"""

# Outbox changes: 0 pending, 1 first dispatch, 2 a later success.
VIEWS["v_outbox_feed"] = """
SELECT o_orderkey AS event_id, CAST(0 AS BIGINT) AS seq, 'pending' AS state, CAST(NULL AS STRING) AS error FROM orders
UNION ALL
SELECT o_orderkey, CAST(1 AS BIGINT),
       CASE WHEN o_orderkey % 10 = 8 THEN 'rejected' WHEN o_orderkey % 10 IN (7, 9) THEN 'pending' ELSE 'acknowledged' END,
       CASE WHEN o_orderkey % 10 = 8 THEN 'http_400' WHEN o_orderkey % 10 = 7 THEN 'http_503' WHEN o_orderkey % 10 = 9 THEN 'delivery_uncertain' ELSE NULL END
FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL
SELECT o_orderkey, CAST(2 AS BIGINT), 'acknowledged', CAST(NULL AS STRING) FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 20 = 7"""

# Three methods x three repetitions per case, with holes.
VIEWS["v_method_runs"] = """
SELECT CAST(floor((s_suppkey - 1) / 9.0) AS BIGINT) AS case_id,
       CASE WHEN s_suppkey % 3 = 0 THEN 'insert' WHEN s_suppkey % 3 = 1 THEN 'batch-insert' ELSE 'copy-merge' END AS method,
       CAST(floor(((s_suppkey - 1) % 9) / 3.0) AS BIGINT) + 1 AS repetition,
       CAST(5000 AS BIGINT) AS submitted, 5000 - s_suppkey % 7 AS inserted, s_suppkey % 7 AS duplicates,
       (s_suppkey * 104729) % 1000000000 + 1 AS elapsed_ns, s_suppkey % 29 <> 4 AS correct
FROM supplier WHERE s_suppkey % 37 <> 0"""

# Raw single-event documents; fault 0 and 1 are valid, each other number is one kind of damage.
VIEWS["v_raw"] = """
SELECT event_id, event_id % 24 AS fault,
  CASE event_id % 24
    WHEN 22 THEN 'not json'
    ELSE concat('{"event_id":',
      CASE event_id % 24 WHEN 2 THEN '"00000000-0000-0000-0000-000000000000"' WHEN 3 THEN '"bad"' WHEN 4 THEN '7'
        ELSE concat('"', lpad(CAST(event_id AS STRING), 8, '0'), '-0000-4000-8000-000000000001"') END,
      CASE event_id % 24 WHEN 1 THEN ',"Event_TYPE":"' ELSE ',"event_type":"' END,
      CASE event_id % 24 WHEN 5 THEN '' WHEN 6 THEN repeat('x', 129) WHEN 7 THEN concat(chr(92), 'ud800') ELSE event_type END,
      '","occurred_at":"',
      CASE event_id % 24 WHEN 8 THEN '2024-01-01' WHEN 9 THEN '0001-01-01T00:00:00Z' WHEN 10 THEN '2024-02-30T00:00:00Z'
        ELSE concat('2024-01-01T00:00:', lpad(CAST(event_id % 60 AS STRING), 2, '0'), '.5+02:00') END,
      '","payload":',
      CASE event_id % 24 WHEN 11 THEN 'null' WHEN 12 THEN '[1]' WHEN 13 THEN '12' WHEN 14 THEN '{"n":1e131072}' WHEN 15 THEN '{"n":1e-16384}'
        WHEN 16 THEN concat('{"s":"', chr(92), 'u0000"}') WHEN 17 THEN concat('{"n":', repeat('[', 64), '0', repeat(']', 64), '}')
        WHEN 18 THEN concat('{"n":', repeat('[', 63), '0', repeat(']', 63), '}') WHEN 19 THEN '{"n":1e131071}' ELSE props END,
      CASE event_id % 24 WHEN 20 THEN ',"tenant_id":"evil"}' WHEN 21 THEN '} {}' WHEN 23 THEN ',}' ELSE '}' END)
  END AS raw
FROM events"""

# Run reports with every kind of limit and status.
VIEWS["v_runs"] = """
SELECT c_custkey AS run_id, c_custkey % 120 AS case_id, 1 + c_custkey % 3 AS repetition,
  CASE WHEN c_custkey % 8 = 1 THEN c_custkey % 7 ELSE 0 END AS generator_missed, CASE WHEN c_custkey % 9 = 2 THEN 3 ELSE 0 END AS late_schedules,
  CASE WHEN c_custkey % 10 = 3 THEN 2 ELSE 0 END AS rejected, CASE WHEN c_custkey % 11 = 4 THEN 5 ELSE 0 END AS ambiguous,
  CASE WHEN c_custkey % 12 = 5 THEN 1 ELSE 0 END AS attempted_after_window, CASE WHEN c_custkey % 13 = 6 THEN 1 ELSE 0 END AS accepted_after_window,
  CASE WHEN c_custkey % 14 = 7 THEN 1 ELSE 0 END AS observer_late_polls, CASE WHEN c_custkey % 15 = 8 THEN 1 ELSE 0 END AS observer_outages,
  CASE WHEN c_custkey % 16 = 9 THEN 1 ELSE 0 END AS observer_slow_queries,
  CASE c_custkey % 17 WHEN 10 THEN 'failed' WHEN 11 THEN 'partial' WHEN 12 THEN 'not_run' ELSE 'complete' END AS observation_status,
  c_custkey % 31 <> 13 AS correct, c_custkey % 37 = 14 AS aborted, c_custkey % 5 <> 2 AS control_ok,
  c_custkey * 1000003 % 90000 AS p95_ns, c_custkey % 29 AS peak_open, c_custkey * 7919 % 1000000007 AS acquire_ns, c_custkey % 41 AS requests
FROM customer"""

# Fault traces: up to six per run.
VIEWS["v_faults"] = """
SELECT o_custkey AS run_id, o_custkey % 120 AS case_id, o_orderkey AS fault_id, o_orderkey % 100000 * 1000 AS planned_ns,
  o_orderkey % 100000 * 1000 + CASE WHEN o_orderkey % 211 = 7 THEN 300000000 ELSE 1000 END AS elapsed_ns,
  CASE WHEN o_orderkey % 2 = 0 THEN 'stop_requested' ELSE 'restored' END AS action
FROM orders WHERE o_orderkey % 3 = 1"""

_NAME = re.compile(r"\bv_[a-z_]+\b")


def used_views(sql: str) -> list[str]:
    """Views a statement names, each after the views it needs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    names = used_views(sql)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in names)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_SAVED: dict[tuple[str, str, str], str] = {}
_BUILT: dict[tuple[str, str, str], object] = {}


class Tables:
    """Attribute access to one scale's tables: ``t.orders``, ``t.v_log``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE_TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                self._seen[name] = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._seen[name]

    def saved(self, name: str, build) -> DataFrame:
        """A derived table written once per application to the shared folder, then read back.

        This cuts long plans and lets several queries share the work; a lost executor
        costs nothing that is already written.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _SAVED:
            path = scratch_dir(self.spark, name)
            build().write.mode("overwrite").parquet(path)
            _SAVED[key] = path
        return self.spark.read.parquet(_SAVED[key])

    def once(self, name: str, build):
        """Whatever ``build`` returns, built once per application and scale."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _BUILT:
            _BUILT[key] = build()
        return _BUILT[key]

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the given tables and views by name."""
        body = with_views(text) if _NAME.search(text) else text
        names = [n for n in BASE_TABLES if re.search(rf"\b{n}\b", body)]
        marked = body.replace("{", "{{").replace("}", "}}")
        for n in names:
            marked = re.sub(rf"(?<=FROM ){n}\b", "{" + n + "}", marked)
            marked = re.sub(rf"(?<=JOIN ){n}\b", "{" + n + "}", marked)
        return self.spark.sql(marked, **{n: getattr(self, n) for n in names})
