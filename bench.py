"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import time

HEADLINES = (
    "s7_store_counts", "s7_staged_merge", "a9_write_accounting", "s1_single_events", "s4_log_publish", "a4_reconcile", "a5_set_digest",
    "j4_verify_content", "a6_percentiles", "a7_request_histogram", "a20_window_totals", "w1_ack_series", "w3_pending_gauge",
    "w5_peak_requests", "w6_segments", "w10_token_bucket", "w11_alert_cooldown", "w12_health_timeline", "w15_outbox_state",
    "j18_request_ids", "w18_offset_lag", "l1_orders", "g1_identities", "r17_secret_scan", "t1_ingest_stream",
)


def main() -> None:
    from tidemark.plans import CATALOG, Tables
    from tidemark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="16g")
    tables = Tables(spark, sf_dir)
    CATALOG["a20_window_totals"].build(tables).collect()  # start the executors' JIT and file listing
    took = {}
    for name in HEADLINES:
        start = time.time()
        CATALOG[name].build(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    events = tables.v_log.count()
    out = {
        "metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "log_records": events,
        "records_per_sec": {q: round(events / took[q]) for q in ("s7_staged_merge", "t1_ingest_stream")},
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
