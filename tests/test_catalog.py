"""Registered queries against their SQL at the smallest scale; TIDEMARK_ALL=1 runs every one."""

import os

import pytest

from tests.harness import compare, oracle_connection
from tidemark.plans import CATALOG

SF = "/root/testdata/sf0.001"
QUICK = (
    "s7_store_counts", "a4_reconcile", "a6_percentiles", "w3_pending_gauge", "w6_segments", "l1_conflicts", "r11_status", "s1_single_events", "v13_log_revalidation",
    "a5_set_digest", "a28_tree_fingerprints", "s12_artifact_files", "j16_artifact_diff", "r18_artifact_files", "s10_capture_rows", "p11_strip_capture_rows", "r20_capture_summaries",
    "j12_decode_rows", "j15_study_identity", "a15_completed_runs", "r12_registry_cardinality", "r14_transport", "r14_reports", "r14_cohort", "r_study_audit",
)


@pytest.mark.parametrize("name", list(CATALOG) if os.environ.get("TIDEMARK_ALL") else QUICK)
def test_equals_sql(spark, name):
    assert compare(spark, oracle_connection(SF), name, SF) == ""


def test_names_are_bound():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
