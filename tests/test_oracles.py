"""Catalog queries against their oracle statements.

A sample of each family runs by default; PANELCHECK_FULL=1 runs all of them.
"""

import os

import pytest
from compare import compare, connect

from __spark_entry__ import oracle_sql, queries

SAMPLE = [
    "a5_analytics_summary", "a6_compliance_trends_filtered", "a8_hotspots_by_rule", "a11_officer_throughput",
    "b1_batch_metrics", "b3_batch_manifest", "c1_self_check_scorecards", "c2_remedial_texts",
    "e2_audit_entry_hash", "e4_verify_audit_chain", "e5_case_digest", "f1_search_inspections", "f7_inspection_summaries",
    "g6_region_issues", "g8_near_duplicates", "g10_detection_metrics", "g13_extraction_gaps", "g16_corroborate", "g21_coco_annotations",
    "k2_quality_scores", "k5_valid_gtin", "l2_verify_registrations", "l5_idempotent_create",
    "m1_cross_match", "m10_discrepancies_to_violations", "o1_orphans", "r12_register_pack", "r13_evaluate_rules",
    "s6_load_annotation_tasks", "s9_replace_snapshot", "t1_sync_images", "t2_dedup_keys", "t4_sync_state", "t7_latency_quantiles", "t11_sustained", "t12_late_counts",
    "v3_apply_reviews_single", "v5_status_after_review", "v6_evidence_items", "x2_extract_mrp_direct", "x7_extract_net_quantity", "x21_words_to_lines",
]
NAMES = sorted(queries()) if os.environ.get("PANELCHECK_FULL") else SAMPLE


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, folder, name):
    problem, rows = compare(spark, con, name, queries()[name], oracle_sql().get(name), folder)
    assert problem is None, problem
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
