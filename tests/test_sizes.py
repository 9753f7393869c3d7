"""Plans at sf0.1: what the driver holds must not follow the size of a table."""

import pytest

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["c2_remediations", "e5_case_digest", "g10_detection_metrics", "m10_discrepancies_to_violations"])
def test_no_fact_table_is_broadcast_by_estimate(spark, name):
    """Inspections, fields and boxes look small to the optimizer (compressed, before the explode) and are not."""
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    for line in plan.splitlines():
        assert "BroadcastHashJoin" not in line or "rule" in line, line
