"""Children that are made from a parent's rows stay where their parent is."""

import re

import pytest

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["r2_first_field_per_type", "e5_case_digest", "r6_eval_legibility", "r8_overall_verdict"])
def test_children_are_not_exchanged_by_their_inspection(spark, name):
    """The exchanges carry orders (and what is one row an order at most), never fields, of which an order has some twenty."""
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any(re.search(r"hashpartitioning\(o_orderkey#\d+L?, \d+\), REPARTITION_BY_NUM", line) for line in dealt)
    for line in dealt:
        assert "field_type" not in line and "source_image_id" not in line, line
    assert not re.search(r"hashpartitioning\(inspection_id#\d+L?, field_type", plan)


def test_fields_meet_the_groups_that_differ_where_they_are(spark):
    """Only what differs is exchanged, by its image; the fields of all groups, some twenty an order, are not."""
    from panelcheck.fixtures import Fixtures
    from panelcheck.operators.crossmatch import suspects

    f = Fixtures(spark, FOLDER)
    plan = suspects(f.extracted_fields(), f.images())._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(inspection_id#\d+L?, field_type", plan)
    assert len(re.findall(r"Exchange hashpartitioning\((?!o_orderkey)", plan)) == 2  # what differs and the roles, by image


def test_the_same_groups_differ_whatever_type_others_have(spark):
    """An inspection with one type that differs and one that agrees; a null type or inspection meets nothing."""
    from panelcheck.operators.crossmatch import suspects

    columns = "id long, inspection_id long, source_image_id long, field_seq long, field_type string, parsed_value string"
    fields = spark.createDataFrame(
        [(1, 1, 1, 1, "mrp", "Rs. 5"), (2, 1, 2, 2, "mrp", "Rs. 6"), (3, 1, 1, 3, "country_of_origin", "INDIA"), (4, 1, 2, 4, "country_of_origin", "INDIA"),
         (5, 1, 1, 5, None, "a"), (6, 1, 2, 6, None, "b"), (7, None, 1, 7, "mrp", "Rs. 5"), (8, None, 2, 8, "mrp", "Rs. 6"),
         (9, 2, 3, 9, "country_of_origin", "INDIA"), (10, 2, 4, 10, "country_of_origin", "CHINA")], columns)
    images = spark.createDataFrame([(i, "sticker") for i in range(1, 4)], "id long, image_role string")
    rows = suspects(fields, images)
    assert sorted((r.field_id, r.image_role) for r in rows.collect()) == [(1, "sticker"), (2, "sticker"), (9, "sticker"), (10, "unknown")]
    assert rows.columns[:2] == ["source_image_id", "inspection_id"] and "_differing" not in rows.columns


def test_tasks_follow_the_size_of_the_parent(spark, tmp_path):
    """A file of few MB holds millions of parents, so its tasks are more than the blocks it is read in."""
    from panelcheck.fixtures import PART_BYTES, Fixtures
    from panelcheck.functions.joins import plan_bytes

    f = Fixtures(spark, FOLDER)
    wanted = -(-plan_bytes(f.base("orders")) // PART_BYTES)
    assert wanted > 8
    assert f.dealt("orders", "o_orderkey").rdd.getNumPartitions() >= wanted


def test_lines_of_one_block_are_read_by_many_tasks(spark):
    """The parts of sf0.1 are one small block; the patterns of their lines are not one task's work."""
    from panelcheck.fixtures import Fixtures

    assert Fixtures(spark, FOLDER).base("part").rdd.getNumPartitions() == 1
    assert Fixtures(spark, FOLDER).ocr_lines().rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
