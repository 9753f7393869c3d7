"""Warehouse batch sessions and manufacturer self-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.expr import any_of, ratio
from panelcheck.functions.joins import ranked
from panelcheck.operators.analytics import with_violation_counts, zero
from panelcheck.operators.search import scope_to_actor

ITEM_TYPES = ["mrp", "net_quantity", "commodity_name", "manufacturer_address", "importer_packer"]


def batch_metrics(batches: DataFrame, inspections: DataFrame, violations: DataFrame) -> DataFrame:
    """Tally per batch.  A batch of any size is summed on the map side before it moves."""
    rows = with_violation_counts(inspections.filter("batch_id IS NOT NULL").select("id", "batch_id", "status"), violations)
    done, review = F.col("status") == "completed", F.col("status") == "needs_review"
    clean = F.count_if(done & (F.col("violations") == 0))
    bad = F.count_if((done & (F.col("violations") > 0)) | review)
    tally = rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_skus"),
        clean.alias("compliant_count"),
        bad.alias("non_compliant_count"),
        F.count_if(~done & ~review).alias("pending_count"),
        F.sum("violations").alias("total_violations"),
    )
    counts = ["total_skus", "compliant_count", "non_compliant_count", "pending_count", "total_violations"]
    return (
        batches.join(tally.withColumnRenamed("batch_id", "id"), "id", "left")
        .select(*batches.columns, *[F.coalesce(c, zero()).alias(c) for c in counts])
        .withColumn("compliance_rate_pct", ratio(F.col("compliant_count"), F.col("total_skus"), 1, 0.0))
    )


def list_batches(metrics: DataFrame, actor: dict | None = None, status: str | None = None) -> DataFrame:
    rows = scope_to_actor(metrics, actor)
    return rows if status is None else rows.filter(F.col("status") == status)


def last_values(fields: DataFrame) -> DataFrame:
    """The last declared value per inspection and type as columns; an empty parsed value falls back to the raw text."""
    value = F.coalesce(F.nullif("parsed_value", F.lit("")), F.col("raw_text"))
    last = lambda t: F.max_by(value, F.when(F.col("field_type") == t, F.col("field_seq"))).alias(t)
    wanted = fields.filter(F.col("field_type").isin(*ITEM_TYPES))
    return wanted.groupBy(F.col("inspection_id").alias("id")).agg(*[last(t) for t in ITEM_TYPES])


def batch_items(inspections: DataFrame, fields: DataFrame, violations: DataFrame) -> DataFrame:
    """One row per scanned package of a batch."""
    rows = with_violation_counts(inspections.filter("batch_id IS NOT NULL"), violations)
    return rows.join(last_values(fields), "id", "left").select(
        "batch_id", F.col("id").alias("inspection_id"), "status", "commodity_category", "created_at",
        F.col("violations").alias("violations_count"),
        ((F.col("violations") == 0) & (F.col("status") == "completed")).alias("is_compliant"),
        "mrp", "net_quantity", "commodity_name",
        F.coalesce(F.nullif("manufacturer_address", F.lit("")), "importer_packer").alias("manufacturer"),
    )


def batch_manifest(inspections: DataFrame, fields: DataFrame, violations: DataFrame) -> DataFrame:
    """Items of each batch numbered by time, each with its violations nested.

    Numbering goes day by day (``ranked``), so a batch with very many packages
    is never sorted in one task.
    """
    items = ranked(
        batch_items(inspections, fields, violations), ["batch_id"], F.to_date("created_at"),
        [F.col("created_at"), F.col("inspection_id")], "item_seq",
    )
    detail = violations.groupBy("inspection_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "rule_id", "severity", "description", "citation"))).alias("violations")
    )
    return items.join(detail, "inspection_id", "left")


def batch_violations_by_rule(inspections: DataFrame, violations: DataFrame) -> DataFrame:
    """Count per batch and rule; partial sums per inspection meet the batch key."""
    per = violations.groupBy("inspection_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    keys = inspections.filter("batch_id IS NOT NULL").select(F.col("id").alias("inspection_id"), "batch_id")
    return per.join(keys, "inspection_id").groupBy("batch_id", "rule_id").agg(F.sum("n").alias("violations"))


def complete_batches(batches: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The named batches become completed at ``now``."""
    marked = batches.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return marked.select(
        *[
            F.when(hit, "completed").otherwise(F.col("status")).alias("status") if c == "status"
            else F.when(hit, now).otherwise(F.col("completed_at")).alias(c) if c == "completed_at"
            else F.col(c)
            for c in batches.columns
        ]
    )


def reject_inactive(skus: DataFrame, batches: DataFrame) -> DataFrame:
    """SKUs that name a batch which is missing or not active, with the reason."""
    state = batches.select(F.col("id").alias("batch_id"), F.col("status").alias("batch_status"))
    return skus.join(state, "batch_id", "left").filter("batch_status IS NULL OR batch_status <> 'active'").withColumn(
        "reason", F.when(F.col("batch_status").isNull(), "batch_not_found").otherwise("batch_not_active")
    )


# ------------------------------------------------------------------ self-checks


def self_check_scorecards(inspections: DataFrame, fields: DataFrame, violations: DataFrame) -> DataFrame:
    """Readiness of each self-check."""
    v = violations.groupBy(F.col("inspection_id").alias("id")).agg(
        F.count(F.lit(1)).alias("violation_count"), F.count_if(F.col("severity") == "critical").alias("critical")
    )
    n = fields.groupBy(F.col("inspection_id").alias("id")).agg(F.count(F.lit(1)).alias("total_declarations"))
    rows = (
        inspections.filter("is_self_check").select("id", "commodity_category", "status", "created_at")
        .join(v, "id", "left").join(n, "id", "left")
        .select(
            F.col("id").alias("inspection_id"),
            F.coalesce("commodity_category", F.lit("general")).alias("commodity_category"),
            "status", "created_at",
            *[F.coalesce(c, zero()).alias(c) for c in ("violation_count", "critical", "total_declarations")],
        )
    )
    total, bad = F.col("total_declarations"), F.col("violation_count")
    good = F.greatest(zero(), total - bad)
    return rows.select(
        "inspection_id", "commodity_category", "status", "created_at",
        F.when(F.col("critical") > 0, "CRITICAL_DEFICIENCIES").when(bad > 0, "ACTION_REQUIRED").otherwise("MARKET_READY")
        .alias("overall_readiness"),
        "total_declarations", good.alias("compliant_count"), "violation_count",
        F.when(total > 0, F.round(good / total * 100.0, 1)).when(bad == 0, 100.0).otherwise(0.0).alias("readiness_percentage"),
    )


def remedial_action(rule_id: Column, description: Column, citation: Column) -> Column:
    """Advice by the first rule of the table whose words appear."""
    rule, text = F.lower(F.coalesce(rule_id, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    out = None
    for in_rule, in_text, advice in V.REMEDIES:
        hit = any_of([F.contains(rule, F.lit(w)) for w in in_rule] + [F.contains(text, F.lit(w)) for w in in_text])
        out = (F.when if out is None else out.when)(hit, F.lit(advice))
    before, after = V.REMEDY_OTHER
    return out.otherwise(F.concat(F.lit(before), F.coalesce(F.nullif(citation, F.lit("")), rule_id), F.lit(after)))


def remediations(inspections: DataFrame, fields: DataFrame, violations: DataFrame) -> DataFrame:
    """One advice row per violation of a self-check, with the field it is bound to."""
    checks = inspections.filter("is_self_check").select(F.col("id").alias("inspection_id"))
    kinds = fields.select(F.col("id").alias("extracted_field_id"), "inspection_id", F.col("field_type").alias("field_name"))
    return (
        violations.join(checks, "inspection_id", "left_semi")
        .join(kinds, ["extracted_field_id", "inspection_id"], "left")
        .select(
            "inspection_id", F.col("id").alias("violation_id"), "rule_id", "citation", "severity",
            F.col("description").alias("issue"),
            remedial_action(F.col("rule_id"), F.col("description"), F.col("citation")).alias("remedial_action"),
            "field_name",
        )
    )


def self_check_summary(inspections: DataFrame, violations: DataFrame, officer_id=None) -> DataFrame:
    rows = inspections.filter("is_self_check")
    rows = rows if officer_id is None else rows.filter(F.col("officer_id") == officer_id)
    counted = with_violation_counts(rows.select("id"), violations)
    ready = F.count_if(F.col("violations") == 0)
    return counted.agg(
        F.count(F.lit(1)).alias("total_self_checks"),
        ready.alias("market_ready_count"),
        F.count_if(F.col("violations") > 0).alias("action_required_count"),
        ratio(ready, F.count(F.lit(1)), 1, 100.0).alias("first_pass_rate"),
    )


def common_deficiencies(inspections: DataFrame, violations: DataFrame, officer_id=None, k: int = 5) -> DataFrame:
    """Top rules of the self-checks with the text of their first violation."""
    rows = inspections.filter("is_self_check")
    rows = rows if officer_id is None else rows.filter(F.col("officer_id") == officer_id)
    per = violations.join(rows.select(F.col("id").alias("inspection_id")), "inspection_id", "left_semi")
    return (
        per.groupBy("rule_id")
        .agg(F.min_by(F.struct("citation", "description"), "id").alias("first"), F.count(F.lit(1)).alias("count"))
        .select("rule_id", "first.citation", "first.description", "count")
        .orderBy(F.desc("count"), "rule_id")
        .limit(k)
    )
