"""Enforcement analytics: summary, trends, hotspots, officer throughput, dashboard views.

Self-checks never count.  Child tables are reduced to one row per inspection
before they meet their parent, so nothing multiplies and every shuffle carries
counts rather than rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcheck.functions.expr import ratio

def zero() -> Column:
    return F.lit(0).cast("bigint")


def enforcement(inspections: DataFrame, officer_id=None) -> DataFrame:
    rows = inspections.filter(~F.col("is_self_check"))
    return rows if officer_id is None else rows.filter(F.col("officer_id") == officer_id)


def violation_counts(violations: DataFrame) -> DataFrame:
    """inspection_id, violations: combined on the map side before the shuffle."""
    return violations.groupBy(F.col("inspection_id")).agg(F.count(F.lit(1)).alias("violations"))


def with_violation_counts(inspections: DataFrame, violations: DataFrame) -> DataFrame:
    counts = violation_counts(violations).withColumnRenamed("inspection_id", "id")
    return inspections.join(counts, "id", "left").withColumn("violations", F.coalesce("violations", zero()))


def status_counts(inspections: DataFrame, officer_id=None) -> DataFrame:
    return enforcement(inspections, officer_id).groupBy("status").agg(F.count(F.lit(1)).alias("inspections"))


def compliance_split(inspections: DataFrame, violations: DataFrame, officer_id=None) -> DataFrame:
    done = enforcement(inspections, officer_id).filter(F.col("status") == "completed").select("id")
    counted = with_violation_counts(done, violations)
    return counted.agg(
        F.count_if(F.col("violations") == 0).alias("compliant_inspections"),
        F.count_if(F.col("violations") > 0).alias("violation_inspections"),
        ratio(F.count_if(F.col("violations") == 0), F.count(F.lit(1)), 2, 100.0).alias("overall_compliance_rate"),
    )


def severity_counts(inspections: DataFrame, violations: DataFrame, officer_id=None) -> DataFrame:
    """Per severity; violations are reduced to (inspection, severity) counts before the join."""
    per = violations.groupBy("inspection_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    keep = enforcement(inspections, officer_id).select(F.col("id").alias("inspection_id"))
    return per.join(keep, "inspection_id").groupBy("severity").agg(F.sum("n").alias("violations"))


def activity_counts(inspections: DataFrame, audit_logs: DataFrame, officer_id=None) -> DataFrame:
    """Overrides count every audit row of the actor; active officers are never scoped."""
    logs = audit_logs if officer_id is None else audit_logs.filter(F.col("actor_user_id") == officer_id)
    overrides = logs.agg(F.count(F.lit(1)).alias("total_audit_overrides"))
    active = enforcement(inspections).agg(F.countDistinct("officer_id").alias("active_officers_count"))
    return _side_by_side([overrides, active])


def _side_by_side(one_row: list[DataFrame]) -> DataFrame:
    """Join one-row aggregates into one row."""
    keyed = [d.withColumn("_one", F.lit(1)) for d in one_row]
    out = keyed[0]
    for d in keyed[1:]:
        out = out.join(d, "_one")
    return out.drop("_one")


def analytics_summary(inspections, violations, audit_logs, officer_id=None) -> DataFrame:
    """The summary row; ``officer_id`` scopes it the way an officer sees it.

    One pass: violations collapse to a row per inspection, meet the inspections
    once, and every number is a conditional aggregate of that join.
    """
    of = lambda s: F.count_if(F.col("severity") == s)
    per = violations.groupBy(F.col("inspection_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), of("critical").alias("c"), of("major").alias("m"), of("moderate").alias("o")
    )
    mine = F.lit(True) if officer_id is None else F.coalesce(F.col("officer_id") == officer_id, F.lit(False))
    rows = enforcement(inspections).select("id", "officer_id", "status", mine.alias("mine")).join(per, "id", "left")
    state = lambda s: F.count_if(F.col("mine") & (F.col("status") == s))
    done = F.col("mine") & (F.col("status") == "completed")
    clean, dirty = F.count_if(done & F.col("n").isNull()), F.count_if(done & F.col("n").isNotNull())
    total = lambda c: F.coalesce(F.sum(F.when(F.col("mine"), F.col(c))), zero())
    numbers = rows.agg(
        F.count_if("mine").alias("total_inspections"),
        state("completed").alias("completed_inspections"),
        state("needs_review").alias("needs_review_inspections"),
        state("draft").alias("draft_inspections"),
        clean.alias("compliant_inspections"),
        dirty.alias("violation_inspections"),
        ratio(clean, clean + dirty, 2, 100.0).alias("overall_compliance_rate"),
        total("n").alias("total_violations"),
        total("c").alias("critical_violations"),
        total("m").alias("major_violations"),
        total("o").alias("moderate_violations"),
        F.countDistinct("officer_id").alias("active_officers_count"),
    )
    logs = audit_logs if officer_id is None else audit_logs.filter(F.col("actor_user_id") == officer_id)
    return _side_by_side([numbers, logs.agg(F.count(F.lit(1)).alias("total_audit_overrides"))])


def compliance_trends(
    inspections, violations, users=None, start=None, end=None, category=None, region=None, officer_id=None
) -> DataFrame:
    """Daily points.  A region filter replaces the officer scope and looks at the officer's region."""
    rows = enforcement(inspections, None if region else officer_id)
    if start is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("created_at") <= F.lit(end).cast("timestamp"))
    if category:
        rows = rows.filter(F.col("commodity_category") == category)
    if region:
        officers = users.filter(F.col("region") == region).select(F.col("id").alias("officer_id"))
        rows = rows.join(officers, "officer_id", "left_semi")
    counted = with_violation_counts(rows.select("id", F.to_date("created_at").alias("date")), violations)
    clean = F.count_if(F.col("violations") == 0)
    total = F.count(F.lit(1))
    return counted.groupBy("date").agg(
        total.alias("total_inspections"),
        clean.alias("compliant_count"),
        F.count_if(F.col("violations") > 0).alias("violation_count"),
        ratio(clean, total, 2, 100.0).alias("compliance_rate"),
    )


def trend_period(points: DataFrame, start=None, end=None) -> DataFrame:
    day = lambda v: F.to_date(F.lit(v).cast("timestamp"))
    return points.agg(
        F.coalesce(day(start), F.min("date")).alias("period_start"),
        F.coalesce(day(end), F.max("date")).alias("period_end"),
    )


def hotspots_by_rule(inspections, violations, k: int = 10) -> DataFrame:
    """Top rules.  Violations collapse to (inspection, rule) before the join drops self-checks."""
    per = violations.groupBy("inspection_id", "rule_id").agg(
        F.min("citation").alias("citation"),
        F.min("description").alias("description"),
        F.min("severity").alias("severity"),
        F.count(F.lit(1)).alias("n"),
    )
    keep = enforcement(inspections).select(F.col("id").alias("inspection_id"))
    return (
        per.join(keep, "inspection_id")
        .groupBy("rule_id")
        .agg(
            F.min("citation").alias("citation"),
            F.min("description").alias("description"),
            F.min("severity").alias("severity"),
            F.sum("n").alias("count"),
        )
        .orderBy(F.desc("count"), "rule_id")
        .limit(k)
    )


def _violation_rate(total: Column, violations: Column) -> Column:
    """Counts violation rows, not violating inspections, and never drops below zero."""
    return F.when(total > 0, F.round(F.greatest(F.lit(0.0), (total - violations) / total * 100), 2)).otherwise(100.0)


def hotspots_by_category(inspections, violations) -> DataFrame:
    rows = with_violation_counts(enforcement(inspections).select("id", "commodity_category"), violations)
    return (
        rows.groupBy("commodity_category")
        .agg(F.count(F.lit(1)).alias("total_inspections"), F.sum("violations").alias("violations_count"))
        .select(
            F.coalesce("commodity_category", F.lit("general")).alias("commodity_category"),
            "total_inspections",
            "violations_count",
            _violation_rate(F.col("total_inspections"), F.col("violations_count")).alias("compliance_rate"),
        )
    )


def hotspots_by_region(inspections, violations, users) -> DataFrame:
    """By the officer's region; inspections collapse to one row per officer before users join."""
    rows = with_violation_counts(enforcement(inspections).select("id", "officer_id"), violations)
    per_officer = rows.groupBy("officer_id").agg(
        F.count(F.lit(1)).alias("total_inspections"), F.sum("violations").alias("violations_count")
    )
    return (
        per_officer.join(users.select(F.col("id").alias("officer_id"), "region"), "officer_id")
        .groupBy("region")
        .agg(F.sum("total_inspections").alias("total_inspections"), F.sum("violations_count").alias("violations_count"))
        .select(
            F.coalesce("region", F.lit("Unassigned")).alias("region"),
            "total_inspections",
            "violations_count",
            _violation_rate(F.col("total_inspections"), F.col("violations_count")).alias("compliance_rate"),
        )
    )


def officer_throughput(inspections, users, audit_logs) -> DataFrame:
    """Every officer and supervisor, with or without inspections; admins never."""
    work = enforcement(inspections).groupBy("officer_id").agg(
        F.count(F.lit(1)).alias("total_inspections"),
        F.count_if(F.col("status") == "completed").alias("completed_inspections"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review_inspections"),
        F.max("created_at").alias("last_inspection_at"),
    )
    overrides = audit_logs.groupBy(F.col("actor_user_id").alias("officer_id")).agg(
        F.count(F.lit(1)).alias("human_overrides_count")
    )
    people = users.filter(F.col("role").isin("officer", "supervisor")).select(
        F.col("id").alias("officer_id"), F.col("full_name").alias("officer_name"), "email", "region"
    )
    counts = ["total_inspections", "completed_inspections", "needs_review_inspections", "human_overrides_count"]
    return (
        people.join(work, "officer_id", "left")
        .join(overrides, "officer_id", "left")
        .select(
            "officer_id", "officer_name", "email", "region",
            *[F.coalesce(c, zero()).alias(c) for c in counts],
            "last_inspection_at",
        )
    )


def recent_trend(points: DataFrame, n: int = 30) -> DataFrame:
    """The last n days, with the peak day marked (the earliest of equal days)."""
    last = points.orderBy(F.desc("date")).limit(n)
    peak = last.agg(F.max_by("date", F.struct("total_inspections", -F.unix_date("date"))).alias("d")).scalar()
    return last.withColumn("is_peak", F.col("date") == peak)


def top_rules(hotspots: DataFrame, total_violations: Column, k: int = 5) -> DataFrame:
    """Top k rules with rank, width against the first and share of all violations in whole percent.

    ``hotspots`` is already a short top-k table, so its window is over a few rows.
    """
    order = W.orderBy(F.desc("count"), "rule_id")
    whole = lambda c: F.floor(c * 100 + 0.5).cast("int")
    first = F.max("count").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return (
        hotspots.withColumn("rank", F.row_number().over(order))
        .withColumn("width_pct", F.least(F.lit(100), whole(F.col("count") / F.greatest(F.lit(1), first))))
        .withColumn("share_pct", whole(F.col("count") / F.greatest(F.lit(1), total_violations)))
        .filter(F.col("rank") <= k)
        .select(
            F.concat(F.lit("0"), F.col("rank").cast("string"), F.lit(".")).alias("rank"), "rule_id", "description",
            F.upper("severity").alias("severity"),
            F.coalesce(F.nullif("citation", F.lit("")), F.lit("Statutory LMPC requirement")).alias("citation"),
            "count", "width_pct", "share_pct",
        )
    )


def category_badges(categories: DataFrame, k: int = 4) -> DataFrame:
    rate = F.col("compliance_rate")
    return (
        categories.orderBy(F.desc("violations_count"), "commodity_category")
        .limit(k)
        .withColumn("badge", F.when(rate < 70, "HIGH RISK").when(rate < 85, "STANDARD").otherwise("COMPLIANT"))
    )


def officer_states(throughput: DataFrame) -> DataFrame:
    return throughput.select(
        "officer_id", "officer_name",
        F.coalesce("region", F.lit("Zonal Enforcement")).alias("region"),
        "total_inspections", "completed_inspections", "needs_review_inspections", "human_overrides_count",
        F.when(F.col("needs_review_inspections") > 5, "Pending Review").otherwise("Active Field").alias("state"),
    )


def summary_ledger(summary: DataFrame) -> DataFrame:
    """The summary as metric, value rows in a fixed order."""
    lines = [
        ("Total Inspections", "total_inspections"),
        ("Compliant Packages", "compliant_inspections"),
        ("Violations Detected", "violation_inspections"),
        ("Overall Compliance Rate", "overall_compliance_rate"),
        ("Critical Breaches", "critical_violations"),
        ("Major Breaches", "major_violations"),
        ("Needs Review Queue", "needs_review_inspections"),
        ("Active Officers", "active_officers_count"),
    ]
    rate = F.regexp_replace(F.format_string("%.2f", F.col("overall_compliance_rate")), r"\.?0+$", "")
    value = lambda c: F.concat(rate, F.lit("%")) if c == "overall_compliance_rate" else F.col(c).cast("string")
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("line"), F.lit(m).alias("metric"), value(c).alias("value"))
            for i, (m, c) in enumerate(lines, 1)
        ]
    )
    return summary.select(F.inline(rows))
