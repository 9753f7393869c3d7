"""Rule packs: the core pack, loading from JSON, flattening, validation, registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcheck import fixed_values as V
from panelcheck.functions.expr import json_object, json_text
from panelcheck.schemas import RULE, RULE_PACK_FILE


def _core_rule(r: dict) -> Column:
    mm = r.get("thresholds_mm")
    heights = F.create_map(*[F.lit(x) for kv in mm.items() for x in kv]) if mm else F.lit(None).cast("map<string,double>")
    text = {k: F.lit(r[k]) for k in ("rule_id", "type", "field", "citation", "severity", "note")}
    parts = {**text, "applies_to": F.array(*[F.lit(c) for c in r["applies_to"]]), "thresholds_mm": heights, "requires_calibration": F.lit(mm is not None)}
    return F.struct(*[parts[f.name].alias(f.name) for f in RULE.fields])


def core_rule_pack(spark: SparkSession) -> DataFrame:
    """The built-in pack as one rule_packs row of literals, so that the optimizer knows how small it is."""
    return spark.range(1).select(
        F.lit(V.CORE_PACK_VERSION).alias("version"),
        F.lit("2026-02-01").cast("date").alias("effective_from"),
        F.lit(V.CORE_PACK_SOURCE).alias("source_citation"),
        F.array(*[_core_rule(r) for r in V.CORE_RULES]).cast(T.ArrayType(RULE)).alias("rules"),
        F.lit(True).alias("is_active"),
    )


def load_rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """Pack files (one JSON document each) as one row per rule, in pack order."""
    return flatten_rules(
        spark.read.schema(RULE_PACK_FILE).option("multiLine", True).json(path).withColumnRenamed("rule_pack_version", "version")
    )


def normal_rules(rules: Column) -> Column:
    """The rules array with its position and the defaults the pack schema states."""
    return F.transform(
        rules,
        lambda r, i: F.struct(
            i.alias("rule_seq"),
            r["rule_id"].alias("rule_id"),
            F.coalesce(r["applies_to"], F.array(F.lit("all"))).alias("applies_to"),
            r["type"].alias("type"),
            r["field"].alias("field"),
            r["citation"].alias("citation"),
            F.coalesce(r["severity"], F.lit("major")).alias("severity"),
            r["thresholds_mm"].alias("thresholds_mm"),
            F.coalesce(r["requires_calibration"], F.lit(False)).alias("requires_calibration"),
        ),
    )


def flatten_rules(packs: DataFrame) -> DataFrame:
    """One row per rule of each pack."""
    return packs.select("version", F.inline(normal_rules(F.col("rules"))))


def validate_rule_pack(packs: DataFrame) -> DataFrame:
    """One row per problem: version, rule_id, problem."""
    rules = flatten_rules(packs)
    font = F.col("type").isin(*V.FONT_RULE_TYPES)
    checks: list[tuple[Column, str]] = [
        ((F.col("type") == "field_required") & (F.coalesce(F.col("field"), F.lit("")) == ""), "field_missing"),
        (font & (F.coalesce(F.size("thresholds_mm"), F.lit(0)) <= 0), "thresholds_missing"),
        (F.col("type").isNull() | ~F.col("type").isin(*V.RULE_TYPES), "unknown_type"),
        (~F.col("severity").isin(*V.SEVERITIES), "unknown_severity"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda p: p.isNotNull())
    per_rule = rules.select("version", "rule_id", F.explode(found).alias("problem"))
    empty = packs.filter(F.coalesce(F.size("rules"), F.lit(0)) <= 0).select(
        "version", F.lit(None).cast("string").alias("rule_id"), F.lit("no_rules").alias("problem")
    )
    return per_rule.unionByName(empty)


def list_rule_packs(packs: DataFrame) -> DataFrame:
    return packs.select(
        "version", "effective_from", "source_citation", "is_active",
        F.coalesce(F.size("rules"), F.lit(0)).alias("rule_count"),
    )


def active_pack(packs: DataFrame, default: DataFrame) -> DataFrame:
    """The active pack, or the default pack where none is active.  Of several active ones the latest counts, then the smallest version."""
    active = packs.filter("is_active").orderBy(F.desc_nulls_last("effective_from"), "version").limit(1)
    some = active.agg(F.count(F.lit(1)).alias("n")).scalar()
    return active.unionByName(default.filter(some == 0).withColumn("is_active", F.lit(True)), allowMissingColumns=True)


def register_pack(uploads: DataFrame, packs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted packs, rejected rows with a reason, audit rows).

    ``uploads`` has the pack columns plus ``body_version`` and ``actor_user_id``.
    """
    invalid = validate_rule_pack(uploads).select("version").distinct().withColumn("_invalid", F.lit(True))
    known = packs.select("version").distinct().withColumn("_known", F.lit(True))
    judged = (
        uploads.join(invalid, "version", "left")
        .join(known, "version", "left")
        .withColumn(
            "reason",
            F.when(F.col("_invalid"), "invalid_schema")
            .when(~F.col("version").eqNullSafe(F.col("body_version")), "version_mismatch")
            .when(F.col("_known"), "version_exists"),
        )
    )
    ok = judged.filter("reason IS NULL").withColumn("is_active", F.lit(False))
    accepted = ok.select(*[c for c in uploads.columns if c not in ("body_version", "actor_user_id", "is_active")], "is_active")
    rejected = judged.filter("reason IS NOT NULL").select("version", "body_version", "reason")
    audit = ok.select(
        "actor_user_id",
        F.lit("rule_pack_created").alias("action"),
        F.lit("rule_pack").alias("entity_type"),
        F.col("version").alias("entity_id"),
        F.lit(None).cast("string").alias("before_value"),
        json_object(
            [
                ("effective_from", json_text(F.date_format("effective_from", "yyyy-MM-dd"))),
                ("rule_count", F.size("rules").cast("string")),
                ("version", json_text(F.col("version"))),
            ]
        ).alias("after_value"),
    )
    return accepted, rejected, audit


def activate_pack(packs: DataFrame, version: str, actor_user_id) -> tuple[DataFrame, DataFrame]:
    """(packs with exactly one active, audit row).  An unknown version changes nothing."""
    target = F.col("version") == version
    known = packs.filter(target).agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    switched = packs.withColumn("is_active", F.when(known, target).otherwise(F.col("is_active")))
    audit = (
        packs.agg(
            F.max(F.when(F.col("is_active"), F.col("version"))).alias("previous"),
            F.count_if(target).alias("found"),
        )
        .filter("found > 0")
        .select(
            F.lit(actor_user_id).alias("actor_user_id"),
            F.lit("rule_pack_activated").alias("action"),
            F.lit("rule_pack").alias("entity_type"),
            F.lit(version).alias("entity_id"),
            json_object([("previous_active_version", json_text(F.col("previous")))]).alias("before_value"),
            json_object([("active_version", json_text(F.lit(version)))]).alias("after_value"),
        )
    )
    return switched, audit
