"""Rule evaluation over all inspections at once.

Plan: fields collapse to the first one per type (combined before the shuffle),
then to one map per inspection; images collapse to the primary image; both meet
the inspections on ``inspection_id`` only.  The rules of a pack arrive by a
lookup join and are exploded last, so no shuffle ever carries
inspections x rules rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.expr import percent
from panelcheck.functions.joins import first_row, lookup_join
from panelcheck.functions.verdicts import field_threshold, font_threshold
from panelcheck.sources.rulepacks import core_rule_pack, normal_rules

FIELD_COLUMNS = ["id", "parsed_value", "confidence", "box_h", "verdict", "reviewed_by_officer", "officer_override_value"]


def first_field_per_type(fields: DataFrame) -> DataFrame:
    """The first field of each type per inspection, by ``field_seq``."""
    return first_row(fields, ["inspection_id", "field_type"], [F.col("field_seq")])


def primary_image(images: DataFrame) -> DataFrame:
    """The front panel, else the first image, per inspection."""
    order = [F.when(F.col("image_role") == "front_pdp", 0).otherwise(1), F.col("id")]
    return first_row(images, ["inspection_id"], order)


def with_default_pack(packs: DataFrame) -> DataFrame:
    """Packs plus the built-in pack under a key no version can have."""
    stored = packs.select(F.col("version").alias("pack_key"), "version", "rules")
    spare = core_rule_pack(packs.sparkSession).select(F.lit("\u0000default").alias("pack_key"), "version", "rules")
    return stored.unionByName(spare)


def pack_rules(packs: DataFrame) -> DataFrame:
    """pack_key, pack_version and the pack's rules as one array."""
    return with_default_pack(packs).select(
        "pack_key", F.col("version").alias("pack_version"), normal_rules(F.col("rules")).alias("rules")
    )


def _with_pack(inspections: DataFrame, packs: DataFrame) -> DataFrame:
    rules = pack_rules(packs)
    known = packs.select("version").distinct().select(F.col("version").alias("rule_pack_version"), F.lit(True).alias("_known"))
    keyed = lookup_join(inspections, known, ["rule_pack_version"], "left").withColumn(
        "pack_key", F.when(F.col("_known"), F.col("rule_pack_version")).otherwise(F.lit("\u0000default"))
    )
    return lookup_join(keyed.drop("_known"), rules, ["pack_key"], "inner").drop("pack_key")


def _applies(rule: Column) -> Column:
    category = F.coalesce(F.nullif("commodity_category", F.lit("")), F.lit("general"))
    return F.array_contains(rule.getField("applies_to"), F.lit("all")) | F.array_contains(
        rule.getField("applies_to"), category
    )


def applicable_rules(inspections: DataFrame, packs: DataFrame) -> DataFrame:
    """Every inspection with the rules of its frozen pack that apply to its category."""
    paired = _with_pack(inspections.select("id", "commodity_category", "rule_pack_version"), packs)
    rule = F.col("rule")
    return (
        paired.select("id", "commodity_category", "pack_version", F.explode("rules").alias("rule"))
        .filter(_applies(rule))
        .select(
            F.col("id").alias("inspection_id"),
            F.col("pack_version").alias("rule_pack_version"),
            *[rule.getField(c).alias(c) for c in ("rule_seq", "rule_id", "type", "field", "citation", "severity")],
        )
    )


def field_maps(fields: DataFrame) -> DataFrame:
    """inspection_id -> map of field type to its first field."""
    first = first_field_per_type(fields.select("inspection_id", "field_type", "field_seq", *FIELD_COLUMNS))
    entry = F.struct("field_type", F.struct(*FIELD_COLUMNS).alias("field"))
    return first.groupBy("inspection_id").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"))


def panels(images: DataFrame) -> DataFrame:
    front = primary_image(images.select("inspection_id", "id", "image_role", "width_px", "height_px", "calibration_scale_mm_per_px"))
    side = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("double"), F.lit(default))
    return front.select(
        "inspection_id",
        F.col("calibration_scale_mm_per_px").alias("scale"),
        side("width_px", V.DEFAULT_PANEL_PX[0]).alias("panel_w"),
        side("height_px", V.DEFAULT_PANEL_PX[1]).alias("panel_h"),
    )


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("'"), name, F.lit("'"))


def _required(field: Column, name: Column) -> tuple[Column, Column]:
    """(verdict, description) of a field_required rule."""
    need, conf = field_threshold(name), field.getField("confidence")
    reviewed, verdict = field.getField("reviewed_by_officer"), field.getField("verdict")
    override = field.getField("officer_override_value")
    q = _quoted(name)
    low = conf < need
    cases = [
        (field.isNull(), "fail", F.concat(F.lit("Mandatory declaration "), q, F.lit(" is missing from package."))),
        (reviewed & (verdict == "not_applicable"), "pass",
         F.concat(F.lit("Declaration "), q, F.lit(" marked not applicable by officer."))),
        (reviewed & (verdict == "fail"), "fail",
         F.concat(F.lit("Mandatory declaration "), q, F.lit(" marked non-compliant by officer."))),
        (reviewed & (F.coalesce(override, F.lit("")) != ""), "pass",
         F.concat(F.lit("Mandatory declaration "), q, F.lit(" verified by officer (overridden value: '"), override, F.lit("')."))),
        (reviewed, "pass", F.concat(F.lit("Mandatory declaration "), q, F.lit(" confirmed by officer."))),
        (low, "needs_review",
         F.concat(F.lit("Mandatory declaration "), q, F.lit(" detected (confidence "), percent(conf),
                  F.lit(" below required "), percent(need), F.lit("); officer review required."))),
        (verdict == "needs_review", "needs_review",
         F.concat(F.lit("Mandatory declaration "), q,
                  F.lit(" detected (format ambiguity requiring officer review); officer review required."))),
    ]
    return _cases(cases, "pass", F.concat(F.lit("Mandatory declaration "), q, F.lit(" is present and verified.")))


def _cases(cases, verdict: str, text: Column) -> tuple[Column, Column]:
    v = t = None
    for cond, name, words in cases:
        v = (F.when if v is None else v.when)(cond, F.lit(name))
        t = (F.when if t is None else t.when)(cond, words)
    return v.otherwise(F.lit(verdict)), t.otherwise(text)


def _font(field: Column, name: Column, thresholds: Column) -> tuple[Column, Column]:
    h = F.coalesce(field.getField("box_h").cast("double"), F.lit(0.0))
    scale, panel_h = F.col("scale"), F.col("panel_h")
    reviewed = field.getField("reviewed_by_officer")
    calibrated = F.coalesce(scale > 0, F.lit(False))
    share = F.when(panel_h > 0, F.round(h / panel_h, 4)).otherwise(0.0)
    area = (F.col("panel_w") * scale * panel_h * scale) / 100.0
    need = font_threshold(area, thresholds)
    height = F.round(h * scale, 2)
    q = _quoted(name)
    by_ratio = lambda tail: F.format_string(
        "Font height evaluated via uncalibrated PDP ratio (%.2f%% of PDP height). " + tail, share * 100
    )
    cases = [
        (field.isNull(), "needs_review",
         F.concat(F.lit("Cannot evaluate font height: declaration "), q, F.lit(" is missing."))),
        (reviewed & (field.getField("verdict") == "not_applicable"), "pass",
         F.concat(F.lit("Font height check for "), q, F.lit(" marked not applicable by officer."))),
        (~calibrated & reviewed, "pass", by_ratio("Confirmed by officer.")),
        (~calibrated, "needs_review", by_ratio("Optical calibration reference missing.")),
        (height >= need, "pass",
         F.format_string("Font height of %.2fmm meets the required %.1fmm for PDP area %.1fcm².", height, need, area)),
    ]
    return _cases(cases, "fail", F.format_string(
        "Font height of %.2fmm is below the required minimum %.1fmm for PDP area %.1fcm².", height, need, area))


def _legibility(field: Column, name: Column) -> tuple[Column, Column]:
    conf, q = field.getField("confidence"), _quoted(name)
    cases = [
        (field.isNull(), "needs_review", F.concat(F.lit("Cannot evaluate legibility: declaration "), q, F.lit(" is missing."))),
        (field.getField("reviewed_by_officer"), "pass",
         F.concat(F.lit("Declaration "), q, F.lit(" legibility and contrast confirmed by officer."))),
        (conf < V.LEGIBILITY_THRESHOLD, "needs_review",
         F.concat(F.lit("Declaration "), q, F.lit(" shows poor contrast or OCR ambiguity (confidence "), percent(conf), F.lit(")."))),
    ]
    return _cases(cases, "pass", F.concat(
        F.lit("Declaration "), q, F.lit(" satisfies statutory legibility and prominence requirements.")))


def evaluate_rules(
    inspections: DataFrame,
    fields: DataFrame,
    images: DataFrame,
    packs: DataFrame,
    field_aliases: dict[str, str] | None = None,
) -> DataFrame:
    """One row per inspection and applicable rule with its verdict.

    ``packs`` may be another set of packs than the inspections were made with,
    for what-if runs.  ``field_aliases`` maps an emitted field type to the name
    the rules ask for; it is off unless given.
    """
    if field_aliases:
        pairs = [F.lit(x) for kv in field_aliases.items() for x in kv]
        fields = fields.withColumn(
            "field_type", F.coalesce(F.element_at(F.create_map(*pairs), F.col("field_type")), F.col("field_type"))
        )
    joined = (
        inspections.select(F.col("id").alias("inspection_id"), "commodity_category", "rule_pack_version")
        .join(field_maps(fields), "inspection_id", "left")
        .join(panels(images), "inspection_id", "left")
    )
    rule = F.col("rule")
    evaluated = V.FONT_RULE_TYPES + ["field_required", "legibility_contrast"]
    default_field = (
        F.when(rule.getField("type") == "field_required", "unknown")
        .when(rule.getField("type") == "legibility_contrast", "mrp")
        .otherwise("net_quantity")
    )
    rows = (
        _with_pack(joined, packs)
        .select("*", F.explode("rules").alias("rule"))
        .filter(_applies(rule) & rule.getField("type").isin(*evaluated))
        .withColumn("field_type", F.coalesce(F.nullif(rule.getField("field"), F.lit("")), default_field))
        .withColumn("field", F.element_at("fields", F.col("field_type")))
        .withColumn("panel_w", F.coalesce("panel_w", F.lit(V.DEFAULT_PANEL_PX[0])))
        .withColumn("panel_h", F.coalesce("panel_h", F.lit(V.DEFAULT_PANEL_PX[1])))
    )
    kind, field, name = rule.getField("type"), F.col("field"), F.col("field_type")
    families = {
        "field_required": _required(field, name),
        "legibility_contrast": _legibility(field, name),
    }
    font = _font(field, name, rule.getField("thresholds_mm"))
    pick = lambda i: (
        F.when(kind == "field_required", families["field_required"][i])
        .when(kind == "legibility_contrast", families["legibility_contrast"][i])
        .otherwise(font[i])
    )
    is_font = kind.isin(*V.FONT_RULE_TYPES)
    present = field.isNotNull()
    skipped = F.coalesce(field.getField("reviewed_by_officer") & (field.getField("verdict") == "not_applicable"), F.lit(False))
    known = F.col("scale").isNotNull()
    calibrated = F.when(~is_font, F.lit(True)).when(~present | skipped, known).otherwise(F.coalesce(F.col("scale") > 0, F.lit(False)))
    out = rows.select(
        "inspection_id",
        F.col("pack_version").alias("rule_pack_version"),
        rule.getField("rule_seq").alias("rule_seq"),
        rule.getField("rule_id").alias("rule_id"),
        kind.alias("type"),
        "field_type",
        field.getField("id").alias("extracted_field_id"),
        pick(0).alias("verdict"),
        pick(1).alias("description"),
        rule.getField("citation").alias("citation"),
        rule.getField("severity").alias("severity"),
        calibrated.alias("is_calibrated"),
    )
    review = F.col("verdict") == "needs_review"
    font_out = F.col("type").isin(*V.FONT_RULE_TYPES)
    gone = F.col("extracted_field_id").isNull()
    warning = (
        F.when(review & font_out & gone, "Missing target declaration for font height measurement.")
        .when(review & font_out, "Uncalibrated measurement: physical millimeter font height cannot be asserted without barcode "
              "optical reference (CAL-03). Officer check advised.")
        .when(review & (F.col("type") == "legibility_contrast") & gone, "Missing declaration for legibility check.")
        .when(review & (F.col("type") == "legibility_contrast"),
              "Low legibility contrast detected; visual verification recommended per Rule 9.")
    )
    return out.withColumn("warning", warning)


def overall_verdict(inspections: DataFrame, results: DataFrame) -> DataFrame:
    """fail over needs_review over pass; an inspection without results passes."""
    worst = results.groupBy("inspection_id").agg(
        F.bool_or(F.col("verdict") == "fail").alias("f"), F.bool_or(F.col("verdict") == "needs_review").alias("r")
    )
    return (
        inspections.select(F.col("id").alias("inspection_id"))
        .join(worst, "inspection_id", "left")
        .select("inspection_id", F.when(F.col("f"), "fail").when(F.col("r"), "needs_review").otherwise("pass").alias("overall"))
    )


def with_overall(results: DataFrame) -> DataFrame:
    """Results with the overall verdict of their inspection.

    Results arrive partitioned by inspection, so this costs no exchange; what is
    gathered per inspection is one row per rule of its pack.
    """
    columns = [c for c in results.columns if c != "inspection_id"]
    any_ = lambda v: F.bool_or(F.col("verdict") == v)
    verdict = F.when(any_("fail"), "fail").when(any_("needs_review"), "needs_review").otherwise("pass")
    whole = results.groupBy("inspection_id").agg(F.collect_list(F.struct(*columns)).alias("rows"), verdict.alias("overall"))
    return whole.select("inspection_id", "overall", F.inline("rows"))


def rule_violations(results: DataFrame) -> DataFrame:
    return results.filter(F.col("verdict").isin("fail", "needs_review")).select(
        "inspection_id", "extracted_field_id", "rule_id", "rule_pack_version", "description", "citation", "severity"
    )


def status_after_processing(overall: DataFrame, report: DataFrame | None) -> DataFrame:
    """completed only for a pass without discrepancies; every other case needs review."""
    consistent = F.lit(True)
    rows = overall
    if report is not None:
        rows = overall.join(report.select("inspection_id", "is_consistent"), "inspection_id", "left")
        consistent = F.coalesce("is_consistent", F.lit(True))
    done = (F.col("overall") == "pass") & consistent
    return rows.select("inspection_id", F.when(done, "completed").otherwise("needs_review").alias("status"))
