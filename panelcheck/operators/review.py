"""Officer review: queue, decisions, audit rows, evidence items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcheck import fixed_values as V
from panelcheck.functions.expr import any_of, case_map, float_text, json_bool, json_object, json_text, percent
from panelcheck.functions.joins import ranked
from panelcheck.functions.verdicts import field_threshold
from panelcheck.operators.rules import primary_image


def field_label(field_type: Column) -> Column:
    return case_map(field_type, V.FIELD_LABELS, F.upper(F.replace(field_type, F.lit("_"), F.lit(" "))))


def _low(fields: DataFrame) -> Column:
    return F.col("confidence") < field_threshold(F.col("field_type"))


def review_queue(fields: DataFrame, violations: DataFrame) -> DataFrame:
    """Every field with the reason it is shown and the number of violations bound to it."""
    need = field_threshold(F.col("field_type"))
    low = F.col("confidence") < need
    reason = (
        F.when(low, F.concat(F.lit("Low extraction confidence ("), percent(F.col("confidence")), F.lit(" < "), percent(need), F.lit(")")))
        .when(F.col("verdict") == "needs_review", "Format or statutory qualifier ambiguity")
        .when(F.col("reviewed_by_officer"), "Officer reviewed")
        .otherwise("Automated check verified")
    )
    kind = (
        F.when(low, "low_confidence").when(F.col("verdict") == "needs_review", "needs_review")
        .when(F.col("reviewed_by_officer"), "reviewed").otherwise("verified")
    )
    bound = violations.filter("extracted_field_id IS NOT NULL").groupBy(F.col("extracted_field_id").alias("id")).agg(
        F.count(F.lit(1)).alias("violations")
    )
    return fields.join(bound, "id", "left").select(
        F.col("id").alias("field_id"), "inspection_id", "field_type", field_label(F.col("field_type")).alias("field_label"),
        "raw_text", "parsed_value", "confidence", "verdict", "source_image_id",
        kind.alias("flag"), reason.alias("flag_reason"), "reviewed_by_officer", "officer_override_value",
        F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations"),
    )


def review_counts(fields: DataFrame) -> DataFrame:
    """Total, pending and completed reviews per inspection."""
    reviewed = F.col("reviewed_by_officer")
    pending = ~reviewed & ((F.col("verdict") == "needs_review") | _low(fields))
    return fields.groupBy("inspection_id").agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count_if(pending).alias("pending_review_count"),
        F.count_if(reviewed).alias("completed_review_count"),
    )


ACTIONS = {"single": ("confirm", "correct", "mark_not_applicable"), "batch": ("confirm", "override", "mark_not_applicable")}
AUDIT_NAMES = {
    "single": {a: f"field_{a}" for a in ACTIONS["single"]},
    "batch": {"confirm": "CONFIRM_DECLARATION", "override": "OVERRIDE_DECLARATION", "mark_not_applicable": "MARK_NOT_APPLICABLE"},
}


def review_errors(fields: DataFrame, actions: DataFrame, mode: str = "single") -> DataFrame:
    """Actions that cannot be applied, with the reason.

    ``actions``: field_id, action_seq, action, override_value, notes, actor_user_id.
    """
    known = fields.select(F.col("id").alias("field_id"), F.lit(True).alias("_known"))
    text = F.trim(F.coalesce("override_value", F.lit("")))
    reason = (
        F.when(F.col("_known").isNull(), "field_not_found")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS[mode]), F.lit(False)), "invalid_action")
    )
    if mode == "single":
        reason = reason.when((F.col("action") == "correct") & (text == ""), "override_value_required")
    return actions.join(known, "field_id", "left").withColumn("reason", reason).filter("reason IS NOT NULL").drop("_known")


def _valid(fields: DataFrame, actions: DataFrame, mode: str) -> DataFrame:
    ok = actions.join(fields.select(F.col("id").alias("field_id")), "field_id", "left_semi").filter(
        F.col("action").isin(*ACTIONS[mode])
    )
    if mode == "single":
        ok = ok.filter((F.col("action") != "correct") | (F.trim(F.coalesce("override_value", F.lit(""))) != ""))
    return ok


def _override_state(mode: str) -> Column:
    """What an action makes of the override value: a struct, or null where it leaves it alone."""
    sets = F.col("action").isin("correct", "override")
    value = F.trim("override_value") if mode == "single" else F.col("override_value")
    cleared = (F.col("action") == "mark_not_applicable") | (F.lit(mode == "batch") & (F.col("action") == "confirm"))
    return F.when(sets, F.struct(value.alias("v"))).when(cleared, F.struct(F.lit(None).cast("string").alias("v")))


def _verdict_after(action: Column) -> Column:
    return F.when(action == "mark_not_applicable", "not_applicable").otherwise("pass")


def apply_reviews(fields: DataFrame, actions: DataFrame, mode: str = "single", by: str | None = None) -> DataFrame:
    """Fields after all valid actions.

    The last action decides the verdict.  A single "confirm" keeps an older
    override value, a batch "confirm" clears it, so the override comes from the
    last action that touches it.

    ``by`` names a column that fields are dealt by, null only where the id is: they then stay where they are,
    and the actions come to them as one map for each of its values.
    """
    ok = _valid(fields, actions, mode).withColumn("_set", _override_state(mode))
    last = ok.groupBy(F.col("field_id").alias("id")).agg(
        F.max_by("action", "action_seq").alias("_action"),
        F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("action_seq"))).alias("_override"),
    )
    hit = F.col("_action").isNotNull()
    new = {
        "verdict": F.when(hit, _verdict_after(F.col("_action"))).otherwise(F.col("verdict")),
        "reviewed_by_officer": F.col("reviewed_by_officer") | hit,
        "officer_override_value": F.when(F.col("_override").isNotNull(), F.col("_override.v")).otherwise(
            F.col("officer_override_value")
        ),
    }
    if by is None:
        met = fields.join(last, "id", "left")
    else:
        entry = F.struct("id", F.struct("_action", "_override").alias("done"))
        per = fields.select("id", by).join(last, "id").groupBy(by).agg(F.map_from_entries(F.collect_set(entry)).alias("_last"))
        met = fields.join(per, by, "left").withColumn("_done", F.element_at("_last", F.col("id"))).withColumns({c: F.col("_done").getField(c) for c in ("_action", "_override")})
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in fields.columns])


def review_audit_rows(fields: DataFrame, actions: DataFrame, now: Column, mode: str = "single") -> DataFrame:
    """One audit row per valid action with canonical before and after JSON."""
    ok = _valid(fields, actions, mode).withColumn("_set", _override_state(mode))
    base = fields.select(
        F.col("id").alias("field_id"), "raw_text", "parsed_value", "confidence", "verdict", "reviewed_by_officer", "officer_override_value"
    )
    # the decisions on one field, a handful at most
    w = W.partitionBy("field_id").orderBy("action_seq")
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    rows = ok.join(base, "field_id").withColumns(
        {
            "_prev": F.lag("action").over(w),
            "_kept": F.last("_set", ignorenulls=True).over(earlier),
        }
    )
    first = F.col("_prev").isNull()
    before_override = F.when(F.col("_kept").isNotNull(), F.col("_kept.v")).otherwise(F.col("officer_override_value"))
    after_override = F.when(F.col("_set").isNotNull(), F.col("_set.v")).otherwise(before_override)
    before_verdict = F.when(first, F.col("verdict")).otherwise(_verdict_after(F.col("_prev")))
    before_seen = F.when(first, F.col("reviewed_by_officer")).otherwise(F.lit(True))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")

    def state(verdict, seen, override, extra):
        pairs = {
            "officer_override_value": json_text(override),
            "parsed_value": json_text(F.col("parsed_value")),
            "reviewed_by_officer": json_bool(seen),
            "verdict": json_text(verdict),
            **extra,
        }
        if mode == "single":
            pairs["confidence"] = float_text(F.col("confidence"))
            pairs["raw_text"] = json_text(F.col("raw_text"))
        return json_object(sorted(pairs.items()))

    if mode == "single":
        extra = {"action": json_text(F.col("action")), "review_notes": json_text(F.col("notes"))}
    else:
        extra = {
            "officer_notes": json_text(F.col("notes")), "reviewed_at": json_text(stamp),
            "reviewed_by": json_text(F.col("actor_user_id").cast("string")),
        }
    return rows.select(
        "actor_user_id",
        case_map(F.col("action"), AUDIT_NAMES[mode]).alias("action"),
        F.lit("extracted_field").alias("entity_type"),
        F.col("field_id").alias("entity_id"),
        "action_seq",
        state(before_verdict, before_seen, before_override, {}).alias("before_value"),
        state(_verdict_after(F.col("action")), F.lit(True), after_override, extra).alias("after_value"),
        now.alias("created_at"),
    )


def status_after_review(overall: DataFrame, fields: DataFrame) -> DataFrame:
    """needs_review while a field is pending or the verdict needs review; a plain fail completes."""
    pending = review_counts(fields).select("inspection_id", (F.col("pending_review_count") > 0).alias("_pending"))
    waits = F.coalesce("_pending", F.lit(False)) | (F.col("overall") == "needs_review")
    return overall.join(pending, "inspection_id", "left").select(
        "inspection_id", F.when(waits, "needs_review").otherwise("completed").alias("status")
    )


# ------------------------------------------------------------------ evidence items


def _nz(c: str, default) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), default)


def evidence_items(fields: DataFrame, images: DataFrame) -> DataFrame:
    """Tagged items with percent boxes and measured heights.

    Tags number the fields of an inspection by type, then by order.  The type is
    the ranking slot, so numbering never sorts a whole inspection at once.
    """
    order = F.coalesce(case_map(F.col("field_type"), {t: i for i, t in enumerate(V.EVIDENCE_ORDER)}), F.lit(99))
    numbered = ranked(
        fields.select("id", "inspection_id", "source_image_id", "field_type", "field_seq", "confidence", "verdict",
                      "box_x", "box_y", "box_w", "box_h"),
        ["inspection_id"], order, [F.col("field_seq")], "n",
    )
    cols = ["width_px", "height_px", "calibration_scale_mm_per_px"]
    front = primary_image(images.select("inspection_id", "id", "image_role", *cols)).select(
        "inspection_id", *[F.col(c).alias("front_" + c) for c in cols]
    )
    own = images.select(F.col("id").alias("source_image_id"), *cols)
    rows = numbered.join(own, "source_image_id", "left").join(front, "inspection_id", "left")
    cur_w = _nz("width_px", _nz("front_width_px", F.lit(V.DEFAULT_PANEL_PX[0])))
    cur_h = _nz("height_px", _nz("front_height_px", F.lit(V.DEFAULT_PANEL_PX[1])))
    scale = _nz("calibration_scale_mm_per_px", _nz("front_calibration_scale_mm_per_px", F.lit(None).cast("double")))
    x, y, w, h = (F.coalesce(F.col(c).cast("double"), F.lit(d)) for c, d in (("box_x", 0.0), ("box_y", 0.0), ("box_w", 100.0), ("box_h", 30.0)))
    point = lambda a, b: F.array(a, b)
    calibrated = F.coalesce(scale > 0, F.lit(False))
    pct = lambda v, side: F.round(v / side * 100, 2)
    return rows.select(
        "inspection_id", F.col("id").alias("field_id"), "field_type",
        F.concat(F.lit("E"), F.when(F.col("n") < 10, F.format_string("%02d", "n")).otherwise(F.col("n").cast("string"))).alias("item_id"),
        field_label(F.col("field_type")).alias("field_label"), "confidence", "verdict", "source_image_id",
        pct(x, cur_w).alias("left_pct"), pct(y, cur_h).alias("top_pct"), pct(w, cur_w).alias("width_pct"), pct(h, cur_h).alias("height_pct"),
        F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)).alias("polygon"),
        cur_w.alias("source_width_px"), cur_h.alias("source_height_px"),
        scale.isNotNull().alias("is_calibrated"),
        F.when(calibrated, F.round(h * scale, 2)).alias("height_mm"),
        F.when(~calibrated, F.round(h / cur_h, 4)).alias("pdp_ratio"),
        F.when(~calibrated, "Uncalibrated measurement: barcode reference missing").alias("warning"),
    )


def indeterminate(description: Column) -> Column:
    """A stored violation that is an open question rather than a failed check."""
    text = F.lower(F.coalesce(description, F.lit("")))
    return any_of([F.contains(text, F.lit(m)) for m in V.INDETERMINATE_MARKERS])


def _severe() -> Column:
    return F.col("severity").isin("critical", "major") & ~indeterminate(F.col("description"))


def evidence_verdicts(fields: DataFrame, violations: DataFrame) -> DataFrame:
    """fail, needs_review or pass per field."""
    bound = violations.filter("extracted_field_id IS NOT NULL").groupBy(
        "inspection_id", F.col("extracted_field_id").alias("id")
    ).agg(F.bool_or(_severe()).alias("severe"))
    return fields.select("inspection_id", "id", "verdict").join(bound, ["inspection_id", "id"], "left").select(
        "inspection_id", F.col("id").alias("field_id"),
        F.when((F.col("verdict") == "fail") | F.coalesce("severe", F.lit(False)), "fail")
        .when((F.col("verdict") == "needs_review") | F.col("severe").isNotNull(), "needs_review")
        .otherwise("pass")
        .alias("item_verdict"),
    )


def evidence_overall(inspections: DataFrame, verdicts: DataFrame, violations: DataFrame) -> DataFrame:
    """Overall status with the violations no field carries, and the item tallies."""
    n = lambda v: F.count_if(F.col("item_verdict") == v)
    tally = verdicts.groupBy("inspection_id").agg(
        F.count(F.lit(1)).alias("total"), n("pass").alias("passed"), n("needs_review").alias("review"), n("fail").alias("failed")
    )
    loose = violations.filter("extracted_field_id IS NULL").groupBy("inspection_id").agg(F.bool_or(_severe()).alias("severe"))
    zero = F.lit(0).cast("bigint")
    rows = (
        inspections.select(F.col("id").alias("inspection_id"))
        .join(tally, "inspection_id", "left").join(loose, "inspection_id", "left")
        .select("inspection_id", "severe", *[F.coalesce(c, zero).alias(c) for c in ("total", "passed", "review", "failed")])
    )
    failed = (F.col("failed") > 0) | F.coalesce("severe", F.lit(False))
    waits = (F.col("review") > 0) | F.col("severe").isNotNull()
    return rows.select(
        "inspection_id",
        F.when(failed, "violations_found").when(waits, "needs_review").otherwise("compliant").alias("overall_status"),
        "total", "passed", "review", "failed",
    )


def _json_field(value: Column, key: str) -> Column:
    return F.when(F.ltrim(value).startswith("{"), F.get_json_object(value, f"$.{key}"))


def display_value(value: Column) -> Column:
    """What a declaration shows: the name, the address or the value inside its JSON, else the text itself."""
    return F.coalesce(*[_json_field(value, k) for k in ("commodity_name", "name_and_address", "value")], value)


def product_name(inspections: DataFrame, fields: DataFrame, images: DataFrame) -> DataFrame:
    """The best commodity name of each inspection; names on the front panel count 0.1 more."""
    front = primary_image(images.select("inspection_id", "id", "image_role")).select(
        "inspection_id", F.col("id").alias("front_id")
    )
    raw = F.coalesce(_json_field(F.col("parsed_value"), "commodity_name"), F.col("parsed_value"))
    name = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
    usable = (F.length("name") >= 3) & ~any_of([F.contains(F.lower("name"), F.lit(p)) for p in V.NON_PRODUCT_PHRASES])
    score = F.coalesce("confidence", F.lit(0.0)) + F.when(F.col("source_image_id") == F.col("front_id"), 0.1).otherwise(0.0)
    best = (
        fields.filter("field_type = 'commodity_name'")
        .select("inspection_id", "source_image_id", "confidence", "field_seq", name.alias("name"))
        .filter(usable)
        .join(front, "inspection_id", "left")
        .groupBy("inspection_id")
        .agg(F.max_by("name", F.struct(score, -F.col("field_seq"))).alias("best"))
    )
    words = F.coalesce(F.nullif("commodity_category", F.lit("")), F.lit("Packaged Commodity"))
    other = F.concat(F.lit("Inspected "), F.initcap(F.replace(words, F.lit("_"), F.lit(" "))))
    return (
        inspections.select(F.col("id").alias("inspection_id"), "commodity_category")
        .join(best, "inspection_id", "left")
        .select("inspection_id", F.coalesce("best", other).alias("product_name"))
    )
