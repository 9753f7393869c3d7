"""Catalog: rule packs and rule evaluation."""

from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.operators import rules as R
from panelcheck.plans.catalog.registry import query
from panelcheck.plans.catalog.views import view, with_views
from panelcheck.functions.verdicts import font_threshold
from panelcheck.sources import rulepacks as P


def lit(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _rule_row(i, r):
    mm = r.get("thresholds_mm") or {}
    heights = ", ".join(f"{mm[k]}e0" if k in mm else "NULL" for k in ("50", "100", "500", "2500", "gt_2500"))
    cats = "[" + ", ".join(lit(c) for c in r["applies_to"]) + "]"
    return f"({i}, {lit(r['rule_id'])}, {cats}, {lit(r['type'])}, {lit(r['field'])}, {lit(r['citation'])}, {lit(r['severity'])}, {heights})"


view("core_rules", (), "SELECT * FROM (VALUES " + ",\n".join(_rule_row(i, r) for i, r in enumerate(V.CORE_RULES)) + """
) r(rule_seq, rule_id, applies_to, type, field, citation, severity, t50, t100, t500, t2500, tmax)""")
view("thresholds", (), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}e0)" for k, v in V.FIELD_THRESHOLDS.items())
     + ") t(threshold_type, threshold)")
view("applicable", ("inspections", "core_rules"), f"""SELECT i.id AS inspection_id, '{V.CORE_PACK_VERSION}' AS rule_pack_version, r.*
 FROM inspections i JOIN core_rules r
 ON list_contains(r.applies_to, 'all') OR list_contains(r.applies_to, coalesce(i.commodity_category, 'general'))""")
view("first_fields", ("extracted_fields",), """SELECT * EXCLUDE (rn) FROM (SELECT *,
 row_number() OVER (PARTITION BY inspection_id, field_type ORDER BY field_seq) AS rn FROM extracted_fields) q WHERE rn = 1""")
view("primary_images", ("images",), """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id
 ORDER BY CASE WHEN image_role = 'front_pdp' THEN 0 ELSE 1 END, id) AS rn FROM images) q WHERE rn = 1""")
view("judged", ("applicable", "first_fields", "primary_images", "thresholds"), """
SELECT *, CASE
 WHEN type = 'field_required' THEN CASE WHEN fid IS NULL THEN 'fail' WHEN reviewed AND fv = 'fail' THEN 'fail' WHEN reviewed THEN 'pass'
   WHEN fv = 'needs_review' OR confidence < need THEN 'needs_review' ELSE 'pass' END
 WHEN type = 'legibility_contrast' THEN CASE WHEN fid IS NULL THEN 'needs_review' WHEN reviewed THEN 'pass'
   WHEN confidence < 0.70e0 THEN 'needs_review' ELSE 'pass' END
 ELSE CASE WHEN fid IS NULL THEN 'needs_review' WHEN reviewed AND fv = 'not_applicable' THEN 'pass'
   WHEN scale IS NULL OR scale <= 0 THEN CASE WHEN reviewed THEN 'pass' ELSE 'needs_review' END
   WHEN round(box_h * scale, 2) >= CASE WHEN area <= 50 THEN coalesce(t50, 1.0e0) WHEN area <= 100 THEN coalesce(t100, 1.5e0)
     WHEN area <= 500 THEN coalesce(t500, 2.0e0) WHEN area <= 2500 THEN coalesce(t2500, 4.0e0) ELSE coalesce(tmax, 6.0e0) END
   THEN 'pass' ELSE 'fail' END END AS verdict
FROM (SELECT a.*, f.id AS fid, f.confidence, f.box_h, f.verdict AS fv, f.reviewed_by_officer AS reviewed,
 coalesce(t.threshold, 0.85e0) AS need, p.calibration_scale_mm_per_px AS scale,
 coalesce(p.width_px, 1200.0e0) * p.calibration_scale_mm_per_px * coalesce(p.height_px, 1600.0e0) * p.calibration_scale_mm_per_px / 100.0e0 AS area
 FROM applicable a LEFT JOIN first_fields f ON f.inspection_id = a.inspection_id AND f.field_type = a.field
 LEFT JOIN primary_images p ON p.inspection_id = a.inspection_id LEFT JOIN thresholds t ON t.threshold_type = a.field) q""")
view("overall", ("inspections", "judged"), """SELECT i.id AS inspection_id,
 CASE WHEN bool_or(j.verdict = 'fail') THEN 'fail' WHEN bool_or(j.verdict = 'needs_review') THEN 'needs_review' ELSE 'pass' END AS overall
 FROM inspections i LEFT JOIN judged j ON j.inspection_id = i.id GROUP BY 1""")


def results(f, packs=None):
    return R.evaluate_rules(f.inspections(), f.extracted_fields(), f.images(), packs or f.rule_packs())


@query(
    "r1_applicable_rules",
    with_views("applicable") + "SELECT inspection_id, rule_pack_version, rule_seq, rule_id, type, field, citation, severity FROM applicable",
)
def _(f):
    return R.applicable_rules(f.inspections(), f.rule_packs())


@query(
    "r2_first_field_per_type",
    with_views("first_fields") + "SELECT inspection_id, field_type, id, field_seq, parsed_value, confidence, verdict FROM first_fields",
)
def _(f):
    return R.first_field_per_type(f.extracted_fields()).select(
        "inspection_id", "field_type", "id", "field_seq", "parsed_value", "confidence", "verdict"
    )


_COLS = "inspection_id, rule_id, field_type, extracted_field_id, verdict, severity"
_SQL_COLS = "inspection_id, rule_id, field AS field_type, fid AS extracted_field_id, verdict, severity"


def _by_type(name, types):
    listed = ", ".join(lit(t) for t in types)

    @query(name, with_views("judged") + f"SELECT {_SQL_COLS} FROM judged WHERE type IN ({listed})")
    def _(f):
        return results(f).filter(F.col("type").isin(*types)).select(*_COLS.split(", "))


_by_type("r3_eval_field_required", ["field_required"])
_by_type("r4_eval_font_height", V.FONT_RULE_TYPES)
_by_type("r6_eval_legibility", ["legibility_contrast"])


@query(
    "r5_font_threshold",
    with_views("primary_images", "core_rules")
    + """SELECT inspection_id, rule_id, CASE WHEN area <= 50 THEN coalesce(t50, 1.0e0) WHEN area <= 100 THEN coalesce(t100, 1.5e0)
     WHEN area <= 500 THEN coalesce(t500, 2.0e0) WHEN area <= 2500 THEN coalesce(t2500, 4.0e0) ELSE coalesce(tmax, 6.0e0) END AS threshold_mm
 FROM (SELECT inspection_id, coalesce(width_px, 1200.0e0) * calibration_scale_mm_per_px * coalesce(height_px, 1600.0e0)
  * calibration_scale_mm_per_px / 100.0e0 AS area FROM primary_images WHERE calibration_scale_mm_per_px IS NOT NULL) p
 CROSS JOIN core_rules r WHERE r.t50 IS NOT NULL""",
)
def _(f):
    area = F.col("panel_w") * F.col("scale") * F.col("panel_h") * F.col("scale") / 100.0
    rules = F.array(
        *[
            F.struct(
                F.lit(r["rule_id"]).alias("rule_id"),
                F.create_map(*[F.lit(x) for kv in r["thresholds_mm"].items() for x in kv]).alias("mm"),
            )
            for r in V.CORE_RULES
            if r.get("thresholds_mm")
        ]
    )
    return (
        R.panels(f.images())
        .filter("scale IS NOT NULL")
        .select("inspection_id", area.alias("area"), F.explode(rules).alias("r"))
        .select("inspection_id", "r.rule_id", font_threshold(F.col("area"), F.col("r.mm")).alias("threshold_mm"))
    )


@query("r7_rule_descriptions")
def _(f):
    return results(f).select("inspection_id", "rule_id", "verdict", "description", "is_calibrated", "warning")


@query("r8_overall_verdict", with_views("overall") + "SELECT * FROM overall")
def _(f):
    return R.overall_verdict(f.inspections(), results(f))


@query(
    "r9_rule_violations",
    with_views("judged")
    + """SELECT inspection_id, fid AS extracted_field_id, rule_id, rule_pack_version, citation, severity FROM judged
 WHERE verdict IN ('fail', 'needs_review')""",
)
def _(f):
    return R.rule_violations(results(f)).drop("description")


@query(
    "r13_evaluate_rules",
    with_views("judged", "overall")
    + f"SELECT {', '.join('j.' + c.strip() for c in _SQL_COLS.split(','))}, o.overall FROM judged j JOIN overall o ON o.inspection_id = j.inspection_id",
)
def _(f):
    return R.with_overall(results(f).select(*_COLS.split(", ")))


@query(
    "s2_load_rule_pack",
    with_views("core_rules", "inspections")
    + f"""SELECT n.version, r.rule_seq, r.rule_id, r.type, r.field, r.severity, len(r.applies_to) AS categories, r.t500 AS mm_500, n.inspections
 FROM (SELECT rule_pack_version AS version, count(*) AS inspections FROM inspections GROUP BY 1) n CROSS JOIN core_rules r""",
)
def _(f):
    from panelcheck.sources.files import written_json

    packs = (
        f.inspections()
        .groupBy(F.col("rule_pack_version").alias("version"))
        .agg(F.count(F.lit(1)).alias("inspections"))
    )
    core = f.rule_packs().select("rules", F.lit(1).alias("one"))
    files = packs.withColumn("one", F.lit(1)).join(core, "one").select(F.col("version").alias("rule_pack_version"), "rules")
    folder = written_json(f.spark, files, "rule_packs")
    rules = P.flatten_rules(
        f.spark.read.schema(P.RULE_PACK_FILE).json(folder).withColumnRenamed("rule_pack_version", "version")
    )
    return rules.join(packs, "version").select(
        "version", "rule_seq", "rule_id", "type", "field", "severity", F.size("applies_to").alias("categories"),
        F.element_at("thresholds_mm", F.lit("500")).alias("mm_500"), "inspections",
    )


# Packs for the pack operators: one per nation, cut from the core rules, some of them broken on purpose.
view("nation_packs", (), f"""SELECT concat('2025.', CAST(n_nationkey AS VARCHAR)) AS version,
 CASE WHEN n_nationkey % 6 = 5 THEN 'other' ELSE concat('2025.', CAST(n_nationkey AS VARCHAR)) END AS body_version,
 CASE WHEN n_nationkey % 7 = 6 THEN 0 ELSE 1 + n_nationkey % 12 END AS rule_count, n_nationkey = 4 AS is_active, n_nationkey FROM nation""")


def nation_packs(f):
    n = F.col("n_nationkey")
    core = f.rule_packs().select("rules", "source_citation", "effective_from", F.lit(1).alias("one"))
    size = F.when(n % 7 == 6, 0).otherwise(1 + n % 12)
    broken = F.transform(
        F.slice("rules", 1, size),
        lambda r: r.withField("field", F.when(n % 5 == 3, F.lit(None)).otherwise(r["field"])).withField(
            "thresholds_mm", F.when(n % 4 == 1, F.lit(None)).otherwise(r["thresholds_mm"])
        ),
    )
    version = F.concat(F.lit("2025."), n.cast("string"))
    return (
        f.base("nation").withColumn("one", F.lit(1)).join(core, "one")
        .select(
            version.alias("version"), "effective_from", "source_citation", broken.alias("rules"), (n == 4).alias("is_active"),
            F.when(n % 6 == 5, "other").otherwise(version).alias("body_version"), n.cast("bigint").alias("actor_user_id"),
        )
    )


@query(
    "r11_validate_rule_pack",
    with_views("nation_packs", "core_rules")
    + """SELECT version, rule_id, 'field_missing' AS problem FROM nation_packs JOIN core_rules ON rule_seq < rule_count
  WHERE n_nationkey % 5 = 3 AND type = 'field_required'
 UNION ALL SELECT version, rule_id, 'thresholds_missing' FROM nation_packs JOIN core_rules ON rule_seq < rule_count
  WHERE n_nationkey % 4 = 1 AND type LIKE 'font%'
 UNION ALL SELECT version, NULL, 'no_rules' FROM nation_packs WHERE rule_count = 0""",
)
def _(f):
    return P.validate_rule_pack(nation_packs(f))


_BAD = """(n_nationkey % 7 = 6 OR n_nationkey % 5 = 3 OR (n_nationkey % 4 = 1 AND rule_count >= 8))"""


@query(
    "r12_register_pack",
    with_views("nation_packs")
    + f"""SELECT version, CASE WHEN {_BAD} THEN 'invalid_schema' WHEN version <> body_version THEN 'version_mismatch'
 WHEN n_nationkey < 3 THEN 'version_exists' ELSE 'accepted' END AS outcome FROM nation_packs""",
)
def _(f):
    packs = nation_packs(f)
    stored = packs.filter("actor_user_id < 3").drop("body_version", "actor_user_id")
    ok, rejected, _audit = P.register_pack(packs, stored)
    return ok.select("version", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("version", F.col("reason").alias("outcome"))
    )


@query(
    "r12_register_audit",
    with_views("nation_packs")
    + f"""SELECT version AS entity_id, CAST(n_nationkey AS BIGINT) AS actor_user_id, 'rule_pack_created' AS action,
 concat('{{"effective_from": "2026-02-01", "rule_count": ', CAST(rule_count AS VARCHAR), ', "version": "', version, '"}}') AS after_value
 FROM nation_packs WHERE NOT {_BAD} AND version = body_version AND n_nationkey >= 3""",
)
def _(f):
    packs = nation_packs(f)
    stored = packs.filter("actor_user_id < 3").drop("body_version", "actor_user_id")
    return P.register_pack(packs, stored)[2].select("entity_id", "actor_user_id", "action", "after_value")


@query(
    "r12_activate_pack",
    with_views("nation_packs") + "SELECT version, version = '2025.9' AS is_active FROM nation_packs",
)
def _(f):
    return P.activate_pack(nation_packs(f), "2025.9", 1)[0].select("version", "is_active")


@query(
    "f12_list_rule_packs",
    with_views("nation_packs") + "SELECT version, is_active, CAST(rule_count AS INT) AS rule_count FROM nation_packs",
)
def _(f):
    return P.list_rule_packs(nation_packs(f)).select("version", "is_active", "rule_count")


@query(
    "f12_active_pack",
    with_views("nation_packs")
    + "SELECT version, CAST(rule_count AS INT) AS rule_count FROM nation_packs WHERE is_active",
)
def _(f):
    packs = nation_packs(f).drop("body_version", "actor_user_id")
    return P.list_rule_packs(P.active_pack(packs, f.rule_packs())).select("version", "rule_count")
