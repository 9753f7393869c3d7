"""Catalog: review and evidence."""

from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.expr import json_object, json_text
from panelcheck.operators import evidence as E
from panelcheck.operators import review as R
from panelcheck.operators import rules as Ru
from panelcheck.plans.catalog.registry import query
import panelcheck.plans.catalog.rules  # noqa: F401  (views)
from panelcheck.plans.catalog.views import view, with_views

NOW = "2026-03-01 10:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


view("queue", ("extracted_fields", "thresholds", "violations"), """SELECT f.*, coalesce(t.threshold, 0.85e0) AS need, coalesce(v.n, 0) AS nv
 FROM extracted_fields f LEFT JOIN thresholds t ON t.threshold_type = f.field_type
 LEFT JOIN (SELECT extracted_field_id, count(*) AS n FROM violations GROUP BY 1) v ON v.extracted_field_id = f.id""")
_LABEL = "CASE field_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.FIELD_LABELS.items()) + " ELSE upper(replace(field_type, '_', ' ')) END"


@query(
    "v1_review_queue",
    with_views("queue")
    + f"""SELECT id AS field_id, inspection_id, {_LABEL} AS field_label, confidence, verdict,
 CASE WHEN confidence < need THEN 'low_confidence' WHEN verdict = 'needs_review' THEN 'needs_review'
 WHEN reviewed_by_officer THEN 'reviewed' ELSE 'verified' END AS flag, nv AS violations FROM queue""",
)
def _(f):
    rows = R.review_queue(f.extracted_fields(), f.violations())
    return rows.select("field_id", "inspection_id", "field_label", "confidence", "verdict", "flag", "violations")


_COUNTS = """SELECT inspection_id, count(*) AS total_fields,
 count(*) FILTER (WHERE NOT reviewed_by_officer AND (verdict = 'needs_review' OR confidence < need)) AS pending_review_count,
 count(*) FILTER (WHERE reviewed_by_officer) AS completed_review_count FROM queue GROUP BY 1"""


@query("v2_review_counts", with_views("queue") + _COUNTS)
def _(f):
    return R.review_counts(f.extracted_fields())


def actions(f, third):
    """Review actions from the lineitem table: several per field, some of them invalid."""
    n = F.col("l_linenumber")
    line = f.base("lineitem").filter(n <= 4).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    return line.select(
        (F.col("l_orderkey") * 100 + F.col("l_partkey") % 4).alias("field_id"),
        (n + F.col("l_partkey") * 10).cast("bigint").alias("action_seq"),
        F.when(F.col("l_suppkey") % 4 == 0, "confirm").when(F.col("l_suppkey") % 4 == 1, third)
        .when(F.col("l_suppkey") % 4 == 2, "mark_not_applicable").otherwise(F.when(n == 3, "retract").otherwise("confirm")).alias("action"),
        F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit(" v"), n.cast("string"), F.lit(" "))).alias("override_value"),
        F.lit("checked on site").alias("notes"),
        F.col("l_suppkey").alias("actor_user_id"),
    )


def actions_sql(third):
    return f"""SELECT * FROM (SELECT l_orderkey * 100 + l_partkey % 4 AS field_id, CAST(l_linenumber + l_partkey * 10 AS BIGINT) AS action_seq,
 CASE WHEN l_suppkey % 4 = 0 THEN 'confirm' WHEN l_suppkey % 4 = 1 THEN '{third}' WHEN l_suppkey % 4 = 2 THEN 'mark_not_applicable'
  ELSE CASE WHEN l_linenumber = 3 THEN 'retract' ELSE 'confirm' END END AS action,
 CASE WHEN l_partkey % 5 <> 0 THEN concat(' v', l_linenumber, ' ') END AS override_value, l_suppkey AS actor_user_id
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3) m) q"""


for _mode, _third in (("single", "correct"), ("batch", "override")):
    _bad = "action NOT IN ('confirm', '%s', 'mark_not_applicable')" % _third
    if _mode == "single":
        _bad += " OR (action = 'correct' AND override_value IS NULL)"
    view(f"actions_{_mode}", (), actions_sql(_third))
    view(f"valid_{_mode}", (f"actions_{_mode}", "extracted_fields"),
         f"SELECT * FROM actions_{_mode} WHERE NOT ({_bad}) AND field_id IN (SELECT id FROM extracted_fields)")
    _touch = "action <> 'confirm'" if _mode == "single" else "TRUE"
    _value = "trim(override_value)" if _mode == "single" else "override_value"
    view(f"reviewed_{_mode}", ("extracted_fields", f"valid_{_mode}"), f"""SELECT f.* REPLACE (
  CASE WHEN a.action IS NULL THEN f.verdict WHEN a.action = 'mark_not_applicable' THEN 'not_applicable' ELSE 'pass' END AS verdict,
  f.reviewed_by_officer OR a.action IS NOT NULL AS reviewed_by_officer,
  CASE WHEN o.field_id IS NULL THEN f.officer_override_value WHEN o.action = '{_third}' THEN {_value.replace('override_value', 'o.override_value')} END AS officer_override_value)
 FROM extracted_fields f
 LEFT JOIN (SELECT * FROM valid_{_mode} QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY action_seq DESC) = 1) a ON a.field_id = f.id
 LEFT JOIN (SELECT * FROM valid_{_mode} WHERE {_touch} QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY action_seq DESC) = 1) o ON o.field_id = f.id""")

    def _apply(mode, third):
        @query(
            f"v3_apply_reviews_{mode}",
            with_views(f"reviewed_{mode}") + f"SELECT id, verdict, reviewed_by_officer, officer_override_value FROM reviewed_{mode}",
        )
        def _(f):
            rows = R.apply_reviews(f.extracted_fields(), actions(f, third), mode)
            return rows.select("id", "verdict", "reviewed_by_officer", "officer_override_value")

        @query(
            f"v3_review_errors_{mode}",
            with_views(f"actions_{mode}", "extracted_fields")
            + f"""SELECT field_id, action_seq, CASE WHEN field_id NOT IN (SELECT id FROM extracted_fields) THEN 'field_not_found'
 WHEN action = 'retract' THEN 'invalid_action' ELSE 'override_value_required' END AS reason FROM actions_{mode}
 WHERE field_id NOT IN (SELECT id FROM extracted_fields) OR action = 'retract' """
            + ("OR (action = 'correct' AND override_value IS NULL)" if mode == "single" else ""),
        )
        def _(f):
            return R.review_errors(f.extracted_fields(), actions(f, third), mode).select("field_id", "action_seq", "reason")

        @query(f"v4_review_audit_rows_{mode}")
        def _(f):
            return R.review_audit_rows(f.extracted_fields(), actions(f, third), now(), mode)

    _apply(_mode, _third)


view("rejudged", ("applicable", "reviewed_single", "primary_images", "thresholds"), """
SELECT inspection_id, CASE
 WHEN type = 'field_required' THEN CASE WHEN fid IS NULL THEN 'fail' WHEN reviewed AND fv = 'fail' THEN 'fail' WHEN reviewed THEN 'pass'
   WHEN fv = 'needs_review' OR confidence < need THEN 'needs_review' ELSE 'pass' END
 WHEN type = 'legibility_contrast' THEN CASE WHEN fid IS NULL THEN 'needs_review' WHEN reviewed THEN 'pass'
   WHEN confidence < 0.70e0 THEN 'needs_review' ELSE 'pass' END
 ELSE CASE WHEN fid IS NULL THEN 'needs_review' WHEN reviewed AND fv = 'not_applicable' THEN 'pass'
   WHEN scale IS NULL OR scale <= 0 THEN CASE WHEN reviewed THEN 'pass' ELSE 'needs_review' END
   WHEN round(box_h * scale, 2) >= CASE WHEN area <= 50 THEN t50 WHEN area <= 100 THEN t100
     WHEN area <= 500 THEN t500 WHEN area <= 2500 THEN t2500 ELSE tmax END
   THEN 'pass' ELSE 'fail' END END AS verdict
FROM (SELECT a.*, f.id AS fid, f.confidence, f.box_h, f.verdict AS fv, f.reviewed_by_officer AS reviewed,
 coalesce(t.threshold, 0.85e0) AS need, p.calibration_scale_mm_per_px AS scale,
 coalesce(p.width_px, 1200.0e0) * p.calibration_scale_mm_per_px * coalesce(p.height_px, 1600.0e0) * p.calibration_scale_mm_per_px / 100.0e0 AS area
 FROM applicable a LEFT JOIN (SELECT * FROM reviewed_single QUALIFY row_number() OVER (PARTITION BY inspection_id, field_type ORDER BY field_seq) = 1) f
  ON f.inspection_id = a.inspection_id AND f.field_type = a.field
 LEFT JOIN primary_images p ON p.inspection_id = a.inspection_id LEFT JOIN thresholds t ON t.threshold_type = a.field) q""")


@query(
    "v5_status_after_review",
    with_views("inspections", "rejudged", "reviewed_single", "thresholds")
    + """SELECT i.id AS inspection_id, CASE WHEN coalesce(p.pending, 0) > 0 OR (NOT coalesce(j.f, FALSE) AND coalesce(j.r, FALSE))
 THEN 'needs_review' ELSE 'completed' END AS status FROM inspections i
 LEFT JOIN (SELECT inspection_id, bool_or(verdict = 'fail') AS f, bool_or(verdict = 'needs_review') AS r FROM rejudged GROUP BY 1) j ON j.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, count(*) FILTER (WHERE NOT reviewed_by_officer AND (verdict = 'needs_review' OR confidence < coalesce(threshold, 0.85e0))) AS pending
  FROM reviewed_single LEFT JOIN thresholds ON threshold_type = field_type GROUP BY 1) p ON p.inspection_id = i.id""",
)
def _(f):
    read = f.extracted_fields().select("inspection_id", "field_type", "field_seq", *Ru.FIELD_COLUMNS)
    fields = R.apply_reviews(read, actions(f, "correct"), by="inspection_id")
    judged = Ru.evaluate_rules(f.inspections(), fields, f.images(), f.rule_packs())
    return R.status_after_review(Ru.overall_verdict(f.inspections(), judged), fields)


_ORDER = "CASE field_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(V.EVIDENCE_ORDER)) + " ELSE 99 END"


@query(
    "v6_evidence_items",
    with_views("extracted_fields", "images", "primary_images")
    + f"""SELECT inspection_id, id AS field_id, concat('E', lpad(CAST(n AS VARCHAR), greatest(2, length(CAST(n AS VARCHAR)))::INT, '0')) AS item_id, {_LABEL} AS field_label,
 round(box_x / cw * 100, 2) AS left_pct, round(box_y / ch * 100, 2) AS top_pct, round(box_w / cw * 100, 2) AS width_pct,
 round(box_h / ch * 100, 2) AS height_pct, cs IS NOT NULL AS is_calibrated,
 CASE WHEN cs > 0 THEN round(box_h * cs, 2) END AS height_mm, CASE WHEN cs > 0 THEN NULL ELSE round(box_h / ch, 4) END AS pdp_ratio
 FROM (SELECT f.*, row_number() OVER (PARTITION BY f.inspection_id ORDER BY {_ORDER}, field_seq) AS n,
  CAST(coalesce(i.width_px, p.width_px, 1200) AS DOUBLE) AS cw, CAST(coalesce(i.height_px, p.height_px, 1600) AS DOUBLE) AS ch,
  coalesce(i.calibration_scale_mm_per_px, p.calibration_scale_mm_per_px) AS cs
  FROM extracted_fields f LEFT JOIN images i ON i.id = f.source_image_id LEFT JOIN primary_images p ON p.inspection_id = f.inspection_id) q""",
)
def _(f):
    rows = R.evidence_items(f.extracted_fields(), f.images())
    return rows.select(
        "inspection_id", "field_id", "item_id", "field_label", "left_pct", "top_pct", "width_pct", "height_pct",
        "is_calibrated", "height_mm", "pdp_ratio",
    )


view("item_verdicts", ("extracted_fields", "violations"), """SELECT f.inspection_id, f.id AS field_id,
 CASE WHEN f.verdict = 'fail' OR coalesce(v.severe, FALSE) THEN 'fail' WHEN f.verdict = 'needs_review' OR v.severe IS NOT NULL THEN 'needs_review'
 ELSE 'pass' END AS item_verdict FROM extracted_fields f LEFT JOIN (SELECT inspection_id, extracted_field_id,
  bool_or(severity IN ('critical', 'major')) AS severe FROM violations GROUP BY 1, 2) v ON v.extracted_field_id = f.id AND v.inspection_id = f.inspection_id""")


@query("v7_evidence_verdicts", with_views("item_verdicts") + "SELECT * FROM item_verdicts")
def _(f):
    return R.evidence_verdicts(f.extracted_fields(), f.violations())


@query(
    "v8_evidence_overall",
    with_views("inspections", "item_verdicts", "violations")
    + """SELECT i.id AS inspection_id, CASE WHEN t.failed > 0 OR coalesce(u.severe, FALSE) THEN 'violations_found'
 WHEN t.review > 0 OR u.severe IS NOT NULL THEN 'needs_review' ELSE 'compliant' END AS overall_status,
 coalesce(t.total, 0) AS total, coalesce(t.passed, 0) AS passed, coalesce(t.review, 0) AS review, coalesce(t.failed, 0) AS failed
 FROM inspections i LEFT JOIN (SELECT inspection_id, count(*) AS total, count(*) FILTER (WHERE item_verdict = 'pass') AS passed,
  count(*) FILTER (WHERE item_verdict = 'needs_review') AS review, count(*) FILTER (WHERE item_verdict = 'fail') AS failed
  FROM item_verdicts GROUP BY 1) t ON t.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, bool_or(severity IN ('critical', 'major')) AS severe FROM violations WHERE extracted_field_id IS NULL GROUP BY 1) u
 ON u.inspection_id = i.id""",
)
def _(f):
    return R.evidence_overall(f.inspections(), R.evidence_verdicts(f.extracted_fields(), f.violations()), f.violations())


def named_fields(f):
    """Commodity names as JSON, so that every step of the choice is used."""
    k = F.col("id") % 5
    name = F.when(k == 0, "  Crunchy   Snack ").when(k == 1, "Cut here").when(k == 2, "ok").otherwise(F.concat(F.lit("Brand "), (F.col("id") % 7).cast("string")))
    text = F.when(F.col("id") % 3 == 0, name).otherwise(
        json_object([("commodity_name", json_text(name)), ("detection_method", json_text(F.lit("test")))]))
    return f.extracted_fields().withColumn("parsed_value", F.when(F.col("field_type") == "commodity_name", text).otherwise(F.col("parsed_value")))


_NAME = "CASE id % 5 WHEN 0 THEN '  Crunchy   Snack ' WHEN 1 THEN 'Cut here' WHEN 2 THEN 'ok' ELSE concat('Brand ', id % 7) END"
view("names", ("extracted_fields",), f"SELECT *, {_NAME} AS nm FROM extracted_fields WHERE field_type = 'commodity_name'")


@query(
    "v9_product_name",
    with_views("inspections", "names", "primary_images")
    + r"""SELECT i.id AS inspection_id, coalesce(b.nm, CASE i.commodity_category WHEN 'pan_masala' THEN 'Inspected Pan Masala'
 WHEN 'blown_glass' THEN 'Inspected Blown Glass' ELSE CASE WHEN i.commodity_category IS NULL THEN 'Inspected Packaged Commodity' ELSE concat('Inspected ', upper(i.commodity_category[1]), i.commodity_category[2:]) END END) AS product_name
 FROM inspections i LEFT JOIN (SELECT n.inspection_id, trim(regexp_replace(n.nm, '\s+', ' ', 'g')) AS nm FROM names n
  JOIN primary_images p ON p.inspection_id = n.inspection_id WHERE n.id % 5 NOT IN (1, 2)
  QUALIFY row_number() OVER (PARTITION BY n.inspection_id ORDER BY n.confidence + CASE WHEN n.source_image_id = p.id THEN 0.1e0 ELSE 0.0e0 END DESC, n.field_seq) = 1) b
 ON b.inspection_id = i.id""",
)
def _(f):
    return R.product_name(f.inspections(), named_fields(f), f.images())


@query(
    "v10_display_value",
    with_views("names") + f"SELECT id, nm AS shown FROM names",
)
def _(f):
    rows = named_fields(f).filter("field_type = 'commodity_name'")
    return rows.select("id", R.display_value(F.col("parsed_value")).alias("shown"))


# ------------------------------------------------------------------ evidence


def files(f):
    i = F.col("id")
    return f.images().filter(i % 7 != 0).select(
        F.concat_ws("/", F.col("inspection_id").cast("string"), F.concat(i.cast("string"), F.lit(".jpg"))).alias("path"),
        F.when(i % 11 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.sha2(F.concat(F.lit("img-"), i.cast("string")), 256)).alias("sha256"),
    )


view("integrity", ("images",), """SELECT *, CASE WHEN sha256_hash IS NULL THEN 'unhashed'
 WHEN id % 7 = 0 THEN CASE WHEN starts_with(storage_url, 'local://') THEN 'file_missing' ELSE 'verified' END
 WHEN id % 11 = 0 THEN 'hash_mismatch' ELSE 'verified' END AS file_integrity FROM images""")


def integrity(f):
    return E.image_integrity(f.images(), files(f))


@query("e1_image_integrity", with_views("integrity") + "SELECT id, inspection_id, image_role, file_integrity FROM integrity")
def _(f):
    return integrity(f).select("id", "inspection_id", "image_role", "file_integrity")


def hashed_logs(f):
    """Audit rows with hashes; every 97th was tampered with and every 50th names a wrong predecessor."""
    i = F.col("id")
    logs = f.audit_logs().withColumn("prev_hash", F.when(i % 50 == 7, "feed"))
    return logs.withColumn("entry_hash", F.when(i % 97 == 3, "bad").otherwise(E.audit_entry_hash()))


_HASH = """sha256(concat_ws(':', coalesce(prev_hash, 'GENESIS'), CAST(actor_user_id AS VARCHAR), action, entity_type, CAST(entity_id AS VARCHAR),
 coalesce(before_value, ''), coalesce(after_value, '')))"""
view("linked", ("audit_logs",), "SELECT *, CASE WHEN id % 50 = 7 THEN 'feed' END AS prev_hash FROM audit_logs")
view("hashed", ("linked",), f"SELECT *, CASE WHEN id % 97 = 3 THEN 'bad' ELSE {_HASH} END AS entry_hash FROM linked")
view("relevant", ("hashed", "inspections", "extracted_fields"), """SELECT l.*, i.id AS inspection_id FROM hashed l JOIN inspections i ON l.entity_type = 'inspection' AND l.entity_id = i.id
 UNION ALL SELECT l.*, e.inspection_id FROM hashed l JOIN extracted_fields e ON l.entity_type = 'extracted_field' AND l.entity_id = e.id""")
view("chain", ("relevant",), """SELECT *, id % 97 <> 3 AS is_valid_hash,
 NOT coalesce(prev_hash IS NOT NULL AND before_hash IS NOT NULL AND prev_hash <> before_hash, FALSE) AS is_linked
 FROM (SELECT *, lag(entry_hash) OVER (PARTITION BY inspection_id ORDER BY created_at, id) AS before_hash FROM relevant) q""")


@query("e2_audit_entry_hash", with_views("hashed") + "SELECT id, entry_hash FROM hashed WHERE id % 97 <> 3")
def _(f):
    return hashed_logs(f).filter("entry_hash <> 'bad'").select("id", "entry_hash")


@query(
    "e3_canonical_json",
    with_views("audit_logs")
    + """SELECT id, CASE WHEN id % 9 = 4 THEN '' ELSE concat('{"a\\u20b9": "x", ', substr(after_value, 2, length(after_value) - 2), ', "z": 1.5}') END AS canonical FROM audit_logs""",
)
def _(f):
    inner = F.expr("substring(after_value, 2, length(after_value) - 2)")
    foreign = F.concat(F.lit('{"z":1.5,'), inner, F.lit(',"a₹":"x"}'))
    text = F.when(F.col("id") % 9 == 4, F.lit("{}")).otherwise(foreign)
    return f.audit_logs().select("id", E.canonical_json(text).alias("canonical"))


def chain(f):
    return E.verify_audit_chain(E.relevant_logs(hashed_logs(f), f.inspections(), f.extracted_fields()))


@query("e4_verify_audit_chain", with_views("chain") + "SELECT id, inspection_id, is_valid_hash, is_linked FROM chain")
def _(f):
    return chain(f).select("id", "inspection_id", "is_valid_hash", "is_linked")


view("digests", ("inspections", "images", "extracted_fields", "violations"), """SELECT i.id AS inspection_id, sha256(concat('INSPECTION:', CAST(i.id AS VARCHAR), ':RULE_PACK:', i.rule_pack_version,
 ':IMAGES:', coalesce(m.t, ''), ':FIELDS:', coalesce(e.t, ''), ':VIOLATIONS:', coalesce(v.t, ''))) AS evidence_chain_hash FROM inspections i
 LEFT JOIN (SELECT inspection_id, string_agg(concat(image_role, ':', sha256_hash), '|' ORDER BY captured_at, id) AS t FROM images WHERE sha256_hash IS NOT NULL GROUP BY 1) m ON m.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, string_agg(concat(field_type, ':', parsed_value, ':', verdict), '|' ORDER BY field_type, field_seq) AS t FROM extracted_fields GROUP BY 1) e ON e.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, string_agg(concat(rule_id, ':', severity), '|' ORDER BY rule_id, id) AS t FROM violations GROUP BY 1) v ON v.inspection_id = i.id""")


def digests(f):
    return E.case_digest(f.inspections(), f.images(), f.extracted_fields(), f.violations())


@query("e5_case_digest", with_views("digests") + "SELECT * FROM digests")
def _(f):
    return digests(f)


@query(
    "e6_evidence_status",
    with_views("inspections", "integrity", "chain")
    + """SELECT i.id AS inspection_id, coalesce(m.n, 0) AS images_count, coalesce(m.ok, 0) AS images_verified, coalesce(m.bad, 0) AS images_compromised,
 coalesce(c.n, 0) AS audit_events_count, coalesce(c.intact, TRUE) AS audit_chain_intact,
 CASE WHEN m.bad > 0 OR NOT coalesce(c.intact, TRUE) THEN 'COMPROMISED' WHEN m.n IS NULL THEN 'INCOMPLETE' ELSE 'VERIFIED' END AS overall_status
 FROM inspections i LEFT JOIN (SELECT inspection_id, count(*) AS n, count(*) FILTER (WHERE file_integrity = 'verified') AS ok,
  count(*) FILTER (WHERE file_integrity IN ('hash_mismatch', 'file_missing')) AS bad FROM integrity GROUP BY 1) m ON m.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, count(*) AS n, bool_and(is_valid_hash AND is_linked) AS intact FROM chain GROUP BY 1) c ON c.inspection_id = i.id""",
)
def _(f):
    return E.evidence_status(f.inspections(), integrity(f), E.chain_summary(chain(f))).drop("is_tamper_free")


@query("e7_certificates")
def _(f):
    rows = E.certificates(
        f.inspections(), f.users(), integrity(f), chain(f), digests(f), now(), "panelcheck", "production"
    )
    return rows.select(
        "certificate_id", "inspection_id", "evidence_chain_hash", "audit_chain_intact", "statutory_attestation",
        F.to_json("photographic_schedule").alias("schedule"), F.to_json("chain_of_custody_log").alias("custody"),
    )


@query("e7_dockets")
def _(f):
    rows = E.dockets(
        f.inspections(), f.users(), integrity(f), E.chain_summary(chain(f)), digests(f), f.violations(), now()
    )
    return rows.select(
        "docket_id", "inspection_id", "priority", "evidence_chain_hash", "audit_chain_intact",
        F.to_json("photographic_evidence").alias("photos"), F.to_json("violations").alias("violations"),
    )


@query(
    "e8_relevant_logs",
    with_views("relevant") + "SELECT id, inspection_id, entity_type, entity_id FROM relevant",
)
def _(f):
    rows = E.relevant_logs(f.audit_logs(), f.inspections(), f.extracted_fields())
    return rows.select("id", "inspection_id", "entity_type", "entity_id")
