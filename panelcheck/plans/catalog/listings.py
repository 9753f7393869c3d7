"""Catalog: search, listings, batches, self-checks and integrity checks."""

from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.operators import batches as B
from panelcheck.operators import checks as O
from panelcheck.operators import search as S
from panelcheck.operators.rules import primary_image
from panelcheck.plans.catalog.registry import query
from panelcheck.plans.catalog.views import view, with_views

ADMIN, OFFICER = {"id": 1, "role": "supervisor"}, {"id": 3, "role": "officer"}


def _search(name, where, views=("inspections",), **filters):
    @query(name, with_views(*views) + f"SELECT id, officer_id, status, region, created_at FROM inspections i WHERE {where}")
    def _(f):
        rows = S.search_inspections(f.inspections(), f.users(), f.violations(), f.extracted_fields(), **filters)
        return rows.select("id", "officer_id", "status", "region", "created_at")


_search(
    "f1_search_inspections",
    r"NOT is_self_check AND created_at >= TIMESTAMP '1995-01-01' AND created_at <= TIMESTAMP '2001-06-30' AND region ILIKE '%e\_w%' ESCAPE '\'"
    " AND commodity_category = 'general' AND status = 'needs_review'",
    date_from="1995-01-01", date_to="2001-06-30", region="E_w", commodity_category="general", status="needs_review",
)
_search(
    "f2_search_officer_name",
    "NOT is_self_check AND officer_id IN (SELECT id FROM users WHERE full_name ILIKE '%ER#000000003%')",
    ("inspections", "users"), officer_name="er#000000003",
)
_search("f3_has_violations", "NOT is_self_check AND id IN (SELECT inspection_id FROM violations)",
        ("inspections", "violations"), has_violations=True)
_search("f3_has_no_violations", "is_self_check AND id NOT IN (SELECT inspection_id FROM violations)",
        ("inspections", "violations"), has_violations=False, is_self_check=True)
_search(
    "f4_violation_text",
    "NOT is_self_check AND EXISTS (SELECT 1 FROM violations v WHERE v.inspection_id = i.id AND (rule_id ILIKE '%(3%' OR description ILIKE '%(3%' OR citation ILIKE '%(3%'))",
    ("inspections", "violations"), violation_type="(3",
)
_search(
    "f5_product_text",
    "EXISTS (SELECT 1 FROM extracted_fields e WHERE e.inspection_id = i.id AND (raw_text ILIKE '%other foods%' OR parsed_value ILIKE '%other foods%' OR officer_override_value ILIKE '%other foods%'))",
    ("inspections", "extracted_fields"), product_query="OTHER foods", is_self_check=None,
)


@query(
    "f6_page",
    with_views("inspections")
    + """SELECT id, created_at, (SELECT count(*) FROM inspections WHERE NOT is_self_check) AS total FROM inspections
 WHERE NOT is_self_check ORDER BY created_at DESC, id OFFSET 40 LIMIT 20""",
)
def _(f):
    return S.page(S.search_inspections(f.inspections()), 40, 20).select("id", "created_at", "total")


@query(
    "f7_inspection_summaries",
    with_views("inspections", "users", "images", "extracted_fields", "violations", "primary_images")
    + """SELECT i.id, u.full_name AS officer_name, coalesce(v.n, 0) AS violations_count, coalesce(e.n, 0) AS fields_count,
 coalesce(m.n, 0) AS images_count, p.id AS front_image_id, p.storage_url AS thumbnail_url,
 CASE WHEN v.n > 0 THEN 'non_compliant' WHEN i.status = 'needs_review' THEN 'needs_review' ELSE 'compliant' END AS overall_verdict
 FROM inspections i LEFT JOIN users u ON u.id = i.officer_id
 LEFT JOIN (SELECT inspection_id, count(*) AS n FROM violations GROUP BY 1) v ON v.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, count(*) AS n FROM extracted_fields GROUP BY 1) e ON e.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, count(*) AS n FROM images GROUP BY 1) m ON m.inspection_id = i.id
 LEFT JOIN primary_images p ON p.inspection_id = i.id""",
)
def _(f):
    rows = S.inspection_summaries(f.inspections(), f.users(), f.images(), f.extracted_fields(), f.violations())
    return rows.select(
        "id", "officer_name", "violations_count", "fields_count", "images_count", "front_image_id", "thumbnail_url", "overall_verdict"
    )


@query("f8_scope_to_actor", with_views("inspections") + "SELECT id, officer_id FROM inspections WHERE officer_id = 3")
def _(f):
    return S.scope_to_actor(f.inspections(), OFFICER).select("id", "officer_id")


@query(
    "f9_list_self_checks",
    with_views("inspections")
    + """SELECT id, created_at, (SELECT count(*) FROM inspections WHERE is_self_check AND officer_id = 3) AS total FROM inspections
 WHERE is_self_check AND officer_id = 3 ORDER BY created_at DESC, id LIMIT 20""",
)
def _(f):
    return S.list_self_checks(f.inspections(), OFFICER).select("id", "created_at", "total")


@query(
    "f10_audit_trail",
    with_views("inspections", "extracted_fields", "audit_logs")
    + """SELECT id, action, entity_id, created_at FROM audit_logs WHERE entity_id IN (SELECT id FROM inspections WHERE status = 'completed')
 OR entity_id IN (SELECT e.id FROM extracted_fields e JOIN inspections i ON i.id = e.inspection_id WHERE i.status = 'completed')""",
)
def _(f):
    some = f.inspections().filter("status = 'completed'")
    return S.audit_trail(f.audit_logs(), some, f.extracted_fields()).select("id", "action", "entity_id", "created_at")


@query(
    "f11_review_history",
    with_views("inspections", "extracted_fields", "audit_logs", "users")
    + """SELECT o.inspection_id, l.id, l.action, l.entity_type, l.entity_id, coalesce(o.field_type, 'inspection') AS field_type,
 l.actor_user_id AS officer_id, u.full_name AS officer_name, u.role AS officer_role, l.before_value, l.after_value, l.created_at
 FROM audit_logs l JOIN (SELECT id AS entity_id, id AS inspection_id, NULL AS field_type FROM inspections
  UNION ALL SELECT id, inspection_id, field_type FROM extracted_fields) o ON o.entity_id = l.entity_id
 JOIN users u ON u.id = l.actor_user_id""",
)
def _(f):
    return S.review_history(f.audit_logs(), f.users(), f.inspections(), f.extracted_fields())


def reports(f):
    o = F.col("id")
    return f.inspections().filter(F.col("status") == "completed").select(
        (o * 2).alias("id"), o.alias("inspection_id"), F.when(o % 3 == 0, "editable").otherwise("pdf").alias("format"),
        F.concat(F.lit("local://reports/"), o.cast("string")).alias("storage_url"),
        F.col("officer_id").alias("generated_by"), F.col("created_at").alias("generated_at"),
    )


view("reports", ("inspections",), """SELECT id * 2 AS id, id AS inspection_id, CASE WHEN id % 3 = 0 THEN 'editable' ELSE 'pdf' END AS format,
 concat('local://reports/', CAST(id AS VARCHAR)) AS storage_url, officer_id AS generated_by, created_at AS generated_at
 FROM inspections WHERE status = 'completed'""")


@query("f13_list_reports", with_views("reports") + "SELECT * FROM reports")
def _(f):
    return S.list_reports(reports(f))


@query("f14_primary_image", with_views("primary_images") + "SELECT inspection_id, id, image_role FROM primary_images")
def _(f):
    return primary_image(f.images().select("inspection_id", "id", "image_role"))


@query(
    "f15_inspection_documents",
    with_views("inspections", "images", "extracted_fields", "violations")
    + """SELECT i.id, i.status, m.t AS image_list, e.t AS field_list, v.t AS violation_list FROM inspections i
 LEFT JOIN (SELECT inspection_id, string_agg(concat(id, ':', image_role), ',' ORDER BY id) AS t FROM images GROUP BY 1) m ON m.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, string_agg(concat(id, ':', field_type), ',' ORDER BY field_seq) AS t FROM extracted_fields GROUP BY 1) e ON e.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, string_agg(concat(id, ':', rule_id), ',' ORDER BY id) AS t FROM violations GROUP BY 1) v ON v.inspection_id = i.id""",
)
def _(f):
    docs = S.inspection_documents(f.inspections(), f.images(), f.extracted_fields(), f.violations())
    text = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x[k])), ",")
    return docs.select(
        "id", "status", text("images", "image_role").alias("image_list"), text("fields", "field_type").alias("field_list"),
        text("violations", "rule_id").alias("violation_list"),
    )


@query(
    "f16_queued_summaries",
    with_views("inspections", "images", "primary_images")
    + """SELECT i.id, i.status, i.commodity_category, i.created_at, coalesce(m.n, 0) AS images_count, p.id AS front_image_id,
 'needs_review' AS overall_verdict FROM inspections i
 LEFT JOIN (SELECT inspection_id, count(*) AS n FROM images GROUP BY 1) m ON m.inspection_id = i.id
 LEFT JOIN primary_images p ON p.inspection_id = i.id
 WHERE i.status = 'sync_pending' AND (contains(CAST(i.id AS VARCHAR), 'food') OR contains(i.commodity_category, 'food'))""",
)
def _(f):
    return S.queued_summaries(f.inspections(), f.images(), "Food")


# ------------------------------------------------------------------ batches


def batch_sessions(f):
    c = F.col("c_custkey")
    return f.base("customer").select(
        c.alias("id"), (c % 10).alias("officer_id"), F.col("c_name").alias("session_name"),
        F.when(c % 3 == 0, "completed").when(c % 7 == 1, "archived").otherwise("active").alias("status"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )


view("batches", (), """SELECT c_custkey AS id, c_custkey % 10 AS officer_id, c_name AS session_name,
 CASE WHEN c_custkey % 3 = 0 THEN 'completed' WHEN c_custkey % 7 = 1 THEN 'archived' ELSE 'active' END AS status FROM customer""")
_B1 = """SELECT b.id, b.officer_id, b.status, coalesce(t.total, 0) AS total_skus, coalesce(t.good, 0) AS compliant_count,
 coalesce(t.bad, 0) AS non_compliant_count, coalesce(t.total - t.good - t.bad, 0) AS pending_count, coalesce(t.v, 0) AS total_violations,
 CASE WHEN t.total > 0 THEN round(t.good / t.total * 100.0e0, 1) ELSE 0.0e0 END AS compliance_rate_pct
 FROM batches b LEFT JOIN (SELECT batch_id, count(*) AS total, CAST(coalesce(sum(n), 0) AS BIGINT) AS v,
  count(*) FILTER (WHERE status = 'completed' AND n IS NULL) AS good,
  count(*) FILTER (WHERE status = 'needs_review' OR (status = 'completed' AND n > 0)) AS bad
  FROM inspections i LEFT JOIN vcount v ON v.inspection_id = i.id GROUP BY 1) t ON t.batch_id = b.id"""


@query("b1_batch_metrics", with_views("batches", "inspections", "vcount") + _B1)
def _(f):
    return B.batch_metrics(batch_sessions(f), f.inspections(), f.violations()).drop("session_name", "completed_at")


@query("b1_list_batches", with_views("batches", "inspections", "vcount")
       + f"SELECT id, total_skus FROM ({_B1}) x WHERE officer_id = 3 AND status = 'active'")
def _(f):
    rows = B.batch_metrics(batch_sessions(f), f.inspections(), f.violations())
    return B.list_batches(rows, OFFICER, "active").select("id", "total_skus")


view("last_fields", ("extracted_fields",), """SELECT inspection_id,
 arg_max(coalesce(nullif(parsed_value, ''), raw_text), field_seq) FILTER (WHERE field_type = 'mrp') AS mrp,
 arg_max(coalesce(nullif(parsed_value, ''), raw_text), field_seq) FILTER (WHERE field_type = 'net_quantity') AS net_quantity,
 arg_max(coalesce(nullif(parsed_value, ''), raw_text), field_seq) FILTER (WHERE field_type = 'commodity_name') AS commodity_name,
 arg_max(coalesce(nullif(parsed_value, ''), raw_text), field_seq) FILTER (WHERE field_type = 'manufacturer_address') AS manufacturer
 FROM extracted_fields GROUP BY 1""")
_B2 = """SELECT i.batch_id, i.id AS inspection_id, i.status, i.created_at, coalesce(v.n, 0) AS violations_count,
 v.n IS NULL AND i.status = 'completed' AS is_compliant, l.mrp, l.net_quantity, l.commodity_name, l.manufacturer
 FROM inspections i LEFT JOIN vcount v ON v.inspection_id = i.id LEFT JOIN last_fields l ON l.inspection_id = i.id
 WHERE i.batch_id IS NOT NULL"""


@query("b2_batch_items", with_views("inspections", "vcount", "last_fields") + _B2)
def _(f):
    return B.batch_items(f.inspections(), f.extracted_fields(), f.violations()).drop("commodity_category")


@query(
    "b3_batch_manifest",
    with_views("inspections", "vcount", "last_fields", "violations")
    + f"""SELECT x.*, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, inspection_id) AS item_seq, d.t AS violation_list
 FROM ({_B2}) x LEFT JOIN (SELECT inspection_id AS iid, string_agg(concat(rule_id, '/', severity), ',' ORDER BY id) AS t
  FROM violations GROUP BY 1) d ON d.iid = x.inspection_id""",
)
def _(f):
    rows = B.batch_manifest(f.inspections(), f.extracted_fields(), f.violations()).drop("commodity_category")
    listed = F.array_join(F.transform("violations", lambda v: F.concat(v["rule_id"], F.lit("/"), v["severity"])), ",")
    return rows.withColumn("violation_list", listed).drop("violations")


@query(
    "b3_violations_by_rule",
    with_views("inspections", "violations")
    + """SELECT i.batch_id, v.rule_id, count(*) AS violations FROM violations v JOIN inspections i ON i.id = v.inspection_id
 WHERE i.batch_id IS NOT NULL GROUP BY 1, 2""",
)
def _(f):
    return B.batch_violations_by_rule(f.inspections(), f.violations())


@query(
    "b4_complete_batches",
    with_views("batches")
    + """SELECT id, CASE WHEN id % 4 = 0 THEN 'completed' ELSE status END AS status,
 CASE WHEN id % 4 = 0 THEN TIMESTAMP '2026-03-01 10:00:00' END AS completed_at FROM batches""",
)
def _(f):
    rows = batch_sessions(f)
    done = B.complete_batches(rows, rows.filter("id % 4 = 0"), F.lit("2026-03-01 10:00:00").cast("timestamp"))
    return done.select("id", "status", "completed_at")


@query(
    "b4_reject_inactive",
    with_views("batches", "inspections")
    + """SELECT i.id, i.batch_id, CASE WHEN b.id IS NULL THEN 'batch_not_found' ELSE 'batch_not_active' END AS reason
 FROM inspections i LEFT JOIN batches b ON b.id = i.batch_id WHERE i.batch_id IS NOT NULL AND (b.id IS NULL OR b.status <> 'active')""",
)
def _(f):
    skus = f.inspections().filter("batch_id IS NOT NULL").select("id", "batch_id")
    return B.reject_inactive(skus, batch_sessions(f)).select("id", "batch_id", "reason")


_C1 = """SELECT i.id AS inspection_id, coalesce(i.commodity_category, 'general') AS commodity_category, i.status,
 CASE WHEN c > 0 THEN 'CRITICAL_DEFICIENCIES' WHEN n > 0 THEN 'ACTION_REQUIRED' ELSE 'MARKET_READY' END AS overall_readiness,
 total AS total_declarations, greatest(0, total - n) AS compliant_count, n AS violation_count,
 CASE WHEN total > 0 THEN round(greatest(0, total - n) / total * 100.0e0, 1) WHEN n = 0 THEN 100.0e0 ELSE 0.0e0 END AS readiness_percentage
 FROM (SELECT i.*, (SELECT count(*) FROM violations v WHERE v.inspection_id = i.id) AS n,
  (SELECT count(*) FROM violations v WHERE v.inspection_id = i.id AND severity = 'critical') AS c,
  (SELECT count(*) FROM extracted_fields e WHERE e.inspection_id = i.id) AS total FROM inspections i WHERE is_self_check) i"""


@query("c1_self_check_scorecards", with_views("inspections", "violations", "extracted_fields") + _C1)
def _(f):
    return B.self_check_scorecards(f.inspections(), f.extracted_fields(), f.violations()).drop("created_at")


@query(
    "c2_remediations",
    with_views("inspections", "violations", "extracted_fields")
    + f"""SELECT v.inspection_id, v.id AS violation_id, v.rule_id, v.severity, e.field_type AS field_name,
 concat('{V.REMEDY_OTHER[0]}', v.citation, '{V.REMEDY_OTHER[1]}') AS remedial_action
 FROM violations v JOIN inspections i ON i.id = v.inspection_id AND i.is_self_check
 LEFT JOIN extracted_fields e ON e.id = v.extracted_field_id AND e.inspection_id = v.inspection_id""",
)
def _(f):
    rows = B.remediations(f.inspections(), f.extracted_fields(), f.violations())
    return rows.select("inspection_id", "violation_id", "rule_id", "severity", "field_name", "remedial_action")


@query(
    "c2_remedial_texts",
    with_views("core_rules")
    + "SELECT i.o_orderkey AS id, r.rule_id, CASE "
    + " ".join(
        "WHEN " + " OR ".join([f"contains(r.rule_id, '{w}')" for w in a] + [f"contains(r.rule_id, '{w}')" for w in b])
        + " THEN '" + t.replace("'", "''") + "'"
        for a, b, t in V.REMEDIES
    )
    + f" ELSE concat('{V.REMEDY_OTHER[0]}', r.citation, '{V.REMEDY_OTHER[1]}') END AS remedial_action"
    + " FROM orders i JOIN core_rules r ON r.rule_seq = i.o_orderkey % 12",
)
def _(f):
    rules = F.array(*[F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["citation"]).alias("citation")) for r in V.CORE_RULES])
    rows = f.inspections().select("id", F.element_at(rules, (F.col("id") % 12).cast("int") + 1).alias("r"))
    return rows.select(
        "id", "r.rule_id", B.remedial_action(F.col("r.rule_id"), F.col("r.rule_id"), F.col("r.citation")).alias("remedial_action")
    )


@query(
    "c3_self_check_summary",
    with_views("inspections", "vcount")
    + """SELECT count(*) AS total_self_checks, count(*) FILTER (WHERE n IS NULL) AS market_ready_count, count(n) AS action_required_count,
 round(count(*) FILTER (WHERE n IS NULL) / count(*) * 100.0e0, 1) AS first_pass_rate
 FROM inspections i LEFT JOIN vcount v ON v.inspection_id = i.id WHERE is_self_check""",
)
def _(f):
    return B.self_check_summary(f.inspections(), f.violations())


@query(
    "c3_common_deficiencies",
    with_views("inspections", "violations")
    + """SELECT rule_id, arg_min(citation, v.id) AS citation, arg_min(description, v.id) AS description, count(*) AS count
 FROM violations v JOIN inspections i ON i.id = v.inspection_id AND i.is_self_check GROUP BY 1 ORDER BY count DESC, rule_id LIMIT 5""",
)
def _(f):
    return B.common_deficiencies(f.inspections(), f.violations())


# ------------------------------------------------------------------ integrity checks


@query(
    "o1_orphans",
    with_views("inspections", "users", "images", "extracted_fields", "violations", "audit_logs")
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS child, '{k}' AS \"column\", id AS row_id, {k} AS missing FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT id FROM {p})"
        for c, k, p in O.FOREIGN_KEYS
    )
    + ") q",
)
def _(f):
    names = ("inspections", "users", "images", "extracted_fields", "violations", "audit_logs")
    return O.orphans({n: getattr(f, n)() for n in names})


@query(
    "o2_domain_violations",
    with_views("inspections", "images")
    + """SELECT 'inspections' AS "table", 'status' AS "column", status AS value, count(*) AS rows FROM inspections
 WHERE status NOT IN ('completed', 'needs_review') GROUP BY status
 UNION ALL SELECT 'images', 'image_role', image_role, count(*) FROM images WHERE image_role NOT IN ('front_pdp', 'sticker') GROUP BY image_role""",
)
def _(f):
    lists = [("inspections", "status", ["completed", "needs_review"]), ("images", "image_role", ["front_pdp", "sticker"])]
    return O.domain_violations({"inspections": f.inspections(), "images": f.images()}, lists)


@query(
    "o3_duplicate_keys",
    with_views("inspections", "users", "images")
    + """SELECT 'users' AS "table", email AS key, count(*) AS rows FROM users GROUP BY email HAVING count(*) > 1
 UNION ALL SELECT 'inspections', concat(officer_id, '|', client_id), count(*) FROM inspections GROUP BY officer_id, client_id HAVING count(*) > 1
 UNION ALL SELECT 'images', client_id, count(*) FROM images GROUP BY client_id HAVING count(*) > 1""",
)
def _(f):
    return O.duplicate_keys(
        {
            "users": (f.users(), ["email"]),
            "inspections": (f.inspections(), ["officer_id", "client_id"]),
            "images": (f.images(), ["client_id"]),
        }
    )


@query(
    "o4_audit_mutations",
    with_views("audit_logs")
    + """SELECT id, CASE WHEN id % 31 = 5 THEN 'removed' ELSE 'changed' END AS mutation FROM audit_logs WHERE id % 31 = 5 OR id % 37 = 9""",
)
def _(f):
    old = f.audit_logs()
    new = old.filter("id % 31 <> 5").withColumn(
        "action", F.when(F.col("id") % 37 == 9, "edited").otherwise(F.col("action"))
    )
    return O.audit_mutations(old, new)
