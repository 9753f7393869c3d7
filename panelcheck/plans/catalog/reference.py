"""Catalog: reference data and capture quality."""

from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.operators import quality as K
from panelcheck.operators import reference as L
from panelcheck.plans.catalog.registry import query
from panelcheck.plans.catalog.views import view, with_views


def _q(t):
    return "'" + t.replace("'", "''") + "'"


@query(
    "l1_with_category",
    with_views("inspections")
    + "SELECT id, c.name AS category_name, c.flag AS first_flag FROM inspections LEFT JOIN (VALUES "
    + ", ".join(f"({_q(c)}, {_q(n)}, {_q(fl[0])})" for c, n, fl in V.CATEGORIES)
    + ") c(cid, name, flag) ON c.cid = commodity_category",
)
def _(f):
    return L.with_category(f.inspections()).select("id", "category_name", F.col("category_flags")[0].alias("first_flag"))


def registry(f):
    s = F.col("s_suppkey")
    return f.base("supplier").select(
        s.alias("registry_seq"), F.concat(F.lit("REG-"), s.cast("string")).alias("registration_number"), F.col("s_name").alias("entity_name"),
        F.when(s % 5 == 0, "EXPIRED").when(s % 7 == 3, "CANCELLED").otherwise("ACTIVE").alias("status"),
    )


def requests(f):
    c = F.col("c_custkey")
    return f.base("customer").select(
        c.alias("request_id"),
        F.concat(F.lit(" reg-"), (c * 3).cast("string"), F.lit(" ")).alias("registration_number"),
        F.when(c % 4 == 0, F.lit(None)).when(c % 4 == 1, F.concat(F.lit("ER#0"), F.lpad((c % 1000).cast("string"), 8, "0")))
        .when(c % 4 == 2, F.concat(F.lit(" "), (c % 100).cast("string"))).otherwise("no such name").alias("company_name"),
    )


view("registry", (), """SELECT s_suppkey AS seq, concat('REG-', s_suppkey) AS num, s_name AS name,
 CASE WHEN s_suppkey % 5 = 0 THEN 'EXPIRED' WHEN s_suppkey % 7 = 3 THEN 'CANCELLED' ELSE 'ACTIVE' END AS status FROM supplier""")
view("regreq", (), """SELECT c_custkey AS request_id, concat('REG-', c_custkey * 3) AS num,
 CASE c_custkey % 4 WHEN 1 THEN concat('er#0', lpad(CAST(c_custkey % 1000 AS VARCHAR), 8, '0')) WHEN 2 THEN CAST(c_custkey % 100 AS VARCHAR)
 WHEN 3 THEN 'no such name' END AS name FROM customer""")


@query(
    "l2_verify_registrations",
    with_views("registry", "regreq")
    + """SELECT request_id, coalesce(b.num, q.num) AS registration_number, coalesce(a.status, b.status, 'NOT_FOUND') AS status,
 coalesce(a.name, b.name) AS entity_name, coalesce(a.status, b.status, 'NOT_FOUND') IN ('ACTIVE', 'EXPIRED', 'SUSPENDED') AS is_registered
 FROM regreq q LEFT JOIN registry a ON a.num = q.num LEFT JOIN registry b ON a.num IS NULL AND b.seq =
 (SELECT min(seq) FROM registry r WHERE q.name IS NOT NULL AND contains(lower(r.name), q.name))""",
)
def _(f):
    return L.verify_registrations(requests(f), registry(f))


def translate_sql(col, lang):
    i = V.TERM_LANGUAGES.index(lang)
    low = f"lower(trim({col}))"
    cases = [
        f"WHEN contains({low}, 'exceeds') AND contains({low}, 'mrp') THEN {_q(V.PHRASES['mrp_inflation'][i])}",
        f"WHEN contains({low}, 'quantity') AND (contains({low}, 'mismatch') OR contains({low}, 'conflict')) THEN {_q(V.PHRASES['net_quantity_mismatch'][i])}",
    ]
    cases += [
        f"WHEN contains({low}, '{k}') OR contains({low}, '{k.replace('_', ' ')}') THEN {_q(w[i])}" for k, w in V.TERMS.items()
    ]
    cases += [f"WHEN {low} = '{c}' THEN {_q(n[lang])}" for c, n in V.COUNTRIES.items()]
    return "CASE " + " ".join(cases) + f" ELSE trim({col}) END"


@query(
    "l3_translate_fields",
    with_views("extracted_fields")
    + "SELECT inspection_id, id AS field_id, CASE field_type "
    + " ".join(f"WHEN '{k}' THEN {_q(w[0])}" for k, w in V.TERMS.items())
    + " WHEN 'mfg_date' THEN 'Mfg Date' WHEN 'commodity_name' THEN 'Commodity Name' END AS label, parsed_value AS original_value, "
    + translate_sql("parsed_value", "hi") + " AS translated_value FROM extracted_fields",
)
def _(f):
    return L.translate_fields(f.extracted_fields(), "hi").drop("field_type")


@query(
    "l3_translate_violations",
    with_views("violations")
    + f"""SELECT id AS violation_id, {translate_sql("concat(CASE id % 4 WHEN 0 THEN 'price exceeds MRP ' WHEN 1 THEN 'Net quantity mismatch ' WHEN 2 THEN 'consumer care missing ' ELSE '' END, description)", "ta")} AS translated_description FROM violations""",
)
def _(f):
    k = F.col("id") % 4
    start = F.when(k == 0, "price exceeds MRP ").when(k == 1, "Net quantity mismatch ").when(k == 2, "consumer care missing ").otherwise("")
    rows = f.violations().withColumn("description", F.concat(start, "description"))
    return L.translate_violations(rows, "ta").select("violation_id", "translated_description")


@query("l4_narration")
def _(f):
    return L.narration(f.inspections(), f.extracted_fields(), f.violations(), "hi")


@query(
    "l4_narration_other",
    with_views("inspections", "extracted_fields", "violations")
    + f"""SELECT i.id AS inspection_id, concat('Inspection results in Tamil: ', coalesce(e.n, 0), ' declarations checked, ', coalesce(v.n, 0),
 ' violations found. Status: ', CASE WHEN v.n IS NULL THEN {_q(V.PHRASES['pass'][4])} ELSE {_q(V.PHRASES['violation_detected'][4])} END, '.') AS summary_narration
 FROM inspections i LEFT JOIN (SELECT inspection_id, count(*) AS n FROM extracted_fields GROUP BY 1) e ON e.inspection_id = i.id
 LEFT JOIN (SELECT inspection_id, count(*) AS n FROM violations GROUP BY 1) v ON v.inspection_id = i.id""",
)
def _(f):
    return L.narration(f.inspections(), f.extracted_fields(), f.violations(), "ta")


@query(
    "l5_idempotent_create",
    with_views("inspections")
    + """SELECT q.id AS request_seq, CASE WHEN made THEN 'created' ELSE 'reused' END AS outcome,
 CASE WHEN made THEN q.id ELSE coalesce(x, w) END AS inspection_id,
 CASE WHEN made THEN CASE WHEN captured_offline THEN 'sync_pending' ELSE 'draft' END END AS status,
 CASE WHEN made THEN '2026.02.01' END AS rule_pack_version
 FROM (SELECT r.*, x.id AS x, w, x.id IS NULL AND (w IS NULL OR w = r.id) AS made
  FROM (SELECT id, officer_id, captured_offline, CASE WHEN id % 13 <> 0 THEN client_id END AS client_id FROM inspections WHERE id % 4 <> 0) r
  LEFT JOIN (SELECT officer_id, client_id, min(id) AS w FROM inspections WHERE id % 4 <> 0 AND id % 13 <> 0 GROUP BY 1, 2) m
   ON m.officer_id = r.officer_id AND m.client_id = r.client_id
  LEFT JOIN (SELECT officer_id, client_id, min(id) AS id FROM inspections WHERE id % 4 = 0 GROUP BY 1, 2) x
   ON x.officer_id = r.officer_id AND x.client_id = r.client_id) q""",
)
def _(f):
    from panelcheck.sources.rulepacks import active_pack

    rows = f.inspections()
    new = rows.filter("id % 4 <> 0").select(
        F.col("id").alias("request_seq"), "officer_id", "captured_offline", F.when(F.col("id") % 13 != 0, F.col("client_id")).alias("client_id")
    )
    version = active_pack(f.rule_packs(), f.rule_packs()).select("version").scalar()
    made = L.idempotent_create(new, rows.filter("id % 4 = 0"), version)
    return made.select("request_seq", "outcome", "inspection_id", "status", "rule_pack_version")


@query(
    "l6_normalize_path",
    """SELECT page_id, p AS path, regexp_replace(regexp_replace(regexp_replace(p, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '{id}', 'g'),
 '(?:insp|img|batch|rule)_[0-9a-zA-Z_\\-]+', '{id}', 'g'), '/\\d+(/|$)', '/{id}\\1', 'g') AS normal
 FROM (SELECT page_id, concat('/inspections/', page_id, '/images/img_', page_id % 7, '/f47ac10b-58cc-4372-a567-0e02b2c3d479/', page_id % 5) AS p FROM pages) q""".replace("\\\\", "\\"),
)
def _(f):
    p = F.col("page_id")
    path = F.concat(
        F.lit("/inspections/"), p.cast("string"), F.lit("/images/img_"), (p % 7).cast("string"),
        F.lit("/f47ac10b-58cc-4372-a567-0e02b2c3d479/"), (p % 5).cast("string"),
    )
    return f.base("pages").select("page_id", path.alias("path"), L.normalize_path(path).alias("normal"))


# ------------------------------------------------------------------ quality and calibration


def metrics(f):
    k = F.col("l_partkey")
    return f.base("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id"),
        (F.col("l_quantity") * 6).alias("blur_variance"), ((k * 7) % 200 + 5).alias("brightness"),
        (F.col("l_discount") * 1.5).alias("glare_ratio"), (400 + (k * 37) % 1600).alias("width_px"),
        (300 + (F.col("l_orderkey") * 53) % 1900).alias("height_px"), (F.col("l_tax") * 8).alias("occlusion_ratio"),
    )


view("metrics", (), """SELECT *, width_px / greatest(1, height_px) AS aspect FROM (SELECT l_orderkey * 10 + l_linenumber AS image_id, l_quantity * 6 AS blur_variance,
 (l_partkey * 7) % 200 + 5 AS brightness, l_discount * 1.5e0 AS glare_ratio, 400 + (l_partkey * 37) % 1600 AS width_px,
 300 + (l_orderkey * 53) % 1900 AS height_px, l_tax * 8 AS occlusion_ratio FROM lineitem) m""")
_HITS = [
    ("blur", "blur_variance < 120", "error", "blur"),
    ("too_dark", "brightness < 42", "error", "too_dark"),
    ("glare", "glare_ratio > 0.08e0", "warning", "glare"),
    ("low_resolution", "(width_px < 600 OR height_px < 600)", "error", "low_resolution"),
    ("perspective", "(aspect > 3.0e0 OR aspect < 1 / 3.0e0)", "warning", "aspect"),
    ("perspective", "(occlusion_ratio > 0.40e0 AND blur_variance >= 120)", "warning", "occlusion"),
]


@query(
    "k1_quality_issues",
    with_views("metrics")
    + " UNION ALL ".join(
        f"SELECT image_id, {i} AS issue_seq, '{t}' AS type, '{s}' AS severity, {_q(V.QUALITY_TITLES[n])} AS title FROM metrics WHERE {c}"
        for i, (t, c, s, n) in enumerate(_HITS, 1)
    ),
)
def _(f):
    return K.quality_issues(metrics(f))


_FAILED = " OR ".join(c for _, c, s, _n in _HITS if s == "error")


@query(
    "k2_quality_scores",
    with_views("metrics")
    + f"""SELECT image_id, NOT ({_FAILED}) AS passed, greatest(10, 100 - CASE WHEN blur_variance < 120 THEN 40 ELSE 0 END
 - CASE WHEN brightness < 42 THEN 30 ELSE 0 END - CASE WHEN glare_ratio > 0.08e0 THEN 20 ELSE 0 END - CASE WHEN width_px < 600 THEN 25 ELSE 0 END
 - CASE WHEN {_HITS[4][1]} THEN 15 ELSE 0 END - CASE WHEN {_HITS[5][1]} THEN 15 ELSE 0 END) AS score,
 CASE WHEN {_FAILED} THEN CASE {" ".join(f"WHEN {c} THEN {_q(V.QUALITY_TITLES[n])}" for _, c, _s, n in _HITS)} END
 WHEN {" OR ".join(h[1] for h in _HITS)} THEN 'ACCEPTABLE (WITH WARNINGS)' ELSE 'QUALITY CHECK PASSED' END AS status_text FROM metrics""",
)
def _(f):
    return K.quality_scores(metrics(f))


_KINDS = ["EAN-13", "ean8", "UPC-A", "upce", "CODE128", "QR"]


@query(
    "k3_derive_scale",
    "SELECT p_partkey AS image_id, TRUE AS is_calibrated, round(mm / w, 5) AS scale_mm_per_px, mm AS nominal_width_mm, "
    "concat('barcode_', replace(lower(kind), '-', '')) AS method FROM (SELECT p_partkey, 40 + p_size * 3 AS w, CASE p_partkey % 6 "
    + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END AS kind, CASE p_partkey % 6 "
    + " ".join(f"WHEN {i} THEN {V.BARCODE_WIDTHS_MM.get(k.upper(), V.BARCODE_DEFAULT_MM)}e0" for i, k in enumerate(_KINDS))
    + """ END AS mm FROM part WHERE p_partkey % 7 <> 0) q
 UNION ALL SELECT p_partkey, FALSE, NULL, NULL, 'uncalibrated_pdp_ratio' FROM part WHERE p_partkey % 7 = 0""",
)
def _(f):
    p = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (p % 6).cast("int") + 1)
    rows = f.base("part").select(
        p.alias("image_id"), F.when(p % 7 != 0, kind).alias("barcode_type"), (40 + F.col("p_size") * 3).alias("barcode_width_px")
    )
    return K.derive_scale(rows)


@query(
    "k4_measure_dimensions",
    with_views("extracted_fields", "images")
    + """SELECT f.id AS element_id, CASE WHEN s IS NOT NULL THEN round(box_h * s, 2) END AS height_mm,
 CASE WHEN coalesce(i.height_px, 0) > 0 THEN round(box_h / i.height_px, 4) END AS pdp_height_ratio, s IS NOT NULL AS is_calibrated
 FROM extracted_fields f JOIN (SELECT *, calibration_scale_mm_per_px AS s FROM images) i ON i.id = f.source_image_id""",
)
def _(f):
    images = f.images().select(
        F.col("id").alias("source_image_id"), F.coalesce("height_px", F.lit(0)).alias("panel_height_px"),
        F.col("calibration_scale_mm_per_px").alias("scale_mm_per_px"),
    )
    rows = f.extracted_fields().join(images, "source_image_id").select(
        F.col("id").alias("element_id"), F.col("box_h").alias("height_px"), "panel_height_px", "scale_mm_per_px"
    )
    return K.measure_dimensions(rows).drop("warning")


@query(
    "k5_valid_gtin",
    """SELECT o_orderkey AS id, code, CASE WHEN length(d) IN (8, 12, 13, 14) THEN (10 - list_sum(list_transform(range(1, length(d)),
 lambda i: CAST(substr(d, length(d) - i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(right(d, 1) AS INT) ELSE FALSE END AS is_valid
 FROM (SELECT o_orderkey, concat(left(c, 3), '-', substr(c, 4)) AS code, c AS d FROM (SELECT o_orderkey,
  left(concat(CAST(o_custkey * 7919 + o_orderkey * 104729 + 10000000 AS VARCHAR), '4006381333931'), CAST(CASE o_orderkey % 5 WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 13 WHEN 3 THEN 14 ELSE 10 END AS INT)) AS c FROM orders) a) b""",
)
def _(f):
    o = F.col("o_orderkey")
    long = F.concat((F.col("o_custkey") * 7919 + o * 104729 + 10000000).cast("string"), F.lit("4006381333931"))
    n = F.when(o % 5 == 0, 8).when(o % 5 == 1, 12).when(o % 5 == 2, 13).when(o % 5 == 3, 14).otherwise(10)
    c = F.substring(long, F.lit(1), n)
    code = F.concat(F.substring(c, F.lit(1), F.lit(3)), F.lit("-"), F.substring(c, F.lit(4), F.lit(20)))
    return f.base("orders").select(o.alias("id"), code.alias("code"), K.valid_gtin(code).alias("is_valid"))


@query(
    "k6_device_evidence_status",
    with_views("images")
    + """SELECT inspection_id, CASE WHEN inspection_id % 10 = 0 THEN 'unavailable' WHEN bool_or(id % 8 = 3 OR id % 9 = 4) THEN 'partial' ELSE 'ready' END AS status
 FROM images GROUP BY 1""",
)
def _(f):
    i = F.col("id")
    off = F.col("inspection_id") % 10 == 0
    rows = f.images().select(
        "inspection_id", (~off).alias("ocr_enabled"), (~off).alias("barcode_enabled"),
        F.when(i % 8 == 3, "ocr").alias("ocr_error"), F.when(i % 9 == 4, "barcode").alias("barcode_error"),
    )
    return K.device_evidence_status(rows)
