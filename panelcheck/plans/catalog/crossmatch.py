"""Catalog: cross-panel matching."""

from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.operators import crossmatch as M
from panelcheck.operators import rules as R
from panelcheck.plans.catalog.registry import query
from panelcheck.plans.catalog.rules import results
from panelcheck.plans.catalog.views import view, with_views
from panelcheck.sources.files import written_parquet

view("occ", ("extracted_fields", "images"), r"""SELECT f.*, coalesce(i.image_role, 'unknown') AS image_role,
 TRY_CAST(nullif(regexp_extract(f.parsed_value, '([0-9]+(?:\.[0-9]{1,2})?)', 1), '') AS DOUBLE) AS price,
 lower(trim(coalesce(f.parsed_value, 'None'))) AS txt
 FROM extracted_fields f LEFT JOIN images i ON i.id = f.source_image_id""")
view("grp", ("occ",), "SELECT inspection_id, field_type FROM occ GROUP BY 1, 2 HAVING count(DISTINCT source_image_id) >= 2")
view("cocc", ("occ", "grp"), "SELECT o.* FROM occ o JOIN grp g USING (inspection_id, field_type)")
view("physical_first", ("cocc",), """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id, field_type ORDER BY field_seq) AS rn
 FROM cocc WHERE image_role <> 'ecommerce_listing' AND (field_type <> 'mrp' OR (image_role <> 'sticker' AND price IS NOT NULL))) q""")

_PAIR = "SELECT a.inspection_id, a.field_type, {kind} AS discrepancy_type, a.id AS first_field_id, b.id AS second_field_id FROM {l} a JOIN {r} b ON a.inspection_id = b.inspection_id AND a.field_type = b.field_type WHERE {where}"
_LISTING = "a.image_role = 'ecommerce_listing' AND b.image_role <> 'ecommerce_listing' AND a.txt <> '' AND b.txt <> ''"

PAIRS = {
    "m3_mrp_sticker": _PAIR.format(
        l="cocc", r="cocc", kind="CASE WHEN a.price > b.price THEN 'mrp_altered_sticker' ELSE 'mrp_sticker_mismatch' END",
        where="a.field_type = 'mrp' AND a.image_role = 'sticker' AND b.image_role <> 'sticker' AND a.price <> b.price"),
    "m4_mrp_panels": _PAIR.format(
        l="physical_first", r="physical_first", kind="'mrp_panel_conflict'",
        where="a.field_type = 'mrp' AND a.rn = 1 AND b.rn > 1 AND abs(a.price - b.price) > 0.01e0"),
    "m5_mrp_listing": _PAIR.format(
        l="cocc", r="cocc", kind="CASE WHEN a.price > b.price THEN 'ecommerce_mrp_inflation' ELSE 'ecommerce_mrp_mismatch' END",
        where="a.field_type = 'mrp' AND a.image_role = 'ecommerce_listing' AND b.image_role NOT IN ('ecommerce_listing', 'sticker')"
              " AND (a.price > b.price OR abs(a.price - b.price) > 0.01e0)"),
    "m6_net_quantity": _PAIR.format(
        l="cocc", r="cocc", kind="'ecommerce_net_quantity_mismatch'", where=f"a.field_type = 'net_quantity' AND {_LISTING} AND a.txt <> b.txt")
    + " UNION ALL " + _PAIR.format(
        l="physical_first", r="physical_first", kind="'net_quantity_mismatch'",
        where="a.field_type = 'net_quantity' AND a.rn = 1 AND b.rn > 1 AND a.txt <> b.txt AND a.txt <> '' AND b.txt <> ''"),
    "m7_dates": _PAIR.format(
        l="cocc", r="cocc", kind="'ecommerce_date_mismatch'",
        where=f"a.field_type IN ('mfg_date', 'expiry_date') AND {_LISTING} AND a.txt <> b.txt")
    + " UNION ALL " + _PAIR.format(
        l="physical_first", r="physical_first", kind="'date_mismatch'",
        where="a.field_type IN ('mfg_date', 'expiry_date') AND a.rn = 1 AND b.rn > 1 AND a.txt <> b.txt AND a.txt <> '' AND b.txt <> ''"),
    "m8_country": _PAIR.format(
        l="cocc", r="cocc", kind="'ecommerce_origin_mismatch'",
        where=f"a.field_type = 'country_of_origin' AND {_LISTING} AND a.txt <> b.txt")
    + " UNION ALL " + _PAIR.format(
        l="physical_first", r="physical_first", kind="'country_mismatch'",
        where="a.field_type = 'country_of_origin' AND a.rn = 1 AND b.rn > 1 AND a.txt <> b.txt AND a.txt <> '' AND b.txt <> ''"),
    "m9_manufacturer": _PAIR.format(
        l="cocc", r="cocc", kind="'ecommerce_manufacturer_mismatch'",
        where=f"a.field_type IN ('manufacturer_address', 'importer_packer') AND {_LISTING} AND NOT contains(a.txt, b.txt) AND NOT contains(b.txt, a.txt)"),
}
KINDS = {
    "m3_mrp_sticker": ("mrp_altered_sticker", "mrp_sticker_mismatch"),
    "m4_mrp_panels": ("mrp_panel_conflict",),
    "m5_mrp_listing": ("ecommerce_mrp_inflation", "ecommerce_mrp_mismatch"),
    "m6_net_quantity": ("ecommerce_net_quantity_mismatch", "net_quantity_mismatch"),
    "m7_dates": ("ecommerce_date_mismatch", "date_mismatch"),
    "m8_country": ("ecommerce_origin_mismatch", "country_mismatch"),
    "m9_manufacturer": ("ecommerce_manufacturer_mismatch",),
}
# A kind belongs to its field types, so the others need not be compared at all.
TYPES = {
    "m3_mrp_sticker": ("mrp",), "m4_mrp_panels": ("mrp",), "m5_mrp_listing": ("mrp",), "m6_net_quantity": ("net_quantity",),
    "m7_dates": M.DATE_TYPES, "m8_country": ("country_of_origin",), "m9_manufacturer": M.MAKER_TYPES,
}
view("found", ("cocc", "physical_first"), " UNION ALL ".join(PAIRS.values()))
view("report", ("inspections", "images", "grp", "found"), """SELECT i.id AS inspection_id,
 (SELECT count(*) FROM images m WHERE m.inspection_id = i.id) AS total_images, coalesce(c.n, 0) AS total_declarations_compared,
 coalesce(c.bad, 0) = 0 AS is_consistent, coalesce(c.consistent, '') AS consistent_fields
 FROM inspections i LEFT JOIN (SELECT g.inspection_id, count(*) AS n, count(d.field_type) AS bad,
  string_agg(CASE WHEN d.field_type IS NULL THEN g.field_type END, ',' ORDER BY g.field_type) AS consistent
  FROM grp g LEFT JOIN (SELECT DISTINCT inspection_id, field_type FROM found) d USING (inspection_id, field_type) GROUP BY 1) c
 ON c.inspection_id = i.id""")


def suspects(f, groups=None, types=None):
    fields = f.extracted_fields() if types is None else f.extracted_fields().filter(F.col("field_type").isin(*types))
    return written_parquet(f.spark, M.suspects(fields, f.images(), groups=groups), "suspects")


def found(f, types=None):
    return M.discrepancies(suspects(f, types=types))


def report(f):
    groups = written_parquet(f.spark, M.compared_groups(f.extracted_fields()), "groups")
    return M.cross_match(f.inspections(), f.images(), groups, suspects(f, groups))


@query("m1_cross_match", with_views("report") + "SELECT * FROM report")
def _(f):
    return report(f).withColumn("consistent_fields", F.array_join("consistent_fields", ","))


@query(
    "m2_numeric_price",
    with_views("occ") + "SELECT id, price FROM occ WHERE field_type IN ('mrp', 'mfg_date', 'consumer_care')",
)
def _(f):
    rows = f.extracted_fields().filter(F.col("field_type").isin("mrp", "mfg_date", "consumer_care"))
    return rows.select("id", M.numeric_price(F.col("parsed_value")).alias("price"))


def _pairs(name):
    @query(name, with_views("cocc", "physical_first") + PAIRS[name])
    def _(f):
        return M.only(found(f, TYPES[name]), *KINDS[name]).select(
            "inspection_id", "field_type", "discrepancy_type", "first_field_id", "second_field_id"
        )


for _name in PAIRS:
    _pairs(_name)

_TABLE = ", ".join(
    f"('{k}', '{s}', '{r}', '{c}')" for k, (s, r, c) in V.DISCREPANCIES.items()
)


@query(
    "m10_discrepancies_to_violations",
    with_views("found", "inspections")
    + f"""SELECT d.inspection_id, d.first_field_id AS extracted_field_id, replace(t.rule_id, '{{type}}', d.field_type) AS rule_id,
 i.rule_pack_version, t.severity, t.citation FROM found d JOIN (VALUES {_TABLE}) t(k, severity, rule_id, citation) ON t.k = d.discrepancy_type
 JOIN inspections i ON i.id = d.inspection_id""",
)
def _(f):
    return M.discrepancies_to_violations(found(f), f.inspections()).drop("description")


@query("m10_descriptions")
def _(f):
    return found(f).select("inspection_id", "discrepancy_type", "description")


@query(
    "r10_status_after_processing",
    with_views("overall", "report")
    + """SELECT o.inspection_id, CASE WHEN o.overall = 'pass' AND r.is_consistent THEN 'completed' ELSE 'needs_review' END AS status
 FROM overall o JOIN report r ON r.inspection_id = o.inspection_id""",
)
def _(f):
    return R.status_after_processing(R.overall_verdict(f.inspections(), results(f)), report(f))
