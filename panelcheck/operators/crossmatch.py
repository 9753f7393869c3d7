"""Consistency of the same declaration across the panels of a package.

Pairs are formed on distinct values, not on occurrences: a thousand equal
stickers are one value, so agreement costs nothing and only values that differ
are joined back to their occurrences.  Groups whose smallest and largest value
are equal leave before any pair is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.expr import any_of, extract
from panelcheck.functions.joins import first_row

GROUP = ["inspection_id", "field_type"]
DATE_TYPES = ("mfg_date", "expiry_date")
MAKER_TYPES = ("manufacturer_address", "importer_packer")
PANEL_TYPES = ("net_quantity", *DATE_TYPES, "country_of_origin")
CHECKED = ("mrp", *PANEL_TYPES, *MAKER_TYPES)


def numeric_price(value: Column) -> Column:
    """The first number in a text, as a price."""
    return extract(value, r"([0-9]+(?:\.[0-9]{1,2})?)").try_cast("double")


def comparable_text(value: Column, field_type: Column) -> Column:
    """Lower case without outer blanks; inner blanks collapse for quantities only.  A missing value reads 'none'."""
    plain = F.lower(F.regexp_replace(F.coalesce(value, F.lit("None")), r"(?U)^\s+|\s+$", ""))
    return F.when(field_type == "net_quantity", F.regexp_replace(plain, r"(?U)\s+", " ")).otherwise(plain)


def normalised_quantity(value: Column) -> Column:
    """Quantity as value and unit from its JSON form, so that '500 GMS' equals '500 g'."""
    return F.coalesce(
        F.concat_ws(" ", F.get_json_object(value, "$.value"), F.get_json_object(value, "$.unit")), value
    )


def _comparable(fields: DataFrame, compare: str) -> DataFrame:
    value = F.col("parsed_value")
    if compare == "normalised":
        value = F.when((F.col("field_type") == "net_quantity") & value.startswith("{"), normalised_quantity(value)).otherwise(value)
    return fields.select(
        "inspection_id", "field_type", "field_seq", F.col("id").alias("field_id"), "source_image_id", "parsed_value",
        F.when(F.col("field_type") == "mrp", numeric_price(value)).alias("price"),
        comparable_text(value, F.col("field_type")).alias("text"),
    )


def compared_groups(fields: DataFrame, compare: str = "text") -> DataFrame:
    """(inspection, type) groups seen on at least two images; ``may_conflict`` if their values are not all equal.

    ``compare="normalised"`` compares quantities by value and unit instead of text.
    """
    is_mrp = F.col("field_type") == "mrp"
    # min < max needs no distinct set, so the group collapses on the map side
    return (
        _comparable(fields, compare)
        .groupBy(*GROUP)
        .agg(
            F.min("source_image_id").alias("lo_image"), F.max("source_image_id").alias("hi_image"),
            F.min("price").alias("lo_price"), F.max("price").alias("hi_price"),
            F.min("text").alias("lo_text"), F.max("text").alias("hi_text"),
        )
        .filter("lo_image < hi_image")
        .select(
            *GROUP,
            (
                F.col("field_type").isin(*CHECKED)
                & F.when(is_mrp, F.col("lo_price") < F.col("hi_price")).otherwise(F.col("lo_text") < F.col("hi_text"))
            ).alias("may_conflict"),
        )
    )


def suspects(fields: DataFrame, images: DataFrame, compare: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """Occurrences of the groups whose values differ, with the role of their panel.

    A small share of all declarations.  Several comparisons read it, so callers
    with large tables write it once (``sources.files.written_parquet``) before
    they go on.
    """
    if groups is None:
        groups = compared_groups(fields, compare)
    # one row an inspection: fields dealt by their inspection need no exchange, which a join by both columns would ask for
    differing = groups.filter(F.coalesce("may_conflict", F.lit(False))).groupBy("inspection_id").agg(F.collect_set("field_type").alias("_differing"))
    roles = images.select(F.col("id").alias("source_image_id"), "image_role")
    return (
        _comparable(fields, compare)
        .join(differing, "inspection_id")
        .filter(F.array_contains("_differing", F.col("field_type")))
        .drop("_differing")
        .join(roles, "source_image_id", "left")
        .withColumn("image_role", F.coalesce("image_role", F.lit("unknown")))
    )


def _sided(occ: DataFrame) -> DataFrame:
    """Occurrences once per comparison they take part in, as the left or the right side."""
    role, is_mrp = F.col("image_role"), F.col("field_type") == "mrp"
    entry = lambda kind, side: F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<kind:string,side:string>>")
    listing = role == "ecommerce_listing"
    parts = (
        F.when(is_mrp & (role == "sticker"), F.array(entry("sticker", "l")))
        .when(is_mrp & listing, F.array(entry("sticker", "r"), entry("listing", "l")))
        .when(is_mrp, F.array(entry("sticker", "r"), entry("listing", "r")))
        .when(listing, F.array(entry("listing", "l")))
        .otherwise(F.array(entry("listing", "r")))
    )
    usable = F.when(is_mrp, F.col("price").isNotNull()).otherwise(F.col("text") != "")
    return occ.select("*", F.inline(F.when(usable, parts).otherwise(none)))


def _pair_type(kind, ftype, lp, rp, lt, rt) -> Column:
    """The discrepancy two values make, null when they agree."""
    away = F.abs(lp - rp) > 0.01
    return (
        F.when((kind == "sticker") & (lp > rp), "mrp_altered_sticker")
        .when((kind == "sticker") & (lp != rp), "mrp_sticker_mismatch")
        .when(kind == "sticker", F.lit(None))
        .when((ftype == "mrp") & (lp > rp), "ecommerce_mrp_inflation")
        .when((ftype == "mrp") & away, "ecommerce_mrp_mismatch")
        .when(ftype == "mrp", F.lit(None))
        .when(ftype.isin(*MAKER_TYPES), F.when(~lt.contains(rt) & ~rt.contains(lt), "ecommerce_manufacturer_mismatch"))
        .when(lt == rt, F.lit(None))
        .when(ftype == "net_quantity", "ecommerce_net_quantity_mismatch")
        .when(ftype.isin(*DATE_TYPES), "ecommerce_date_mismatch")
        .when(ftype == "country_of_origin", "ecommerce_origin_mismatch")
    )


def conflicting_values(found: DataFrame) -> DataFrame:
    """Pairs of distinct values that conflict: group, kind, type and the two values."""
    key = [*GROUP, "kind"]
    values = _sided(found).select(*key, "side", "price", "text").distinct()
    left = values.filter("side = 'l'").select(*key, F.col("price").alias("lp"), F.col("text").alias("lt"))
    right = values.filter("side = 'r'").select(*key, F.col("price").alias("rp"), F.col("text").alias("rt"))
    c = F.col
    return (
        left.join(right, key)
        .withColumn("discrepancy_type", _pair_type(c("kind"), c("field_type"), c("lp"), c("rp"), c("lt"), c("rt")))
        .filter("discrepancy_type IS NOT NULL")
    )


def _panel_conflicts(found: DataFrame) -> DataFrame:
    """Later panels that differ from the first one."""
    is_mrp = F.col("field_type") == "mrp"
    panel = found.filter(
        F.when(is_mrp, ~F.col("image_role").isin("sticker", "ecommerce_listing") & F.col("price").isNotNull()).otherwise(
            (F.col("image_role") != "ecommerce_listing") & F.col("field_type").isin(*PANEL_TYPES)
        )
    )
    first = first_row(panel, GROUP, [F.col("field_seq")], ["field_seq", "field_id", "source_image_id", "image_role", "parsed_value", "price", "text"])
    first = first.select(*GROUP, *[F.col(x).alias("f_" + x) for x in first.columns if x not in GROUP])
    differs = F.when(is_mrp, F.abs(F.col("f_price") - F.col("price")) > 0.01).otherwise(
        (F.col("f_text") != "") & (F.col("text") != "") & (F.col("f_text") != F.col("text"))
    )
    kind = (
        F.when(is_mrp, "mrp_panel_conflict")
        .when(F.col("field_type") == "net_quantity", "net_quantity_mismatch")
        .when(F.col("field_type") == "country_of_origin", "country_mismatch")
        .otherwise("date_mismatch")
    )
    return (
        panel.join(first, GROUP)
        .filter((F.col("field_seq") > F.col("f_field_seq")) & differs)
        .select(
            *GROUP, kind.alias("discrepancy_type"),
            *[F.col("f_" + x).alias("a_" + x) for x in _SIDE], *[F.col(x).alias("b_" + x) for x in _SIDE],
        )
    )


_SIDE = ["field_id", "source_image_id", "image_role", "parsed_value", "price"]


def _expanded(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Conflicting values back to the occurrences that carry them."""
    sided = _sided(found)
    key = [*GROUP, "kind"]

    def side(which: str, p: str, t: str, prefix: str) -> DataFrame:
        return sided.filter(F.col("side") == which).select(
            *key, F.coalesce("price", F.lit(-1.0)).alias(p), F.col("text").alias(t), *[F.col(x).alias(prefix + x) for x in _SIDE]
        )

    filled = pairs.withColumn("lp", F.coalesce("lp", F.lit(-1.0))).withColumn("rp", F.coalesce("rp", F.lit(-1.0)))
    return (
        filled.join(side("l", "lp", "lt", "a_"), [*key, "lp", "lt"])
        .join(side("r", "rp", "rt", "b_"), [*key, "rp", "rt"])
        .select(*GROUP, "discrepancy_type", *["a_" + x for x in _SIDE], *["b_" + x for x in _SIDE])
    )


def _describe() -> Column:
    kind, a, b = F.col("discrepancy_type"), F.col("a_parsed_value"), F.col("b_parsed_value")
    a, b = F.coalesce(a, F.lit("None")), F.coalesce(b, F.lit("None"))
    pa, pb = F.col("a_price"), F.col("b_price")
    words = F.replace("field_type", F.lit("_"), F.lit(" "))
    f = F.format_string
    texts = {
        "mrp_altered_sticker": f(
            "Altered MRP sticker detected: sticker price (Rs. %.2f) exceeds original base package price (Rs. %.2f).", pa, pb),
        "mrp_sticker_mismatch": f(
            "Promotional/discount sticker detected: sticker price Rs. %.2f differs from base price Rs. %.2f.", pa, pb),
        "mrp_panel_conflict": f(
            "Conflicting MRP values on package: %s declares Rs. %.2f, while %s declares Rs. %.2f.",
            "a_image_role", pa, "b_image_role", pb),
        "ecommerce_mrp_inflation": f(
            "E-commerce listing price (Rs. %.2f) exceeds physical package printed MRP (Rs. %.2f). Unlawful overcharging on "
            "digital marketplace under Rule 6(10) and Rule 18(2).", pa, pb),
        "ecommerce_mrp_mismatch": f(
            "E-commerce listed MRP (Rs. %.2f) does not match physical package printed MRP (Rs. %.2f).", pa, pb),
        "ecommerce_net_quantity_mismatch": f(
            "E-commerce listing advertised quantity ('%s') conflicts with delivered physical package quantity ('%s'). "
            "Deceptive declaration under Rule 6(10).", a, b),
        "net_quantity_mismatch": f(
            "Net quantity mismatch across package panels: '%s' on %s vs '%s' on %s.", a, "a_image_role", b, "b_image_role"),
        "ecommerce_date_mismatch": f(
            "E-commerce listing %s '%s' contradicts physical package declaration '%s'.", words, a, b),
        "date_mismatch": f("%s mismatch: '%s' on %s differs from '%s' on %s.", F.initcap(words), a, "a_image_role", b, "b_image_role"),
        "ecommerce_origin_mismatch": f(
            "E-commerce listing claims country of origin '%s', contradicting physical package declaration '%s'.", a, b),
        "country_mismatch": f(
            "Conflicting country of origin declarations: '%s' on %s vs '%s' on %s.", a, "a_image_role", b, "b_image_role"),
        "ecommerce_manufacturer_mismatch": f(
            "E-commerce listing manufacturer/packer '%s' differs from physical package declaration '%s'.", a, b),
    }
    out = None
    for name, text in texts.items():
        out = (F.when if out is None else out.when)(kind == name, text)
    return out


def discrepancies(found: DataFrame) -> DataFrame:
    """One row per conflicting pair of occurrences; ``found`` comes from ``suspects``."""
    pairs = _expanded(found, conflicting_values(found)).unionByName(_panel_conflicts(found))
    kind = F.col("discrepancy_type")
    pick = lambda i: F.element_at(
        F.create_map(*[F.lit(x) for k, v in V.DISCREPANCIES.items() for x in (k, v[i])]), kind
    )
    return pairs.select(
        *GROUP, "discrepancy_type",
        pick(0).alias("severity"),
        F.replace(pick(1), F.lit("{type}"), F.col("field_type")).alias("rule_id"),
        pick(2).alias("citation"),
        _describe().alias("description"),
        F.col("a_field_id").alias("first_field_id"), F.col("b_field_id").alias("second_field_id"),
        F.col("a_source_image_id").alias("first_image_id"), F.col("b_source_image_id").alias("second_image_id"),
    )


def conflicting_types(found: DataFrame) -> DataFrame:
    """(inspection, type) groups with a discrepancy; never expands pairs."""
    pairs = conflicting_values(found).select(*GROUP).unionByName(_panel_conflicts(found).select(*GROUP))
    return pairs.distinct()


def cross_match(inspections: DataFrame, images: DataFrame, groups: DataFrame, found: DataFrame) -> DataFrame:
    """The consistency report of each inspection, from ``compared_groups`` and ``suspects``."""
    bad = conflicting_types(found).withColumn("bad", F.lit(True))
    per = (
        groups.join(bad, GROUP, "left")
        .groupBy("inspection_id")
        .agg(
            F.count(F.lit(1)).alias("compared"),
            F.count_if("bad").alias("bad"),
            F.sort_array(F.collect_list(F.when(F.col("bad").isNull(), F.col("field_type")))).alias("consistent"),
        )
    )
    counts = images.groupBy("inspection_id").agg(F.count(F.lit(1)).alias("images"))
    zero = F.lit(0).cast("bigint")
    return (
        inspections.select(F.col("id").alias("inspection_id"))
        .join(counts, "inspection_id", "left")
        .join(per, "inspection_id", "left")
        .select(
            "inspection_id",
            F.coalesce("images", zero).alias("total_images"),
            F.coalesce("compared", zero).alias("total_declarations_compared"),
            (F.coalesce("bad", zero) == 0).alias("is_consistent"),
            F.coalesce("consistent", F.array().cast("array<string>")).alias("consistent_fields"),
        )
    )


def discrepancies_to_violations(found: DataFrame, inspections: DataFrame) -> DataFrame:
    """Violation rows, bound to the first occurrence of each pair."""
    versions = inspections.select(F.col("id").alias("inspection_id"), "rule_pack_version")
    return found.join(versions, "inspection_id").select(
        "inspection_id", F.col("first_field_id").alias("extracted_field_id"), "rule_id", "rule_pack_version",
        "description", "citation", "severity",
    )


def only(found: DataFrame, *kinds: str) -> DataFrame:
    return found.filter(any_of([F.col("discrepancy_type") == k for k in kinds]))
