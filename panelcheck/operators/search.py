"""Search, listing and document views over inspections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.expr import any_of, icontains
from panelcheck.operators.rules import primary_image


def scope_to_actor(df: DataFrame, actor: dict | None, column: str = "officer_id", wide=("supervisor", "admin")) -> DataFrame:
    """Officers see their own rows; ``wide`` roles see all."""
    if actor is None or actor["role"] in wide:
        return df
    return df.filter(F.col(column) == actor["id"])


def _ids(children: DataFrame) -> DataFrame:
    return children.select(F.col("inspection_id").alias("id"))


def search_inspections(
    inspections: DataFrame,
    users: DataFrame | None = None,
    violations: DataFrame | None = None,
    fields: DataFrame | None = None,
    *,
    actor: dict | None = None,
    officer_id=None,
    officer_name: str | None = None,
    date_from=None,
    date_to=None,
    region: str | None = None,
    commodity_category: str | None = None,
    status: str | None = None,
    violation_type: str | None = None,
    has_violations: bool | None = None,
    product_query: str | None = None,
    is_self_check: bool | None = False,
) -> DataFrame:
    """Filtered inspections.  Filters on the table reach the scan; filters on children are semi or anti joins."""
    rows = inspections
    if is_self_check is not None:
        rows = rows.filter(F.col("is_self_check") == is_self_check)
    if actor is not None and actor["role"] == "officer":
        rows = rows.filter(F.col("officer_id") == actor["id"])
    elif officer_id is not None:
        rows = rows.filter(F.col("officer_id") == officer_id)
    if date_from is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        rows = rows.filter(F.col("created_at") <= F.lit(date_to).cast("timestamp"))
    if region:
        rows = rows.filter(icontains(F.col("region"), region))
    if commodity_category:
        rows = rows.filter(F.col("commodity_category") == commodity_category)
    if status:
        rows = rows.filter(F.col("status") == status)
    if officer_name:
        named = users.filter(icontains(F.col("full_name"), officer_name)).select(F.col("id").alias("officer_id"))
        rows = rows.join(named, "officer_id", "left_semi")
    if has_violations is not None:
        rows = rows.join(_ids(violations), "id", "left_semi" if has_violations else "left_anti")
    if violation_type:
        hit = any_of([icontains(F.col(c), violation_type) for c in ("rule_id", "description", "citation")])
        rows = rows.join(_ids(violations.filter(hit)), "id", "left_semi")
    if product_query:
        hit = any_of([icontains(F.col(c), product_query) for c in ("raw_text", "parsed_value", "officer_override_value")])
        rows = rows.join(_ids(fields.filter(hit)), "id", "left_semi")
    return rows.select(*inspections.columns)


def page(rows: DataFrame, skip: int = 0, limit: int = 20, newest: str = "created_at") -> DataFrame:
    """One page, newest first with the id as tie-break, and the total of all matches."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.orderBy(F.desc(newest), "id").offset(skip).limit(limit).withColumn("total", total)


def _count(children: DataFrame, name: str) -> DataFrame:
    return children.groupBy(F.col("inspection_id").alias("id")).agg(F.count(F.lit(1)).alias(name))


def inspection_summaries(inspections, users, images, fields, violations) -> DataFrame:
    """Result rows of a search: child counts, verdict, thumbnail image."""
    front = primary_image(images.select("inspection_id", "id", "image_role", "storage_url")).select(
        F.col("inspection_id").alias("id"), F.col("id").alias("front_image_id"), F.col("storage_url").alias("thumbnail_url")
    )
    names = users.select(F.col("id").alias("officer_id"), F.col("full_name").alias("officer_name"))
    zero = F.lit(0).cast("bigint")
    rows = (
        inspections.join(names, "officer_id", "left")
        .join(_count(violations, "violations_count"), "id", "left")
        .join(_count(fields, "fields_count"), "id", "left")
        .join(_count(images, "images_count"), "id", "left")
        .join(front, "id", "left")
    )
    verdict = (
        F.when(F.col("violations_count") > 0, "non_compliant")
        .when(F.col("status") == "needs_review", "needs_review")
        .otherwise("compliant")
    )
    counts = ("violations_count", "fields_count", "images_count")
    return rows.select(
        *inspections.columns, "officer_name",
        *[F.coalesce(c, zero).alias(c) for c in counts],
        "front_image_id", "thumbnail_url", verdict.alias("overall_verdict"),
    )


def list_self_checks(inspections: DataFrame, actor: dict, skip: int = 0, limit: int = 20) -> DataFrame:
    mine = scope_to_actor(inspections.filter("is_self_check"), actor)
    return page(mine, skip, limit)


def entity_owners(inspections: DataFrame, fields: DataFrame) -> DataFrame:
    """entity_id -> inspection and field type, for inspections themselves and for their fields."""
    own = inspections.select(
        F.col("id").alias("entity_id"), F.col("id").alias("inspection_id"), F.lit(None).cast("string").alias("field_type")
    )
    return own.unionByName(fields.select(F.col("id").alias("entity_id"), "inspection_id", "field_type"))


def audit_trail(audit_logs: DataFrame, inspections: DataFrame, fields: DataFrame) -> DataFrame:
    """Audit rows of the given inspections and of their fields."""
    kept = fields.join(inspections.select(F.col("id").alias("inspection_id")), "inspection_id", "left_semi")
    owners = entity_owners(inspections, kept).select("entity_id").distinct()
    return audit_logs.join(owners, "entity_id", "left_semi")


def review_history(audit_logs: DataFrame, users: DataFrame, inspections: DataFrame, fields: DataFrame) -> DataFrame:
    people = users.select(
        F.col("id").alias("actor_user_id"), F.col("full_name").alias("officer_name"), F.col("role").alias("officer_role")
    )
    return (
        audit_logs.join(entity_owners(inspections, fields), "entity_id")
        .join(people, "actor_user_id")
        .select(
            "inspection_id", "id", "action", "entity_type", "entity_id",
            F.coalesce("field_type", F.lit("inspection")).alias("field_type"),
            F.col("actor_user_id").alias("officer_id"), "officer_name", "officer_role",
            "before_value", "after_value", "created_at",
        )
    )


def list_reports(reports: DataFrame, inspection_id=None) -> DataFrame:
    """Reports newest first."""
    rows = reports if inspection_id is None else reports.filter(F.col("inspection_id") == inspection_id)
    return rows.orderBy(F.desc("generated_at"), "id")


def _nested(children: DataFrame, name: str, order: str, columns: list[str]) -> DataFrame:
    item = F.struct(order, *[c for c in columns if c != order])
    return children.groupBy(F.col("inspection_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias(name))


def inspection_documents(inspections, images, fields, violations) -> DataFrame:
    """One document per inspection with its children nested.

    Each child table is nested on its own before it meets the inspections; an
    inspection is one package, so its document is the size of a package record.
    """
    return (
        inspections.join(_nested(images, "images", "id", ["image_role", "width_px", "height_px", "storage_url"]), "id", "left")
        .join(
            _nested(fields, "fields", "field_seq", ["id", "field_type", "parsed_value", "confidence", "verdict"]), "id", "left")
        .join(_nested(violations, "violations", "id", ["rule_id", "severity", "description", "citation"]), "id", "left")
    )


def queued_summaries(queue: DataFrame, images: DataFrame, text: str | None = None) -> DataFrame:
    """Device records still waiting for sync, as archive rows."""
    rows = queue.filter(F.col("status").isin(*V.QUEUED_STATES))
    if text and text.strip():
        has = lambda c: F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
        rows = rows.filter(has("id") | F.coalesce(has("commodity_category"), F.lit(False)))
    front = primary_image(images.select("inspection_id", "id", "image_role")).select(
        F.col("inspection_id").alias("id"), F.col("id").alias("front_image_id")
    )
    return (
        rows.join(_count(images, "images_count"), "id", "left")
        .join(front, "id", "left")
        .select(
            "id", "status", "commodity_category", "created_at",
            F.coalesce("images_count", F.lit(0).cast("bigint")).alias("images_count"),
            "front_image_id",
            F.lit("needs_review").alias("overall_verdict"),
        )
    )
