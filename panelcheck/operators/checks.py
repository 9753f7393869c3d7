"""Integrity checks on the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcheck import fixed_values as V

FOREIGN_KEYS = [
    ("inspections", "officer_id", "users"),
    ("images", "inspection_id", "inspections"),
    ("extracted_fields", "inspection_id", "inspections"),
    ("extracted_fields", "source_image_id", "images"),
    ("violations", "inspection_id", "inspections"),
    ("violations", "extracted_field_id", "extracted_fields"),
    ("audit_logs", "actor_user_id", "users"),
]
CHECK_LISTS = [
    ("users", "role", V.ROLES),
    ("inspections", "status", V.INSPECTION_STATUSES),
    ("images", "image_role", V.IMAGE_ROLES),
    ("extracted_fields", "verdict", V.FIELD_VERDICTS),
    ("violations", "severity", V.SEVERITIES),
    ("reports", "format", V.REPORT_FORMATS),
]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def orphans(tables: dict[str, DataFrame], keys=FOREIGN_KEYS) -> DataFrame:
    """Child rows whose parent is missing: child table, column, row id, missing value."""
    parts = []
    for child, column, parent in keys:
        if child in tables and parent in tables:
            rows = tables[child].select(F.col("id").alias("row_id"), F.col(column).alias("missing")).filter("missing IS NOT NULL")
            parents = tables[parent].select(F.col("id").alias("missing"))
            parts.append(
                rows.join(parents, "missing", "left_anti").select(
                    F.lit(child).alias("child"), F.lit(column).alias("column"), "row_id", "missing"
                )
            )
    return _union(parts)


def domain_violations(tables: dict[str, DataFrame], lists=CHECK_LISTS) -> DataFrame:
    """Values outside their list: table, column, value, rows."""
    parts = [
        tables[t].filter(~F.col(c).isin(*allowed)).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(t).alias("table"), F.lit(c).alias("column"), "value", "rows")
        for t, c, allowed in lists
        if t in tables
    ]
    return _union(parts)


def duplicate_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Keys held by more than one row; ``tables`` maps a name to (table, key columns)."""
    parts = []
    for name, (df, keys) in tables.items():
        known = df.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        parts.append(
            known.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
            .select(F.lit(name).alias("table"), text.alias("key"), "rows")
        )
    return _union(parts)


def audit_mutations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the older audit snapshot that the newer one lost or changed."""
    columns = [c for c in old.columns if c != "id"]
    digest = lambda df, name: df.select("id", F.xxhash64(*columns).alias(name), F.struct(*columns).alias(name + "_row"))
    both = digest(old, "o").join(digest(new, "n"), "id", "left")
    changed = (F.col("o") != F.col("n")) | ~F.col("o_row").eqNullSafe(F.col("n_row"))
    kind = F.when(F.col("n").isNull(), "removed").when(changed, "changed")
    return both.select("id", kind.alias("mutation")).filter("mutation IS NOT NULL")
