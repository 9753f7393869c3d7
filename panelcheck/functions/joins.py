"""Joins and rankings that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BROADCAST_BYTES = 32 * 1024 * 1024
LOOKUP_SALTS = 32


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a large table to a reference table on keys with few distinct values.

    Below the checked size the reference side is broadcast.  Above it both
    sides shuffle with a salt, so that the few hot keys spread over tasks.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup joins are left or inner")
    if plan_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if _hashable(big, c)]), F.lit(LOOKUP_SALTS))
    )
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(LOOKUP_SALTS - 1).cast("bigint"))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def literal_rows(spark, values: list, name: str) -> DataFrame:
    """A short list as rows of literals.  Unlike a table made from Python objects, the optimizer knows its size."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def _hashable(df: DataFrame, column: str) -> bool:
    return "map" not in df.schema[column].dataType.simpleString()


def first_row(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The first row of each group as an aggregate, which combines before the shuffle."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return picked.select(*keys, *[F.col("_first").getField(c).alias(c) for c in rest])


def last_row(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    rest = [c for c in (columns or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return picked.select(*keys, *[F.col("_last").getField(c).alias(c) for c in rest])


def ranked(df: DataFrame, keys: list[str], slot: Column, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 in each group without putting a group into one task.

    ``slot`` cuts a group into pieces and must not decrease along ``order``
    (a day for a time order, a block of 4096 for a counter).  Rows are numbered
    inside a piece and shifted by the counts of the pieces before it.
    """
    d = df.withColumn("_slot", slot)
    counts = d.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slot").alias("_kslot"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
    )
    inside = d.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(*order)))
    match = F.col("_slot").eqNullSafe(F.col("_kslot"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(shifts, match).select(*df.columns, (F.col("_r") + F.col("_shift")).cast("bigint").alias(name))


CHUNK = 1024


def with_neighbours(
    lines: DataFrame, group: str, index: str, wanted: dict[str, tuple[str, int]], halo: int = 3
) -> DataFrame:
    """Add columns of neighbouring rows: ``{"next_text": ("text", 1)}``.

    ``index`` counts the rows of a group densely.  Windows run over chunks of
    1024 rows; rows near a border are also sent to the chunk across it, so a
    group of any length spreads over tasks and every row still sees its
    neighbours.
    """
    i = F.col(index)
    home = F.floor(i / CHUNK)
    copies = F.array_distinct(F.array(home, F.floor((i - halo) / CHUNK), F.floor((i + halo) / CHUNK)))
    spread = lines.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    w = W.partitionBy(group, "_chunk").orderBy(index)
    for name, (source, offset) in wanted.items():
        moved = F.lead(source, offset).over(w) if offset > 0 else F.lag(source, -offset).over(w)
        spread = spread.withColumn(name, moved)
    return spread.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def cells(x: Column, y: Column, w: Column, h: Column, pad_x, pad_y, size: float) -> Column:
    """Grid cells a padded box touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    xs = span(x - pad_x, x + w + pad_x)
    ys = span(y - pad_y, y + h + pad_y)
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
