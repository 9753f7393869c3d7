"""What all declaration extractors share.

Input lines: a group column (an image, or an inspection when panels are read
together), a ``line_number`` in that group, ``source_image_id``, ``text``,
``confidence`` and the box ``x, y, w, h``.

Extractors that look at one line and its neighbours are column expressions that
give a declaration or null.  ``per_line`` evaluates any number of them in one
pass, so the whole set costs one scan and one exchange for the neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcheck.functions.expr import extract
from panelcheck.functions.joins import ranked, with_neighbours

BOX = ["x", "y", "w", "h"]
NEIGHBOURS = {
    "prev_text": ("text", -1), "next1_text": ("text", 1), "next2_text": ("text", 2), "next3_text": ("text", 3),
    **{f"next{k}_{c}": (c, k) for k in (1, 2, 3) for c in BOX},
}
COLUMNS = [
    "field_type", "raw_text", "parsed_value", "confidence", "x", "y", "w", "h", "verdict", "stage", "order_confidence",
]


def rx(pattern: str) -> str:
    """Case-insensitive with Unicode classes."""
    return "(?iU)" + pattern


def rx_cased(pattern: str) -> str:
    return "(?U)" + pattern


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(rx(pattern)), F.lit(False))


def group1(text: Column, pattern: str, group: int = 1) -> Column:
    return extract(text, rx(pattern), group)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def dense_lines(lines: DataFrame, group: str = "source_image_id") -> DataFrame:
    """Lines numbered without gaps from the first number of their group; dense numbers stay as they are.

    Lines with one number follow their place on the page.
    """
    given = F.col("_given")
    first = lines.groupBy(F.col(group).alias("_group")).agg(F.min("line_number").alias("_first"))
    numbered = ranked(lines.withColumnRenamed("line_number", "_given"), [group], F.floor(given / 4096), [given, F.col("y"), F.col("x"), F.col("text")], "_rank")
    joined = numbered.join(first, F.col(group).eqNullSafe(F.col("_group")))
    number = (F.col("_first") + F.col("_rank") - 1).cast(lines.schema["line_number"].dataType)
    return joined.withColumn("line_number", number).select(*lines.columns)


def context(lines: DataFrame, group: str = "source_image_id", wanted: dict | None = None, dense: bool = False) -> DataFrame:
    """Lines with the neighbours the extractors ask for; ``dense`` says that the numbers have no gaps."""
    return with_neighbours(lines if dense else dense_lines(lines, group), group, "line_number", NEIGHBOURS if wanted is None else wanted)


def declaration(
    when: Column, field_type: str, raw: Column, parsed: Column, confidence: Column, verdict, *,
    stage: int = 0, by_confidence: bool = True, box: list[Column] | None = None,
) -> Column:
    """A declaration struct where ``when`` holds, else null.

    ``stage`` and ``order_confidence`` order the candidates of a type: a lower
    stage ends the search for later ones; with ``by_confidence`` false (a null
    order_confidence) the first line of the stage wins whatever its confidence.
    """
    box = box or [F.col(c) for c in BOX]
    return F.when(
        when,
        F.struct(
            F.lit(field_type).alias("field_type"),
            raw.alias("raw_text"),
            parsed.alias("parsed_value"),
            confidence.alias("confidence"),
            *[b.cast("double").alias(c) for b, c in zip(box, BOX)],
            (verdict if isinstance(verdict, Column) else F.lit(verdict)).alias("verdict"),
            F.lit(stage).alias("stage"),
            (F.coalesce(confidence, F.lit(0.0)) if by_confidence else F.lit(None).cast("double")).alias("order_confidence"),
        ),
    )


class LineExtractor(NamedTuple):
    """Named columns in stages, then the declaration made from them.

    A stage may use the columns of earlier stages.  Each pattern is matched once
    and kept as a column; later patterns run only where an earlier one hit.
    """

    stages: list[Callable[[], dict[str, Column]]]
    make: Callable[[], Column]


def per_line(rows: DataFrame, keys: list[str], extractors: list) -> DataFrame:
    """All declarations of the given extractors (or plain columns); ``seq`` is the extractor's position."""
    staged = [e for e in extractors if isinstance(e, LineExtractor)]
    for level in range(max((len(e.stages) for e in staged), default=0)):
        rows = rows.withColumns({k: c for e in staged if level < len(e.stages) for k, c in e.stages[level]().items()})
    columns = [e.make() if isinstance(e, LineExtractor) else e for e in extractors]
    found = F.array(*[F.struct(F.lit(i).alias("seq"), c.alias("d")) for i, c in enumerate(columns)])
    kept = F.filter(found, lambda e: e["d"].isNotNull())
    return rows.select(*keys, "line_number", F.explode(kept).alias("_e")).select(
        *keys, "line_number", F.col("_e.seq").alias("seq"), *[F.col("_e.d").getField(c).alias(c) for c in COLUMNS]
    )


def settle_stages(candidates: DataFrame, group: str) -> DataFrame:
    """Drop candidates a lower stage has overruled; a first-line stage keeps its first line only."""
    lowest = candidates.groupBy(group, "field_type").agg(
        F.min(F.struct("stage", F.when(F.col("order_confidence").isNull(), F.col("line_number")).alias("only"))).alias("_low")
    )
    rows = candidates.join(lowest, [group, "field_type"])
    keep = (F.col("stage") == F.col("_low.stage")) & (F.col("_low.only").isNull() | (F.col("line_number") == F.col("_low.only")))
    return rows.filter(keep).drop("_low")


def near(ax, ay, aw, ah, bx, by, bw, bh, gap: tuple[float, float]) -> Column:
    """Whether two boxes are within the horizontal and vertical gap."""
    dx = F.greatest(ax - (bx + bw), bx - (ax + aw), F.lit(0.0))
    dy = F.greatest(ay - (by + bh), by - (ay + ah), F.lit(0.0))
    return (dx <= gap[0]) & (dy <= gap[1])


def raised(confidence: Column, bonus: Column) -> Column:
    """Confidence plus 0.05 where ``bonus`` holds, at most 1, to four places."""
    return F.round(F.when(bonus, F.least(F.lit(1.0), confidence + 0.05)).otherwise(confidence), 4)
