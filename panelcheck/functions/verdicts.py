"""Column functions for rule verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.expr import case_map


def field_threshold(field_type: Column) -> Column:
    """Confidence a field type needs; unknown or missing types need the default."""
    name = F.replace(F.trim(F.lower(field_type)), F.lit("-"), F.lit("_"))
    return F.coalesce(case_map(name, V.FIELD_THRESHOLDS), F.lit(V.REVIEW_THRESHOLD))


def font_threshold(area_cm2: Column, thresholds: Column) -> Column:
    """Required height for a panel area: inclusive upper bounds, a default per bracket."""
    height = lambda key, default: F.coalesce(F.element_at(thresholds, F.lit(key)), F.lit(default))
    out = None
    for upper, key, default in V.FONT_BRACKETS:
        out = (F.when if out is None else out.when)(area_cm2 <= upper, height(key, default))
    return out.otherwise(height(*V.FONT_BRACKET_ABOVE))


def route_verdict(verdict: Column, confidence: Column, field_type: Column) -> Column:
    """A pass below the field's threshold goes to review."""
    return F.when((verdict == "pass") & (confidence < field_threshold(field_type)), "needs_review").otherwise(verdict)
