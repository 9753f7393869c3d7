"""Capture quality and optical calibration over tables of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.expr import case_map


def quality_flags(blur: Column, brightness: Column, glare: Column, width: Column, height: Column, occlusion: Column) -> dict[str, Column]:
    q = V.QUALITY
    aspect = width / F.greatest(F.lit(1), height)
    return {
        "blur": blur < q["blur"],
        "too_dark": brightness < q["dark"],
        "glare": glare > q["glare"],
        "low_resolution": (width < q["min_side"]) | (height < q["min_side"]),
        "aspect": (aspect > q["aspect"]) | (aspect < 1 / q["aspect"]),
        "occlusion": (occlusion > q["occlusion"]) & (blur >= q["blur"]),
    }


_ERRORS = ("blur", "too_dark", "low_resolution")
_KIND = {"aspect": "perspective", "occlusion": "perspective"}


def _flags() -> dict[str, Column]:
    return quality_flags(*[F.col(c) for c in ("blur_variance", "brightness", "glare_ratio", "width_px", "height_px", "occlusion_ratio")])


def quality_issues(metrics: DataFrame) -> DataFrame:
    """One row per issue of an image, in the order they are shown."""
    issues = F.array(
        *[
            F.when(
                hit,
                F.struct(
                    F.lit(i).alias("issue_seq"), F.lit(_KIND.get(name, name)).alias("type"),
                    F.lit("error" if name in _ERRORS else "warning").alias("severity"), F.lit(V.QUALITY_TITLES[name]).alias("title"),
                ),
            )
            for i, (name, hit) in enumerate(_flags().items(), 1)
        ]
    )
    return metrics.select("image_id", F.inline(F.filter(issues, lambda x: x.isNotNull())))


def quality_scores(metrics: DataFrame) -> DataFrame:
    """Score 10..100, pass flag and status text; only the width counts for the resolution deduction."""
    flags = _flags()
    cost = dict(V.QUALITY_DEDUCTIONS)
    narrow = {**flags, "low_resolution": F.col("width_px") < V.QUALITY["min_side"]}
    score = F.lit(100)
    for name, hit in narrow.items():
        score = score - F.when(hit, cost[name]).otherwise(0)
    failed = flags["blur"] | flags["too_dark"] | flags["low_resolution"]
    title = None
    for name, hit in flags.items():
        title = (F.when if title is None else title.when)(hit, F.lit(V.QUALITY_TITLES[name]))
    any_issue = title.isNotNull()
    return metrics.select(
        "image_id",
        (~failed).alias("passed"),
        F.greatest(F.lit(10), F.least(F.lit(100), score)).alias("score"),
        F.when(failed, title).when(any_issue, "ACCEPTABLE (WITH WARNINGS)").otherwise("QUALITY CHECK PASSED").alias("status_text"),
    )


def derive_scale(detections: DataFrame) -> DataFrame:
    """Millimetres per pixel from a detected barcode; no detection leaves an image uncalibrated."""
    kind = F.upper("barcode_type")
    found = F.col("barcode_type").isNotNull() & (F.col("barcode_width_px") > 0)
    nominal = case_map(kind, V.BARCODE_WIDTHS_MM, F.lit(V.BARCODE_DEFAULT_MM))
    return detections.select(
        "image_id",
        found.alias("is_calibrated"),
        F.when(found, F.round(nominal / F.col("barcode_width_px"), 5)).alias("scale_mm_per_px"),
        F.when(found, nominal).alias("nominal_width_mm"),
        F.when(found, F.concat(F.lit("barcode_"), F.replace(F.lower("barcode_type"), F.lit("-"), F.lit(""))))
        .otherwise("uncalibrated_pdp_ratio").alias("method"),
    )


def measure_dimensions(elements: DataFrame) -> DataFrame:
    """Height in millimetres where calibrated, else only its share of the panel height."""
    h, panel, scale = F.col("height_px").cast("double"), F.col("panel_height_px").cast("double"), F.col("scale_mm_per_px")
    known = scale.isNotNull()
    return elements.select(
        "element_id",
        F.when(known, F.round(h * scale, 2)).alias("height_mm"),
        F.when(panel > 0, F.round(h / panel, 4)).alias("pdp_height_ratio"),
        known.alias("is_calibrated"),
        F.when(~known, "Uncalibrated measurement: no reference barcode detected.").alias("warning"),
    )


def valid_gtin(text: Column) -> Column:
    """Check digit of EAN-8, UPC-A, EAN-13 and GTIN-14, ignoring blanks and hyphens."""
    digits = F.regexp_replace(text, r"[\s-]", "")
    shaped = digits.rlike(r"^[0-9]+$") & F.length(digits).isin(8, 12, 13, 14)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i == 0, 0).when(i % 2 == 1, 3).otherwise(1))
    total = F.aggregate(values, F.lit(0), lambda acc, v: acc + v)
    check = F.pmod(F.lit(10) - total % 10, F.lit(10))
    return F.coalesce(shaped & (check == F.substring(digits, -1, 1).try_cast("int")), F.lit(False))


def device_evidence_status(images: DataFrame) -> DataFrame:
    """unavailable, partial or ready per inspection.

    ``images``: inspection_id, ocr_enabled, barcode_enabled, ocr_error, barcode_error.
    """
    broken = F.col("ocr_error").isNotNull() | F.col("barcode_error").isNotNull()
    per = images.groupBy("inspection_id").agg(
        F.bool_or(F.col("ocr_enabled") | F.col("barcode_enabled")).alias("able"), F.bool_or(broken).alias("broken")
    )
    return per.select(
        "inspection_id",
        F.when(~F.col("able"), "unavailable").when(F.col("broken"), "partial").otherwise("ready").alias("status"),
    )
