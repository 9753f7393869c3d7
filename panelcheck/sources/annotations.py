"""Annotation exports, region tables, recognition result files and COCO data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.schemas import ANNOTATION_TASK, OCR_RESULT


def load_annotation_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks with the result of their latest annotation."""
    return latest_annotation(spark.read.schema(ANNOTATION_TASK).json(path))


def latest_annotation(tasks: DataFrame) -> DataFrame:
    """The annotation with the greatest (updated_at, id)."""
    newest = F.array_max(
        F.transform("annotations", lambda a, i: F.struct(F.coalesce(a["updated_at"], F.lit("")).alias("u"), F.coalesce(a["id"], F.lit(0)).alias("id"), i.alias("i")))
    )
    count = F.greatest(F.coalesce(F.size("annotations"), F.lit(0)), F.lit(0))
    return tasks.select(
        F.col("id").alias("task_row"), "data.sample_id", "data.source_filename", count.alias("annotation_count"),
        F.get("annotations", newest["i"])["result"].alias("result"),
    )


def _region(item: Column) -> dict[str, Column]:
    v = item["value"]
    return {"label": F.get(v["rectanglelabels"], 0), "x": v["x"], "y": v["y"], "width": v["width"], "height": v["height"]}


def flat_regions(tasks: DataFrame) -> DataFrame:
    """One row per rectangle with the reason it cannot be used, if any."""
    items = tasks.select("sample_id", "source_filename", F.posexplode("result").alias("result_index", "item")).filter(
        F.col("item.type") == "rectanglelabels"
    )
    r = _region(F.col("item"))
    sides = [r[c] for c in ("x", "y", "width", "height")]
    missing = sides[0].isNull() | sides[1].isNull() | sides[2].isNull() | sides[3].isNull()
    odd = F.lit(False)
    for s in sides:
        odd = odd | F.isnan(s) | (F.abs(s) == float("inf"))
    cause = (
        F.when(F.col("item.value").isNull(), "malformed_value")
        .when(~F.coalesce(F.size(F.col("item.value.rectanglelabels")) == 1, F.lit(False)) | r["label"].isNull(), "invalid_label_payload")
        .when(~r["label"].isin(*V.BOX_LABELS), "unknown_label")
        .when(missing, "invalid_geometry")
        .when(odd | (r["width"] <= 0) | (r["height"] <= 0), "non_positive_geometry")
        .when((r["x"] < 0) | (r["y"] < 0) | (r["x"] + r["width"] > 100.0001) | (r["y"] + r["height"] > 100.0001), "out_of_bounds")
    )
    return items.select(
        "sample_id", "source_filename", "result_index", *[c.alias(n) for n, c in r.items()],
        F.col("item.original_width").alias("original_width"), F.col("item.original_height").alias("original_height"), cause.alias("issue"),
    )


def regions_and_issues(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    flat = flat_regions(tasks)
    return flat.filter("issue IS NULL").drop("issue"), flat.filter("issue IS NOT NULL").select(
        "sample_id", "source_filename", "result_index", "label", "issue"
    )


def annotation_audit(tasks: DataFrame) -> DataFrame:
    """metric, key, value rows: counts, duplicate keys, missing and multiple annotations."""
    flat = flat_regions(tasks)
    row = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), key.alias("key"), value.cast("bigint").alias("value"))
    task = F.concat_ws("/", "sample_id", "source_filename")
    empty = F.lit("")
    missing_key = F.col("sample_id").isNull() | F.col("source_filename").isNull()
    totals = tasks.agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("annotation_count") > 0).alias("a"), F.sum("annotation_count").alias("n")
    )
    good = flat.filter("issue IS NULL")
    parts = [
        row(totals, "task_count", empty, F.col("t")),
        row(totals, "annotated_task_count", empty, F.col("a")),
        row(totals, "annotation_count", empty, F.col("n")),
        row(good.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label_count", F.col("label"), F.col("n")),
        row(good.agg(F.count(F.lit(1)).alias("n")), "box_count", empty, F.col("n")),
        row(flat.filter("issue IS NOT NULL").groupBy("issue").agg(F.count(F.lit(1)).alias("n")), "issue_count", F.col("issue"), F.col("n")),
        row(tasks.filter(missing_key).agg(F.count(F.lit(1)).alias("n")), "missing_task_key", empty, F.col("n")),
        row(tasks.filter(~missing_key & (F.col("annotation_count") == 0)), "missing_annotation", task, F.lit(1)),
        row(tasks.filter("annotation_count > 1"), "multiple_annotations", task, F.col("annotation_count")),
        row(
            tasks.filter(~missing_key).groupBy("sample_id", "source_filename").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
            "duplicate_task_key", task, F.col("n"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def freeze_check(tasks: DataFrame, expected: int) -> DataFrame:
    """One row: may this export be frozen, and its content digest.

    ``tasks`` is the raw export.  The digest is SHA-256 over the sum and the
    count of row hashes, which does not depend on row order and combines on the
    map side.
    """
    body = F.sha2(F.to_json(F.struct("id", "data", "annotations")), 256)
    parts = [F.conv(F.substring(body, 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)") for i in range(4)]
    agg = tasks.agg(
        F.count(F.lit(1)).alias("task_count"),
        F.countDistinct("id").alias("distinct_ids"),
        F.count_if(F.coalesce(F.size("annotations"), F.lit(0)) <= 0).alias("unannotated"),
        F.sum(F.greatest(F.coalesce(F.size("annotations"), F.lit(0)), F.lit(0))).cast("bigint").alias("annotation_count"),
        *[F.sum(p).alias(f"_p{i}") for i, p in enumerate(parts)],
    )
    problem = (
        F.when(F.col("task_count") != expected, "unexpected_task_count")
        .when(F.col("distinct_ids") != F.col("task_count"), "duplicate_task_ids")
        .when(F.col("unannotated") > 0, "unannotated_tasks")
    )
    digest = F.sha2(F.concat_ws("|", F.col("task_count").cast("string"), *[F.col(f"_p{i}").cast("string") for i in range(4)]), 256)
    return agg.select("task_count", "annotation_count", "unannotated", problem.alias("problem"), digest.alias("content_digest"))


def load_ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """Raw per-image recognition files as one row per line."""
    return flatten_ocr_results(spark.read.schema(OCR_RESULT).json(path))


def flatten_ocr_results(results: DataFrame) -> DataFrame:
    box = F.col("line.bounding_box")
    return results.select("source_image_id", F.col("engine_used").alias("engine"), F.posexplode("lines").alias("pos", "line")).select(
        "source_image_id", "engine", (F.col("pos") + 1).alias("line_number"), "line.text", "line.confidence",
        *[box[c].alias(c) for c in ("x", "y", "w", "h")],
    )


# ------------------------------------------------------------------ COCO


def write_coco(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """Images and annotations as JSON lines, one folder per split."""
    images.write.partitionBy("split").json(f"{path}/images")
    annotations.write.partitionBy("split").json(f"{path}/annotations")


IMAGE_SCHEMA = "id bigint, file_name string, width bigint, height bigint, product_id string, split string"
ANNOTATION_SCHEMA = "id bigint, image_id bigint, category_id int, bbox array<double>, area double, iscrowd int, split string"


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations joined to their images, with the category name."""
    images = spark.read.schema(IMAGE_SCHEMA).json(f"{path}/images")
    rows = spark.read.schema(ANNOTATION_SCHEMA).json(f"{path}/annotations")
    return coco_boxes(images, rows)


def coco_boxes(images: DataFrame, annotations: DataFrame) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in V.BOX_LABELS]), F.col("category_id"))
    meta = images.select(F.col("id").alias("image_id"), "file_name", "width", "height", "product_id")
    side = lambda i: F.get("bbox", F.lit(i))
    return annotations.join(meta, "image_id").select(
        "id", "image_id", "split", "file_name", "product_id", label.alias("label"),
        side(0).alias("x"), side(1).alias("y"), side(2).alias("w"), side(3).alias("h"), "area",
    )
