"""File-level sources and sinks: written snapshots, image inventory, task lists, data URLs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcheck.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has written yet, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_json(spark: SparkSession, df: DataFrame, name: str) -> str:
    folder = new_folder(spark, name)
    df.write.json(folder)
    return folder


def written_parquet(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back, which cuts lineage and survives executor loss."""
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def data_url_extension(url: Column) -> Column:
    header = F.substring_index(url, ",", 1)
    return F.when(header.contains("image/png"), "png").when(header.contains("image/webp"), "webp").otherwise("jpg")


def decode_data_urls(df: DataFrame, column: str) -> DataFrame:
    """Adds extension, content and sha256; a text without a comma is not a data URL and gives nulls."""
    url = F.col(column)
    body = F.expr(f"substring(`{column}`, instr(`{column}`, ',') + 1)")
    valid = url.contains(",")
    return (
        df.withColumn("extension", F.when(valid, data_url_extension(url)))
        .withColumn("content", F.when(valid, F.try_to_binary(body, F.lit("base64"))))
        .withColumn("sha256_hash", F.sha2("content", 256))
    )


def image_inventory(spark: SparkSession, *folders: str) -> DataFrame:
    """path, size and byte hash of every file; bytes never leave the task that read them.

    The driver lists the files of a read.  Several folders are read one after another and what is found is written,
    so it holds the list of one folder at a time.
    """

    def found(folder: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

    if len(folders) == 1:
        return found(folders[0])
    inventory = new_folder(spark, "inventory")
    for folder in folders:
        found(folder).write.mode("append").parquet(inventory)
    return spark.read.parquet(inventory)


def tasks_from_inventory(files: DataFrame, root: str) -> DataFrame:
    """Annotation tasks from an image tree ``root/<sample>/<file>``; the role comes from the name."""
    rel = F.regexp_extract("path", r".*?" + root.strip("/") + r"/([^/]+/[^/]+)$", 1)
    name = F.substring_index(rel, "/", -1)
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    role = (
        F.when(stem.startswith("front"), "front_pdp")
        .when(stem.startswith("back"), "back_panel")
        .when(stem.startswith("side"), "side_panel")
        .when(stem.startswith("mrp") | stem.startswith("sticker"), "sticker")
        .otherwise("other")
    )
    return files.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png)$") & (rel != "")).select(
        F.substring_index(rel, "/", 1).alias("sample_id"),
        name.alias("source_filename"),
        role.alias("image_role"),
        F.concat(F.lit(f"/data/local-files/?d={root.strip('/')}/"), rel).alias("image"),
    )
