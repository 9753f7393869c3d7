"""Recognition results: words to lines, summaries, choice between engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcheck.functions.joins import ranked

LINE = ["source_image_id", "block_num", "par_num", "line_num"]


def words_to_lines(words: DataFrame) -> DataFrame:
    """Lines from word boxes, numbered in order of their first word.

    ``words``: image, block, paragraph and line numbers, word_seq, text,
    confidence in percent, left, top, width, height.
    """
    conf = F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(-1.0))
    kept = words.withColumn("word", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).withColumn("conf", conf).filter(
        (F.col("word") != "") & (F.col("conf") >= 0)
    )
    # one printed line of words
    lines = kept.groupBy(*LINE).agg(
        F.min("word_seq").alias("first_word"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_seq", "word"))), lambda w: w["word"]), " ").alias("text"),
        F.round(F.avg(F.col("conf") / 100.0), 4).alias("confidence"),
        F.min("left").cast("double").alias("x"), F.min("top").cast("double").alias("y"),
        F.max(F.col("left") + F.col("width")).cast("double").alias("right"),
        F.max(F.col("top") + F.col("height")).cast("double").alias("bottom"),
    )
    boxed = lines.select(
        "source_image_id", "first_word", "text", "confidence", "x", "y",
        (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"),
    )
    return ranked(boxed, ["source_image_id"], F.floor(F.col("first_word") / 4096), [F.col("first_word")], "line_number").drop("first_word")


def ocr_summary(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean confidence, line count and full text per image."""
    keys = keys or ["source_image_id"]
    return lines.groupBy(*keys).agg(
        F.round(F.avg("confidence"), 4).alias("average_confidence"),
        F.count(F.lit(1)).alias("line_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "text"))), lambda e: e["text"]), "\n").alias("full_text"),
    )


def _mean(lines: DataFrame, name: str) -> DataFrame:
    return lines.groupBy("source_image_id").agg(F.round(F.avg("confidence"), 4).alias(name))


def engine_choice(primary: DataFrame, fallback: DataFrame, minimum: float = 0.60) -> DataFrame:
    """Which engine's result an image keeps."""
    both = _mean(primary, "p").join(_mean(fallback, "f"), "source_image_id", "full_outer")
    p, f = F.col("p"), F.col("f")
    choice = (
        F.when(p >= minimum, "primary").when(f.isNull(), "primary").when(p.isNotNull() & (p > f), "primary").otherwise("fallback")
    )
    return both.select("source_image_id", choice.alias("choice"))


def choose_ocr_result(primary: DataFrame, fallback: DataFrame, minimum: float = 0.60) -> DataFrame:
    """The lines of the chosen engine per image.

    The primary engine wins if its mean reaches ``minimum``; otherwise the
    better one, the fallback on a tie.
    """
    choice = engine_choice(primary, fallback, minimum)
    keep = lambda df, name: df.join(choice.filter(F.col("choice") == name), "source_image_id", "left_semi").withColumn(
        "chosen", F.lit(name)
    )
    return keep(primary, "primary").unionByName(keep(fallback, "fallback"))
