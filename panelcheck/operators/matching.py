"""Matching of predicted boxes to reviewed boxes, and the metrics on top.

Candidate pairs come from grid cells, so boxes far apart never meet.  The greedy rule lets reviewed boxes choose in order: the
candidates of a group are sorted by chooser and pass one by one, and a task keeps only the targets taken so far.  A crowded group is cut
first where nothing overlaps the cut, so that its separate parts are settled by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcheck import fixed_values as V
from panelcheck.functions.boxes import box, inside_ratio, iou
from panelcheck.functions.joins import cells, literal_rows

GROUP = ["task_id", "label"]
CELL = 25.0
CROWD = 1024  # boxes of a group from which it is cut into parts; the choice is the same either way
STEP = 0.5  # possible cuts, in the unit of the boxes


def _in_cells(df: DataFrame, w: str, h: str, size: float) -> DataFrame:
    return df.withColumn("cell", F.explode(cells(F.col("x"), F.col("y"), F.col(w), F.col(h), 0.0, 0.0, size)))


def overlapping_pairs(a: DataFrame, b: DataFrame, threshold: float, size: float = CELL) -> DataFrame:
    """Pairs of one task and label with IoU at or above the threshold: a_id, b_id, iou.

    Each pair is found once: in the cell of the top left corner of its overlap.
    """
    columns = [*GROUP, "box_id", "x", "y", "width", "height"]
    rename = lambda df, p: df.select(
        *GROUP, "cell", *[F.col(c).alias(p + c) for c in columns if c not in GROUP]
    )
    left = rename(_in_cells(a.select(*columns), "width", "height", size), "a_")
    right = rename(_in_cells(b.select(*columns), "width", "height", size), "b_")
    at = lambda c: F.floor(F.greatest("a_" + c, "b_" + c) / size)
    score = iou(box("a_", "width", "height"), box("b_", "width", "height"))
    return (
        left.join(right, [*GROUP, "cell"])
        .filter((F.col("cell.cx") == at("x")) & (F.col("cell.cy") == at("y")))
        .withColumn("iou", score)
        .filter(F.col("iou") >= threshold)
        .select(*GROUP, F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), "iou")
    )


def _cut_at(boxes: DataFrame, keys: list[str], start: str, size: str, part: str) -> DataFrame:
    """(keys, cut, part): numbers the stretches along one axis that no box reaches across.  ``cut`` is the step in which a box starts."""
    cuts = boxes.groupBy(*keys, F.floor(F.col(start) / STEP).alias("cut")).agg(F.max(F.col(start) + F.col(size)).alias("end"))
    along = W.partitionBy(*keys).orderBy("cut")
    reached = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    marked = cuts.select(*keys, "cut", F.when(reached > F.col("cut") * STEP, 0).otherwise(1).alias("new"))
    return marked.select(*keys, "cut", F.sum("new").over(along).alias(part))


def parts_of_crowds(choosers: DataFrame, targets: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(task_id, label, chooser, part_x, part_y) of the choosers in crowded groups; boxes of different parts do not overlap.

    Boxes are reduced to one row per step before a group is gone through in order.
    """
    columns = [*GROUP, "box_id", "x", "y", "width", "height"]
    boxes = choosers.select(*columns, F.lit(True).alias("chooses")).unionByName(targets.select(*columns, F.lit(False).alias("chooses")))
    crowded = boxes.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select(*GROUP)
    inside = boxes.join(crowded, GROUP, "left_semi")
    for start, size, keys, part in (("x", "width", GROUP, "part_x"), ("y", "height", [*GROUP, "part_x"], "part_y")):
        cuts = _cut_at(inside, keys, start, size, part)
        inside = inside.withColumn("cut", F.floor(F.col(start) / STEP)).join(cuts, [*keys, "cut"]).drop("cut")
    return inside.filter("chooses").select(*GROUP, F.col("box_id").alias("chooser"), "part_x", "part_y")


def serial_choice(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``edges``: task_id, label, chooser, target, iou, rank (lower is better, unique per chooser); ``parts``: see parts_of_crowds.

    Choosers in order take their best free target.
    """
    keys = [*GROUP, "part_x", "part_y"]
    cut = edges.join(parts, [*GROUP, "chooser"], "left") if parts is not None else edges.withColumns({k: F.lit(None).cast("bigint") for k in keys[2:]})
    ordered = cut.repartition(*keys).sortWithinPartitions(*keys, "chooser", "rank").select(*keys, "chooser", "target", "iou")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = chooser = None
        taken: set = set()
        served = False
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows of one chooser stand together: stretches without a change in any key
            ends = np.unique(np.concatenate([pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in (*keys, "chooser")])).tolist()
            targets, chosen, lo = batch.column("target").to_pylist(), [], 0
            for hi in ends:
                g, c = tuple(batch.column(k)[lo].as_py() for k in keys), batch.column("chooser")[lo].as_py()
                if g != group:
                    group, chooser, taken, served = g, c, set(), False
                elif c != chooser:
                    chooser, served = c, False
                if not served:
                    i = next((i for i in range(lo, hi) if targets[i] not in taken), None)
                    if i is not None:
                        taken.add(targets[i])
                        served = True
                        chosen.append(i)
                lo = hi
            yield batch.take(pa.array(chosen, pa.int64())).select([*GROUP, "chooser", "target", "iou"])

    out = ordered.select(*GROUP, "chooser", "target", "iou")
    return ordered.mapInArrow(choose, out.schema)


def match_regions(truth: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Reviewed boxes in order take the best free prediction; of equal ones the later prediction."""
    pairs = overlapping_pairs(truth, predictions, threshold)
    edges = pairs.select(
        *GROUP, F.col("a_id").alias("chooser"), F.col("b_id").alias("target"), "iou",
        F.struct((-F.col("iou")).alias("i"), (-F.col("b_id")).alias("b")).alias("rank"),
    )
    return serial_choice(edges, parts_of_crowds(truth, predictions)).select(*GROUP, F.col("chooser").alias("truth_id"), F.col("target").alias("prediction_id"), "iou")


def outcomes(truth: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Every box as tp, fn or fp."""
    t = truth.select(*GROUP, F.col("box_id").alias("truth_id")).join(matches.select(*GROUP, "truth_id", F.lit(True).alias("m")), [*GROUP, "truth_id"], "left")
    p = predictions.select(*GROUP, F.col("box_id").alias("prediction_id")).join(
        matches.select(*GROUP, "prediction_id"), [*GROUP, "prediction_id"], "left_anti"
    )
    return t.select(*GROUP, F.when(F.col("m"), "tp").otherwise("fn").alias("outcome")).unionByName(
        p.select(*GROUP, F.lit("fp").alias("outcome"))
    )


def detection_metrics(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1 per label and overall; null where nothing defines them."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    counted = rows.rollup("label").agg(
        F.grouping("label").alias("g"), n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn")
    ).select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("label")).alias("label"), "tp", "fp", "fn")
    listed = literal_rows(rows.sparkSession, [*sorted(labels or V.BOX_LABELS), "(all)"], "label")
    tp, fp, fn = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("tp", "fp", "fn"))
    full = listed.join(counted, "label", "left").select("label", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    div = lambda a, b: F.when(b > 0, a / b)
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return full.select(
        "label", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)), 4).alias("f1"),
    )


def mismatches(rows: DataFrame) -> DataFrame:
    """Missing and extra labels with their counts per task that has any."""
    return (
        rows.filter("outcome <> 'tp'").groupBy("task_id", F.when(F.col("outcome") == "fn", "missing").otherwise("extra").alias("kind"), "label")
        .agg(F.count(F.lit(1)).alias("boxes"))
    )


# ------------------------------------------------------------------ near duplicates


def near_duplicates(regions: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Pairs of boxes of one task and label that nearly coincide.

    Equal boxes are one geometry with a count, so a pile of copies costs one row;
    ``pairs`` says how many box pairs a row stands for.
    """
    shape = ["x", "y", "width", "height"]
    shapes = regions.groupBy(*GROUP, *shape).agg(F.count(F.lit(1)).alias("n"), F.min("box_id").alias("box_id"))
    found = overlapping_pairs(shapes, shapes, threshold).filter("a_id < b_id")
    counts = shapes.select(*GROUP, "box_id", "n")
    across = (
        found.join(counts.select(*GROUP, F.col("box_id").alias("a_id"), F.col("n").alias("na")), [*GROUP, "a_id"])
        .join(counts.select(*GROUP, F.col("box_id").alias("b_id"), F.col("n").alias("nb")), [*GROUP, "b_id"])
        .select(*GROUP, "a_id", "b_id", F.round("iou", 4).alias("iou"), (F.col("na") * F.col("nb")).alias("pairs"))
    )
    same = counts.filter("n > 1").select(
        *GROUP, F.col("box_id").alias("a_id"), F.col("box_id").alias("b_id"), F.lit(1.0).alias("iou"),
        F.expr("n * (n - 1) div 2").alias("pairs"),
    )
    return across.unionByName(same)


def near_duplicate_members(regions: DataFrame) -> DataFrame:
    """The box that stands for each box in ``near_duplicates``: of equal boxes the one with the smallest id."""
    shape = [*GROUP, "x", "y", "width", "height"]
    first = regions.groupBy(*shape).agg(F.min("box_id").alias("stands_for"))
    return regions.join(first, shape).select(*GROUP, "box_id", "stands_for")


# ------------------------------------------------------------------ recognition coverage


def ocr_coverage(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Each reviewed box with its best line: seen if half of the line lies inside.

    ``lines``: task_id, line_number, text, x, y, width, height in percent.  Boxes
    meet lines in shared grid cells only; equal line geometries count once.
    """
    shape = ["x", "y", "width", "height"]
    shapes = lines.groupBy("task_id", *shape).agg(F.min_by("text", "line_number").alias("text"), F.min("line_number").alias("line_number"))
    boxes = _in_cells(regions.select(*GROUP, "box_id", *shape), "width", "height", CELL)
    rows = _in_cells(shapes, "width", "height", CELL).select(
        "task_id", "cell", "text", "line_number", *[F.col(c).alias("l_" + c) for c in shape]
    )
    ratio = inside_ratio(box("", "width", "height"), box("l_", "width", "height"))
    best = (
        boxes.join(rows, ["task_id", "cell"])
        .groupBy(*GROUP, "box_id")
        .agg(F.max(F.struct(ratio.alias("ratio"), (-F.col("line_number")).alias("o"), "text")).alias("best"))
    )
    full = regions.select(*GROUP, "box_id").join(best, [*GROUP, "box_id"], "left")
    ratio_out = F.coalesce("best.ratio", F.lit(0.0))
    return full.select(
        *GROUP, "box_id", F.round(ratio_out, 4).alias("best_line_inside_ratio"), (ratio_out >= 0.5).alias("ocr_seen"),
        F.when(ratio_out > 0, F.col("best.text")).alias("best_line_text"),
    )


def coverage_by_label(coverage: DataFrame) -> DataFrame:
    seen = F.count_if("ocr_seen")
    return coverage.rollup("label").agg(
        F.grouping("label").alias("g"), F.count(F.lit(1)).alias("reviewed_boxes"), seen.alias("ocr_seen"),
        F.round(seen / F.count(F.lit(1)), 4).alias("ocr_line_coverage"),
    ).select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("label")).alias("label"), "reviewed_boxes", "ocr_seen", "ocr_line_coverage")


def extraction_gaps(coverage: DataFrame, truth: DataFrame, predictions: DataFrame, k: int = 12) -> DataFrame:
    """The first k boxes per label that recognition saw and nothing predicted."""
    hit = overlapping_pairs(truth, predictions, 0.5).select(*GROUP, F.col("a_id").alias("box_id"))
    open_ = coverage.filter("ocr_seen").join(hit, [*GROUP, "box_id"], "left_anti")
    return _first_k(open_, k)


def _first_k(rows: DataFrame, k: int) -> DataFrame:
    """The first k per label: cut inside 256 slices of a label first, so that no label is sorted as a whole."""
    parts = F.pmod(F.xxhash64("task_id"), F.lit(256))
    order = [F.col("task_id"), F.col("box_id")]
    local = rows.withColumn("_p", parts).withColumn("_r", F.row_number().over(W.partitionBy("label", "_p").orderBy(*order))).filter(F.col("_r") <= k)
    return (
        local.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(*order)))
        .filter(F.col("_r") <= k)
        .drop("_p", "_r")
    )


def coverage_reconcile(truth_tasks: DataFrame, run_tasks: DataFrame) -> DataFrame:
    """Tasks only one side has: missing from the run, or extra in it."""
    t = truth_tasks.select("task_id").distinct().withColumn("t", F.lit(True))
    r = run_tasks.select("task_id").distinct().withColumn("r", F.lit(True))
    both = t.join(r, "task_id", "full_outer")
    return both.filter("t IS NULL OR r IS NULL").select("task_id", F.when(F.col("r").isNull(), "missing").otherwise("extra").alias("problem"))


def coverage_comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two engines' coverage side by side, per label."""
    a = first.select("label", F.col("reviewed_boxes"), F.col("ocr_line_coverage").alias("first_coverage"))
    b = second.select("label", F.col("ocr_line_coverage").alias("second_coverage"))
    return a.join(b, "label", "left")


# ------------------------------------------------------------------ candidate calibration


def calibrate_candidates(candidates: DataFrame, truth: DataFrame, labels: list[str]) -> DataFrame:
    """Precision and recall of candidates per label with the gate for later use.

    Here candidates choose in order and only a strictly better box replaces a
    found one, so of equal boxes the first wins.
    """
    g = V.CALIBRATION_GATE
    kept = truth.filter(F.col("label").isin(*labels))
    pairs = overlapping_pairs(candidates, kept, g["iou"])
    edges = pairs.select(
        *GROUP, F.col("a_id").alias("chooser"), F.col("b_id").alias("target"), "iou",
        F.struct((-F.col("iou")).alias("i"), F.col("b_id").alias("b")).alias("rank"),
    )
    tp = serial_choice(edges, parts_of_crowds(candidates, kept)).groupBy("label").agg(F.count(F.lit(1)).alias("tp"))
    made = candidates.groupBy("label").agg(F.count(F.lit(1)).alias("made"))
    known = kept.groupBy("label").agg(F.count(F.lit(1)).alias("known"))
    listed = literal_rows(truth.sparkSession, sorted(labels), "label")
    zero = F.lit(0).cast("bigint")
    rows = listed.join(tp, "label", "left").join(made, "label", "left").join(known, "label", "left").select(
        "label", *[F.coalesce(c, zero).alias(c) for c in ("tp", "made", "known")]
    )
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(
        "label", "tp", (F.col("made") - F.col("tp")).alias("fp"), (F.col("known") - F.col("tp")).alias("fn"),
        F.round(div("tp", "made"), 4).alias("precision"), F.round(div("tp", "known"), 4).alias("recall"),
        ((div("tp", "made") >= g["precision"]) & (F.col("tp") >= g["true_positives"])).alias("eligible"),
    )
