"""Detector data sets: pseudo labels, deduplication, splits, COCO rows, unions, review regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.boxes import Box, box, clipped, gaps, named, padded, union
from panelcheck.functions.expr import case_map
from panelcheck.functions.joins import cells, first_row, lookup_join, ranked, with_neighbours
from panelcheck.operators.extract.lines import rx, rx_cased
from panelcheck.operators.quality import valid_gtin

CELL = 512.0
BOX = ["x", "y", "w", "h"]


# ------------------------------------------------------------------ pseudo labels


def pseudo_label_candidates(lines: DataFrame) -> DataFrame:
    """Declarations with an explicit marker, from windows of a line and the two after it.

    Equal label and box of an image count once.
    """
    wanted = {f"n{k}_{c}": (c, k) for k in (1, 2) for c in ("text", *BOX)}
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    ctx = with_neighbours(lines, "source_image_id", "line_number", wanted)
    rows = ctx.withColumns({"t0": squeeze(F.col("text")), "t1": squeeze(F.col("n1_text")), "t2": squeeze(F.col("n2_text"))})
    rows = rows.withColumns({"upper": F.upper("t0"), "joined": F.concat_ws(" ", "t0", "t1", "t2")})
    marked = {k: F.col("upper").rlike(rx_cased(p)) for k, p in V.PSEUDO_MARKERS_CASED.items()}
    any_marker = None
    for c in marked.values():
        any_marker = c if any_marker is None else any_marker | c
    rows = rows.filter(any_marker)
    i = lambda c, p: F.coalesce(c.rlike(rx(p)), F.lit(False))
    cased = lambda c, p: F.coalesce(c.rlike(rx_cased(p)), F.lit(False))
    contact = lambda c: cased(c, V.PSEUDO_EMAIL_CASED) | cased(c, V.PSEUDO_PHONE_CASED)
    evidence = {
        "net_quantity": lambda c: i(c, V.PSEUDO_AMOUNT), "mrp": lambda c: i(c, V.PSEUDO_MONEY),
        "mfg_or_pkd_date": lambda c: i(c, V.PSEUDO_DATE), "consumer_care": contact,
    }
    entries = []
    for label, marker in marked.items():
        if label == "country_of_origin":
            hit = F.upper("joined").rlike(rx_cased(V.PSEUDO_COUNTRY_VALUE_CASED))
            keep1, keep2 = F.col("t1").isNotNull(), F.lit(False)
        else:
            hit = evidence[label](F.col("joined"))
            keep1, keep2 = evidence[label](F.col("t1")), evidence[label](F.col("t2"))
        entries.append(
            F.when(marker & hit, F.struct(F.lit(label).alias("label"), F.lit(V.PSEUDO_REASONS[label]).alias("reason"),
                                          keep1.alias("k1"), keep2.alias("k2")))
        )
    found = rows.select("*", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("c"))
    part = lambda k, c: F.when(F.col(f"c.k{k}"), F.col(f"n{k}_{c}"))
    left, top = F.least("x", part(1, "x"), part(2, "x")), F.least("y", part(1, "y"), part(2, "y"))
    right = F.greatest(F.col("x") + F.col("w"), *[part(k, "x") + part(k, "w") for k in (1, 2)])
    bottom = F.greatest(F.col("y") + F.col("h"), *[part(k, "y") + part(k, "h") for k in (1, 2)])
    r2 = lambda c: F.round(c, 2)
    shaped = found.select(
        "source_image_id", "line_number", F.col("c.label").alias("label"), F.col("c.reason").alias("reason"),
        r2(left).alias("x"), r2(top).alias("y"), r2(right - left).alias("w"), r2(bottom - top).alias("h"),
    )
    return first_row(shaped, ["source_image_id", "label", *BOX], [F.col("line_number"), F.col("reason")])


def corroborate(candidates: DataFrame, proposals: DataFrame) -> DataFrame:
    """The best-scored proposal of the same label whose padded box holds the candidate's centre.

    A centre lies in one grid cell, so each candidate meets only the proposals there.
    """
    pad = V.CORROBORATION_PADDING_PX
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    cell = F.struct(F.floor(cx / CELL).alias("cx"), F.floor(cy / CELL).alias("cy"))
    key = ["source_image_id", "label", *BOX]
    mine = candidates.select(*key, cell.alias("cell"))
    theirs = proposals.select(
        "source_image_id", "label", "score", *[F.col(c).alias("p_" + c) for c in BOX],
        F.explode(cells(*[F.col(c) for c in BOX], pad, pad, CELL)).alias("cell"),
    )
    wide = padded(box("p_"), pad)
    inside = (cx >= wide.x) & (cx <= wide.right) & (cy >= wide.y) & (cy <= wide.bottom)
    best = (
        mine.join(theirs, ["source_image_id", "label", "cell"])
        .filter(inside)
        .groupBy(*key)
        .agg(F.max(F.struct("score", *["p_" + c for c in BOX])).alias("best"))
    )
    return candidates.join(best, key, "left").select(
        *candidates.columns, F.col("best.score").alias("detector_score"), F.col("best").isNotNull().alias("corroborated")
    )


def pseudo_label_summary(candidates: DataFrame, proposals: DataFrame, images: DataFrame) -> DataFrame:
    """metric, label, value rows of a candidate run."""
    row = lambda df, metric, label, value: df.select(F.lit(metric).alias("metric"), label.alias("label"), value.alias("value"))
    n = F.count(F.lit(1))
    parts = [
        row(images.agg(n.alias("n")), "images_examined", F.lit(""), F.col("n")),
        row(candidates.agg(F.countDistinct("source_image_id").alias("n")), "images_with_candidates", F.lit(""), F.col("n")),
        row(candidates.groupBy("label").agg(n.alias("n")), "accepted_candidates", F.col("label"), F.col("n")),
        row(proposals.filter(F.col("label").isin(*V.DETECTOR_ONLY_REJECTED)).groupBy("label").agg(n.alias("n")),
            "detector_only_rejected", F.col("label"), F.col("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def filter_proposals(proposals: DataFrame, threshold: float) -> DataFrame:
    """Known labels at or above the threshold, clipped to the image; empty boxes drop out.

    ``proposals``: x1, y1, x2, y2 corners, score, label, width_px, height_px.
    """
    clip = lambda c, side: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(side).cast("double")))
    x1, x2, y1, y2 = clip("x1", "width_px"), clip("x2", "width_px"), clip("y1", "height_px"), clip("y2", "height_px")
    kept = proposals.filter((F.col("score") >= threshold) & F.col("label").isin(*V.BOX_LABELS) & (x2 > x1) & (y2 > y1))
    r = lambda c: F.round(c, 2)
    return kept.select(
        "source_image_id", "label", F.round("score", 5).alias("score"), r(x1).alias("x"), r(y1).alias("y"),
        r(x2 - x1).alias("w"), r(y2 - y1).alias("h"),
    )


def run_summary(requested: DataFrame, proposals: DataFrame, errors: DataFrame) -> DataFrame:
    """Counts of a detector run; failed images are rows, not a failed job."""
    row = lambda df, metric, label: df.select(F.lit(metric).alias("metric"), label.alias("label"), F.col("n").alias("value"))
    n = F.count(F.lit(1)).alias("n")
    done = requested.join(errors.select("source_image_id"), "source_image_id", "left_anti")
    return (
        row(requested.agg(n), "images_requested", F.lit(""))
        .unionByName(row(done.agg(n), "images_completed", F.lit("")))
        .unionByName(row(errors.groupBy("error").agg(n), "errors", F.col("error")))
        .unionByName(row(proposals.groupBy("label").agg(n), "proposals", F.col("label")))
    )


# ------------------------------------------------------------------ manifests and splits


def dedup_manifest(files: DataFrame, min_side: int = 600) -> DataFrame:
    """Decision and reason per file: the first large enough file of equal bytes is the one kept.

    ``files``: source, width, height, sha256 (null where unreadable).
    """
    short = F.least("width", "height")
    readable = files.filter("sha256 IS NOT NULL")
    canon = readable.groupBy("sha256").agg(
        F.min(F.when(short >= min_side, F.col("source"))).alias("canonical")
    )
    rows = files.join(canon, "sha256", "left").withColumn("short_side", short)
    reason = (
        F.when(F.col("sha256").isNull(), "unreadable_image")
        .when(F.col("source") == F.col("canonical"), "meets_round1_quality_gate")
        .when(F.col("short_side") < min_side, f"short_side_under_{min_side}px")
        .otherwise("exact_duplicate")
    )
    return rows.withColumn("reason", reason).select(
        "source", "width", "height", "short_side", "sha256",
        F.when(F.col("reason") == "meets_round1_quality_gate", "eligible").otherwise("excluded").alias("decision"), "reason",
        F.when(F.col("reason") == "exact_duplicate", F.col("canonical")).alias("duplicate_of"),
    )


def product_split(products: DataFrame, n: int) -> DataFrame:
    """Products ordered by the hash of their name: the first n are validation.

    Finding the n-th hash is a top-n, so no product list is ever sorted in one task.
    """
    hashed = products.select("product_id").distinct().withColumn("h", F.sha2("product_id", 256))
    limit = hashed.orderBy("h", "product_id").limit(n).agg(F.max(F.struct("h", "product_id")).alias("m")).select("m").scalar()
    key = F.struct("h", "product_id")
    return hashed.select("product_id", F.when(key <= limit, "validation").otherwise("train").alias("split"))


def to_coco(regions: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """COCO image and annotation rows with dense ids.

    ``regions``: task_seq (order of the export), product_id, filename, label,
    region_seq, x, y, width, height in percent, original_width, original_height.
    Ids number the rows block by block of the export order.
    """
    category = case_map(F.col("label"), {x: i for i, x in enumerate(V.BOX_LABELS, 1)})
    known = regions.withColumn("category_id", category).filter("category_id IS NOT NULL")
    first = first_row(known, ["task_seq"], [F.col("region_seq")], ["product_id", "filename", "original_width", "original_height"])
    block = F.floor(F.col("task_seq") / 4096)
    numbered = ranked(first.withColumn("_all", F.lit(1)), ["_all"], block, [F.col("task_seq")], "id").drop("_all")
    images = lookup_join(numbered, split, ["product_id"], "inner").select(
        "id", F.concat_ws("/", "product_id", "filename").alias("file_name"),
        F.col("original_width").alias("width"), F.col("original_height").alias("height"), "product_id", "split", "task_seq",
    )
    boxes = ranked(known.withColumn("_all", F.lit(1)), ["_all"], block, [F.col("task_seq"), F.col("region_seq")], "id").drop("_all")
    meta = images.select("task_seq", F.col("id").alias("image_id"), F.col("width").alias("iw"), F.col("height").alias("ih"), "split")
    px = lambda c, side: F.col(side) * F.col(c) / 100
    w, h = px("width", "iw"), px("height", "ih")
    annotations = boxes.join(meta, "task_seq").select(
        "id", "image_id", "category_id", F.array(px("x", "iw"), px("y", "ih"), w, h).alias("bbox"), (w * h).alias("area"),
        F.lit(0).alias("iscrowd"), "split",
    )
    return images.drop("task_seq"), annotations


def build_training_union(trusted_images, trusted_boxes, pseudo_images, pseudo_boxes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, manifest): trusted plus pseudo training data, validation frozen.

    Image tables: id, file_name, split; box tables: id, image_id, category_id,
    x, y, w, h.  Pseudo images without a box drop out; pseudo ids follow the
    trusted training ids.
    """
    train, frozen = trusted_images.filter("split = 'train'"), trusted_images.filter("split = 'validation'")
    used = pseudo_images.join(pseudo_boxes.select(F.col("image_id").alias("id")), "id", "left_semi")
    tag = lambda df, source, provenance: df.withColumn("source", F.lit(source)).withColumn("provenance", F.lit(provenance))
    pool = tag(train.withColumn("split", F.lit("train")), 0, "trusted").unionByName(
        tag(used.withColumn("split", F.lit("train")), 1, "pseudo_candidate"), allowMissingColumns=True
    ).unionByName(tag(frozen, 0, "trusted_frozen_validation"), allowMissingColumns=True)
    by = [F.col("source"), F.col("id")]
    slot = F.struct("source", F.floor(F.col("id") / 4096).alias("b"))
    images = ranked(pool, ["split"], slot, by, "new_id")
    owner = images.select(F.col("source"), F.col("id").alias("image_id"), "split", "provenance", F.col("new_id").alias("new_image_id"))
    boxes = trusted_boxes.withColumn("source", F.lit(0)).unionByName(pseudo_boxes.withColumn("source", F.lit(1)), allowMissingColumns=True)
    owned = boxes.join(owner, ["source", "image_id"])
    order = [F.col("source"), F.col("new_image_id"), F.col("id")]
    numbered = ranked(owned, ["split"], F.struct("source", F.floor(F.col("new_image_id") / 4096).alias("b")), order, "new_id")
    annotations = numbered.select(
        F.col("new_id").alias("id"), F.col("new_image_id").alias("image_id"), "category_id", *BOX,
        F.when(F.col("source") == 1, F.round(F.col("w") * F.col("h"), 2)).otherwise(F.col("w") * F.col("h")).alias("area"), "split", "provenance",
    )
    count = lambda df, kind: df.groupBy("provenance").agg(F.count(F.lit(1)).alias("value")).select(F.lit(kind).alias("kind"), "provenance", "value")
    manifest = count(images, "images").unionByName(count(annotations, "boxes"))
    out = images.select(F.col("new_id").alias("id"), "file_name", "split", "provenance")
    return out, annotations, manifest


# ------------------------------------------------------------------ field blocks

def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?iU)[a-z0-9]+"), 0))


def block_candidates(declarations: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that may belong to a declaration: its label's pattern or shared words, and the same orientation.

    ``declarations``: declaration_id, source_image_id, label, raw_text and the anchor box.  A declaration meets only the lines of its image that
    share a key with it: a label whose pattern the line matches, or a word.  ``place`` numbers the lines of an image, also equal ones.
    """
    wide = (F.col("w") >= F.col("h")).alias("wide")
    label_key, word_key = (lambda c: F.concat(F.lit("label "), c)), (lambda c: F.concat(F.lit("word "), c))
    asked = F.array_compact(F.array_append(F.transform(_words(F.col("raw_text")), word_key), label_key(F.col("label"))))
    d = declarations.select("declaration_id", "source_image_id", *[F.col(c).alias("a_" + c) for c in BOX], wide, F.explode(asked).alias("key"))
    matched = [F.when(F.col("text").rlike(rx(p)), label_key(F.lit(name))) for name, p in V.LINE_PATTERNS.items()]
    place = F.row_number().over(W.partitionBy("source_image_id").orderBy("line_number", *BOX, "text", "confidence"))
    placed = lines.withColumn("place", place).withColumn("n_words", F.size(_words(F.col("text"))))
    line = F.struct(F.col("place").cast("bigint").alias("place"), F.col("line_number").cast("bigint").alias("line_number"), "text", "confidence", *BOX)
    has = F.concat(F.transform(_words(F.col("text")), word_key), F.array_compact(F.array(*matched)))
    keyed = placed.select("source_image_id", wide, "n_words", line.alias("line"), F.explode(has).alias("key"))
    of_label = F.col("key").startswith("label ")
    pairs = (
        d.join(keyed, ["source_image_id", "wide", "key"]).repartition("declaration_id")
        .groupBy("declaration_id", *["a_" + c for c in BOX], "line", "n_words").agg(F.bool_or(of_label).alias("labelled"), F.count_if(~of_label).alias("shared"))
    )
    return pairs.filter(F.col("labelled") | (F.col("shared") >= F.least(F.lit(2), F.col("n_words")))).drop("labelled", "shared", "n_words")


_LINE = "struct<place:bigint,line_number:bigint,text:string,confidence:double,x:double,y:double,w:double,h:double>"


def connected_lines(declarations: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of each declaration's block in the order they join it.

    The block repeatedly takes the nearest line within reach of its grown box, the first by ``place`` of equally near ones.
    That is sequential inside one declaration, over the lines of its image
    that match its label or words, and runs as a fold in the JVM.
    """
    groups = (
        block_candidates(declarations, lines)
        .groupBy("declaration_id", *["a_" + c for c in BOX])
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
    )
    none = F.array().cast(f"array<{_LINE}>")
    start = F.struct(
        F.col("a_x").alias("x"), F.col("a_y").alias("y"), (F.col("a_x") + F.col("a_w")).alias("r"), (F.col("a_y") + F.col("a_h")).alias("b"),
        F.col("lines").cast(f"array<{_LINE}>").alias("rest"), none.alias("picked"),
    )

    def grow(s: Column, _: Column) -> Column:
        def reach(e: Column) -> Column:
            dx = F.greatest(s["x"] - (e["x"] + e["w"]), e["x"] - s["r"], F.lit(0.0))
            dy = F.greatest(s["y"] - (e["y"] + e["h"]), e["y"] - s["b"], F.lit(0.0))
            far = F.hypot(dx, dy)
            ok = (dx <= V.BLOCK_GAP_PX) & (dy <= V.BLOCK_GAP_PX) & (far <= V.BLOCK_DIAGONAL_PX)
            return F.when(ok, F.struct(far.alias("far"), e["place"].alias("n")))

        at = F.array_min(F.filter(F.transform(s["rest"], reach), lambda e: e.isNotNull()))["n"]
        taken = F.filter(s["rest"], lambda e: e["place"] == at)
        t = F.get(taken, 0)
        grown = F.struct(
            F.least(s["x"], t["x"]).alias("x"), F.least(s["y"], t["y"]).alias("y"), F.greatest(s["r"], t["x"] + t["w"]).alias("r"),
            F.greatest(s["b"], t["y"] + t["h"]).alias("b"), F.filter(s["rest"], lambda e: e["place"] != at).alias("rest"),
            F.concat(s["picked"], taken).alias("picked"),
        )
        return F.when(at.isNull(), s).otherwise(grown)

    picked = F.aggregate(F.sequence(F.lit(1), F.size("lines")), start, grow)["picked"]
    return groups.select("declaration_id", F.posexplode(picked).alias("pos", "l")).select(
        "declaration_id", (F.col("pos") + 1).alias("pick"), "l.*"
    ).drop("place")


def declaration_evidence(declarations: DataFrame, block: DataFrame) -> DataFrame:
    """Padded box, transcript without repeats and mean confidence of each declaration."""
    text = F.trim("text")
    lines = block.withColumn("text", text).withColumn("key", F.lower(F.regexp_replace("text", r"(?U)\s+", " ")))
    kept = first_row(lines.filter("text <> ''"), ["declaration_id", "key"], [F.col("pick")], ["pick", "text"])
    script = kept.groupBy("declaration_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pick", "text"))), lambda e: e["text"]), "\n").alias("script")
    )
    shape = block.groupBy("declaration_id").agg(
        F.min("x").alias("g_x"), F.min("y").alias("g_y"), F.max(F.col("x") + F.col("w")).alias("g_r"),
        F.max(F.col("y") + F.col("h")).alias("g_b"), F.round(F.avg("confidence"), 4).alias("mean"),
    )
    rows = declarations.join(shape, "declaration_id", "left").join(script, "declaration_id", "left")
    anchor = box()
    grown = union(anchor, Box(F.col("g_x"), F.col("g_y"), F.col("g_r") - F.col("g_x"), F.col("g_b") - F.col("g_y")))
    has = F.col("mean").isNotNull()
    full = padded(Box(*[F.when(has, g).otherwise(a) for g, a in zip(grown, anchor)]), V.BLOCK_PADDING_PX)
    return rows.select(
        "declaration_id", "source_image_id", "label", F.coalesce("script", "raw_text").alias("text"),
        F.coalesce("mean", "confidence").alias("confidence"), *named(full),
    )


def barcode_evidence(barcodes: DataFrame, lines: DataFrame) -> DataFrame:
    """The barcode box with the nearest printed, valid digit line beside it.

    ``barcodes``: source_image_id, barcode_data, x, y, w, h.
    """
    digits = lines.filter(F.length(F.regexp_replace("text", r"[\s-]", "")).between(8, 14)).filter(valid_gtin(F.col("text")))
    theirs = digits.select("source_image_id", "line_number", F.col("text").alias("l_text"), *[F.col(c).alias("l_" + c) for c in BOX])
    _, _, far = gaps(box(), box("l_"))
    near = (
        barcodes.join(theirs, "source_image_id")
        .withColumn("far", far)
        .filter(F.col("far") <= V.BLOCK_DIAGONAL_PX)
        .groupBy("source_image_id", *BOX)
        .agg(F.min(F.struct("far", "line_number", "l_text", *["l_" + c for c in BOX])).alias("n"))
    )
    rows = barcodes.join(near, ["source_image_id", *BOX], "left")
    seen = F.col("n").isNotNull()
    printed = Box(*[F.col("n.l_" + c) for c in BOX])
    full = padded(Box(*[F.when(seen, u).otherwise(a) for u, a in zip(union(box(), printed), box())]), V.BLOCK_PADDING_PX)
    code = F.coalesce(
        F.nullif(F.regexp_replace(F.col("n.l_text"), r"[\s-]", ""), F.lit("")), F.nullif(F.trim("barcode_data"), F.lit("")), F.lit("unreadable")
    )
    return rows.select("source_image_id", code.alias("text"), *named(full))


def clean_suggestions(regions: DataFrame) -> DataFrame:
    """Drop suggestions a reviewer should not see, with their child rows.

    ``regions``: region_id, parent_id, type, label, text.
    """
    texts = regions.filter("type = 'textarea'").groupBy(F.col("parent_id").alias("region_id")).agg(F.max("text").alias("said"))
    boxes = regions.filter("type = 'rectanglelabels'").select("region_id", "label").join(texts, "region_id", "left")
    said = F.coalesce("said", F.lit(""))
    bad = boxes.filter(
        ((F.col("label") == "product_name") & said.rlike(rx(V.NAME_REJECT))) | ((F.col("label") == "barcode") & ~valid_gtin(F.trim(said)))
    ).select("region_id")
    return regions.join(bad, "region_id", "left_anti").join(bad.select(F.col("region_id").alias("parent_id")), "parent_id", "left_anti").select(
        *regions.columns
    )


def review_regions(evidence: DataFrame, images: DataFrame) -> DataFrame:
    """Three rows per suggestion: rectangle in percent, transcription, readability.

    ``evidence``: declaration_id, source_image_id, label, text, confidence and
    box; ``images``: source_image_id, width_px, height_px.
    """
    rows = evidence.join(images, "source_image_id")
    w, h = F.col("width_px").cast("double"), F.col("height_px").cast("double")
    inside = clipped(box(), w, h)
    rows = rows.select("*", *[c.alias("c_" + n) for n, c in zip(BOX, inside)]).filter("c_w IS NOT NULL")
    pct = lambda c, side: F.round(F.col("c_" + c) * 100 / side, 4)
    null = F.lit(None)
    kinds = F.array(
        F.struct(F.lit("rectanglelabels").alias("type"), F.col("label").alias("value")),
        F.struct(F.lit("textarea").alias("type"), F.coalesce(F.nullif("text", F.lit("")), F.lit("unreadable")).alias("value")),
        F.struct(F.lit("choices").alias("type"), F.when(F.col("confidence") >= 0.85, "clear").otherwise("partly_obscured").alias("value")),
    )
    flat = rows.select(
        "declaration_id", "source_image_id", "width_px", "height_px", pct("x", w).alias("x"), pct("y", h).alias("y"),
        pct("w", w).alias("width"), pct("h", h).alias("height"), F.inline(kinds),
    )
    is_box = F.col("type") == "rectanglelabels"
    return flat.select(
        "declaration_id", "source_image_id", "type", "value", F.when(~is_box, F.col("declaration_id")).otherwise(null).alias("parent_id"),
        *[F.when(is_box, F.col(c)).alias(c) for c in ("x", "y", "width", "height")],
    )


def prediction_statistics(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Suggestions, recognised lines and mean confidence per image."""
    made = regions.filter("type = 'rectanglelabels'").groupBy("source_image_id").agg(F.count(F.lit(1)).alias("suggestions"))
    seen = lines.groupBy("source_image_id").agg(F.count(F.lit(1)).alias("ocr_line_count"), F.round(F.avg("confidence"), 4).alias("score"))
    return seen.join(made, "source_image_id", "left").withColumn("suggestions", F.coalesce("suggestions", F.lit(0).cast("bigint")))
