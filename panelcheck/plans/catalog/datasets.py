"""Catalog: boxes, matching, recognition coverage and data sets."""

from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions import boxes as BX
from panelcheck.operators import datasets as D
from panelcheck.operators import matching as M
from panelcheck.plans.catalog.extraction import lines
from panelcheck.plans.catalog.registry import query
from panelcheck.plans.catalog.views import view, with_views
from panelcheck.sources import annotations as A
from panelcheck.sources.files import new_folder, written_json


def truth(f):
    return f.boxes().filter("src = 'truth'").drop("src")


def predictions(f):
    return f.boxes().filter("src = 'prediction'").drop("src")


def crowd(f):
    """Many boxes of one label per task, so that the greedy rule has real choices."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = f.base("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = rows.withColumn("src", F.explode(F.array(F.lit("truth"), F.lit("prediction"))))
    shift = F.when(F.col("src") == "prediction", F.col("p") % 5).otherwise(0)
    return rows.select(
        F.floor(o / 4).alias("task_id"), "src", (o % 4 * 10 + n).alias("box_id"), F.lit("mrp").alias("label"),
        (10.0 + n * 6 + o % 4 * 2 + shift).alias("x"), (20.0 + (o % 4) * 3).alias("y"), F.lit(20.0).alias("width"), F.lit(12.0).alias("height"),
    )


view("crowd", (), """SELECT l_orderkey // 4 AS task_id, src, l_orderkey % 4 * 10 + l_linenumber AS box_id, 'mrp' AS label,
 10.0e0 + l_linenumber * 6 + l_orderkey % 4 * 2 + CASE WHEN src = 'prediction' THEN p % 5 ELSE 0 END AS x, 20.0e0 + (l_orderkey % 4) * 3 AS y, 20.0e0 AS width, 12.0e0 AS height
 FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL) l CROSS JOIN (VALUES ('truth'), ('prediction')) s(src)""")
# overlap of the boxes a and b
_INTER = "greatest(0.0e0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0.0e0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"
# the choice itself, chooser by chooser: ``used`` are the targets taken so far
_CHOICE = """, e AS (SELECT a.task_id, a.label, a.box_id AS chooser, b.box_id AS target, {inter} / (a.width * a.height + b.width * b.height - {inter}) AS iou
  FROM crowd a JOIN crowd b ON a.task_id = b.task_id AND a.label = b.label WHERE a.src = '{chooser}' AND b.src = '{target}'),
 o AS (SELECT *, row_number() OVER (PARTITION BY task_id, label ORDER BY chooser) AS k
  FROM (SELECT task_id, label, chooser, list(struct_pack(target := target, iou := iou) ORDER BY iou DESC, target {ties}) AS offers FROM e WHERE iou >= 0.5e0 GROUP BY ALL) g),
 c AS (SELECT task_id, label, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS chooser, CAST([] AS BIGINT[]) AS used, CAST(NULL AS STRUCT(target BIGINT, iou DOUBLE)) AS pick FROM o GROUP BY ALL
  UNION ALL SELECT task_id, label, k, chooser, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.target) END, pick
  FROM (SELECT o.task_id, o.label, o.k, o.chooser, c.used, list_filter(o.offers, lambda x: NOT list_contains(c.used, x.target))[1] AS pick
   FROM c JOIN o ON o.task_id = c.task_id AND o.label = c.label AND o.k = c.k + 1) q)
"""


def with_choice(chooser: str, target: str, ties: str) -> str:
    return with_views("crowd").replace("WITH", "WITH RECURSIVE", 1) + _CHOICE.format(inter=_INTER, chooser=chooser, target=target, ties=ties)


view("truth", ("boxes",), "SELECT * FROM boxes WHERE src = 'truth'")
view("pred", ("boxes",), "SELECT * FROM boxes WHERE src = 'prediction'")
view("pairs", ("truth", "pred"), f"""SELECT a.task_id, a.label, a.box_id AS truth_id, b.box_id AS prediction_id, {_INTER} AS i,
 a.width * a.height + b.width * b.height AS s, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, a.width AS aw, a.height AS ah, b.width AS bw, b.height AS bh
 FROM truth a JOIN pred b ON a.task_id = b.task_id AND a.label = b.label""")


@query(
    "g1_box_functions",
    with_views("pairs")
    + """SELECT task_id, truth_id, prediction_id, round(i / (s - i), 6) AS iou, round(i / (bw * bh), 6) AS inside, least(ax, bx) AS ux, least(ay, b_y) AS uy,
 greatest(ax + aw, bx + bw) - least(ax, bx) AS uw, ax - 5 AS px, aw + 10 AS pw, greatest(ax - (bx + 25 + bw), bx + 25 - (ax + aw), 0) AS gap_x FROM pairs""",
)
def _(f):
    a = truth(f).select("task_id", "label", F.col("box_id").alias("truth_id"), *[F.col(c).alias("a_" + c) for c in ("x", "y", "width", "height")])
    b = predictions(f).select("task_id", "label", F.col("box_id").alias("prediction_id"), *[F.col(c).alias("b_" + c) for c in ("x", "y", "width", "height")])
    l, r = BX.box("a_", "width", "height"), BX.box("b_", "width", "height")
    u, p = BX.union(l, r), BX.padded(l, 5)
    away = BX.gaps(l, BX.Box(r.x + 25, r.y, r.w, r.h))
    return a.join(b, ["task_id", "label"]).select(
        "task_id", "truth_id", "prediction_id", F.round(BX.iou(l, r), 6).alias("iou"), F.round(BX.inside_ratio(l, r), 6).alias("inside"),
        u.x.alias("ux"), u.y.alias("uy"), u.w.alias("uw"), p.x.alias("px"), p.w.alias("pw"), away[0].alias("gap_x"),
    )


@query("g2_normalize_boxes")
def _(f):
    points = F.when(F.col("box_id") % 2 == 1, F.array(*[F.array(a, b) for a, b in (
        (F.col("x") + F.col("width"), F.col("y") + F.col("height")), (F.col("x"), F.col("y")),
        (F.col("x"), F.col("y") + F.col("height")), (F.col("x") + F.col("width"), F.col("y")))]))
    poly = BX.canonical_polygon(F.col("x"), F.col("y"), F.col("width"), F.col("height"), points)
    return truth(f).filter("width > 0 AND height > 0").select("task_id", "box_id", F.to_json(poly).alias("polygon"))


@query("g3_map_polygons")
def _(f):
    step = "struct<type:string,scale:double,matrix:array<double>>"
    steps = F.array(
        F.struct(F.lit("resize").alias("type"), F.lit(0.5).alias("scale"), F.lit(None).cast("array<double>").alias("matrix")),
        F.struct(F.lit("rotation").alias("type"), F.lit(1.0).alias("scale"), F.array(*[F.lit(v) for v in (0.8, -0.6, 5.0, 0.6, 0.8, -3.0)]).alias("matrix")),
        F.struct(F.lit("perspective").alias("type"), F.lit(1.0).alias("scale"),
                 F.array(*[F.lit(v) for v in (1.0, 0.1, 2.0, 0.05, 1.1, 1.0, 0.0005, 0.0002, 1.0)]).alias("matrix")),
    ).cast(f"array<{step}>")
    poly = BX.canonical_polygon(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(None).cast("array<array<double>>"))
    return truth(f).select("task_id", "box_id", F.to_json(BX.map_polygon(poly, steps, F.lit(1000), F.lit(800))).alias("polygon"))


@query(
    "g4_scaled_boxes_to_pixels",
    """SELECT o_orderkey AS id, x, y, greatest(1.0e0, least(640 - x, w)) AS w, greatest(1.0e0, least(480 - y, h)) AS h FROM (SELECT o_orderkey,
  greatest(0.0e0, least(639.0e0, round(least(x0, x1) / 1000.0e0 * 640, 1))) AS x, greatest(0.0e0, least(479.0e0, round(least(y0, y1) / 1000.0e0 * 480, 1))) AS y,
  greatest(1.0e0, round(abs(x1 - x0) / 1000.0e0 * 640, 1)) AS w, greatest(1.0e0, round(abs(y1 - y0) / 1000.0e0 * 480, 1)) AS h
  FROM (SELECT o_orderkey, least(1000.0e0, (o_custkey * 7) % 1100) AS x0, (o_orderkey * 13) % 1000 * 1.0e0 AS x1, greatest(0.0e0, (o_orderkey * 3) % 900 - 50) AS y0,
   (o_custkey * 11) % 1000 * 1.0e0 AS y1 FROM orders) a) b""",
)
def _(f):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.array(*[v.cast("double") for v in ((o * 3) % 900 - 50, (c * 7) % 1100, (c * 11) % 1000, (o * 13) % 1000)])
    return f.base("orders").select(o.alias("id"), BX.scaled_to_pixels(raw, F.lit(640), F.lit(480)).alias("b")).select("id", "b.*")


@query(
    "g5_percent_and_pixels",
    with_views("truth")
    + "SELECT task_id, box_id, 800 * x / 100 AS px, 600 * y / 100 AS py, round(100 * (800 * width / 100) / 800, 6) AS back FROM truth",
)
def _(f):
    b = BX.box("", "width", "height")
    p = BX.to_pixels(b, F.lit(800), F.lit(600))
    back = BX.to_percent(p, F.lit(800), F.lit(600))
    return truth(f).select("task_id", "box_id", p.x.alias("px"), p.y.alias("py"), F.round(back.w, 6).alias("back"))


# ------------------------------------------------------------------ annotation exports


def raw_tasks(f):
    """An annotation export made from the reviewed boxes; some of it is damaged on purpose."""
    t, b = F.col("task_id"), F.col("box_id")
    k = t + b
    value = F.struct(
        F.when(k % 17 == 0, 95.0).otherwise(F.col("x")).alias("x"), F.col("y"),
        F.when(k % 13 == 0, -1.0).otherwise(F.col("width")).alias("width"), F.col("height"),
        F.when(k % 11 == 0, F.array(F.lit("bogus"))).when(k % 19 == 0, F.array()).otherwise(F.array("label")).cast("array<string>").alias("rectanglelabels"),
    )
    item = F.struct(
        F.when(k % 23 == 0, "textarea").otherwise("rectanglelabels").alias("type"), F.lit(800).alias("original_width"), F.lit(600).alias("original_height"),
        value.alias("value"),
    )
    nested = truth(f).groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("box_id", item.alias("item")))), lambda e: e["item"]).alias("result"))
    note = lambda i, u, r: F.struct(F.lit(i).alias("id"), F.lit(u).alias("updated_at"), r.alias("result"))
    none = F.slice("result", 1, 0)
    notes = (
        F.when(t % 29 == 0, F.slice(F.array(note(1, "a", F.col("result"))), 1, 0))
        .when(t % 5 == 0, F.array(note(2, "2026-02-01", F.col("result")), note(9, "2026-01-01", none)))
        .otherwise(F.array(note(1, "2026-01-01", F.col("result"))))
    )
    key = F.when(t % 31 == 0, t - 1).otherwise(t)
    return nested.select(
        t.cast("bigint").alias("id"),
        F.struct(F.concat(F.lit("p"), (key % 97).cast("string")).alias("sample_id"), F.concat(key.cast("string"), F.lit(".jpg")).alias("source_filename")).alias("data"),
        notes.alias("annotations"),
    )


view("tasks", ("truth",), """SELECT DISTINCT task_id, CASE WHEN task_id % 31 = 0 THEN task_id - 1 ELSE task_id END AS key,
 CASE WHEN task_id % 29 = 0 THEN 0 WHEN task_id % 5 = 0 THEN 2 ELSE 1 END AS notes FROM truth""")
view("items", ("truth", "tasks"), """SELECT concat('p', key % 97) AS sample_id, concat(key, '.jpg') AS source_filename, box_id AS result_index,
 CASE WHEN k % 11 = 0 THEN 'bogus' WHEN k % 19 = 0 THEN NULL ELSE label END AS label, CASE WHEN k % 17 = 0 THEN 95.0e0 ELSE x END AS x, y,
 CASE WHEN k % 13 = 0 THEN -1.0e0 ELSE width END AS width, height,
 CASE WHEN k % 11 = 0 THEN 'unknown_label' WHEN k % 19 = 0 THEN 'invalid_label_payload' WHEN k % 13 = 0 THEN 'non_positive_geometry' WHEN k % 17 = 0 THEN 'out_of_bounds' END AS issue
 FROM (SELECT b.*, t.key, b.task_id + b.box_id AS k FROM truth b JOIN tasks t USING (task_id) WHERE t.notes > 0) q WHERE k % 23 <> 0""")


def tasks(f):
    return A.latest_annotation(raw_tasks(f))


@query(
    "s6_load_annotation_tasks",
    with_views("tasks", "truth")
    + """SELECT t.task_id AS task_row, concat('p', key % 97) AS sample_id, CAST(notes AS INT) AS annotation_count, CASE WHEN notes > 0 THEN CAST(b.n AS INT) END AS items
 FROM tasks t JOIN (SELECT task_id, count(*) AS n FROM truth GROUP BY 1) b USING (task_id)""",
)
def _(f):
    rows = A.load_annotation_tasks(f.spark, written_json(f.spark, raw_tasks(f), "tasks"))
    return rows.select("task_row", "sample_id", "annotation_count", F.size("result").alias("items")).withColumn(
        "items", F.when(F.col("items") >= 0, F.col("items"))
    )


@query(
    "g6_regions",
    with_views("items") + "SELECT sample_id, source_filename, CAST(result_index AS INT) AS result_index, label, x, y, width, height FROM items WHERE issue IS NULL",
)
def _(f):
    return A.regions_and_issues(tasks(f))[0].drop("original_width", "original_height")


@query(
    "g6_region_issues",
    with_views("items") + "SELECT sample_id, source_filename, CAST(result_index AS INT) AS result_index, label, issue FROM items WHERE issue IS NOT NULL",
)
def _(f):
    return A.regions_and_issues(tasks(f))[1]


@query(
    "g7_annotation_audit",
    with_views("tasks", "items")
    + """, k AS (SELECT *, concat('p', key % 97, '/', key, '.jpg') AS name FROM tasks)
 SELECT 'task_count' AS metric, '' AS key, count(*) AS value FROM k UNION ALL SELECT 'annotated_task_count', '', count(*) FILTER (WHERE notes > 0) FROM k
 UNION ALL SELECT 'annotation_count', '', CAST(sum(notes) AS BIGINT) FROM k UNION ALL SELECT 'box_count', '', count(*) FROM items WHERE issue IS NULL
 UNION ALL SELECT 'label_count', label, count(*) FROM items WHERE issue IS NULL GROUP BY label
 UNION ALL SELECT 'issue_count', issue, count(*) FROM items WHERE issue IS NOT NULL GROUP BY issue UNION ALL SELECT 'missing_task_key', '', 0
 UNION ALL SELECT 'missing_annotation', name, 1 FROM k WHERE notes = 0 UNION ALL SELECT 'multiple_annotations', name, 2 FROM k WHERE notes = 2
 UNION ALL SELECT 'duplicate_task_key', name, count(*) FROM k GROUP BY name HAVING count(*) > 1""",
)
def _(f):
    return A.annotation_audit(tasks(f))


@query(
    "s14_freeze_check",
    with_views("tasks")
    + """SELECT count(*) AS task_count, CAST(sum(notes) AS BIGINT) AS annotation_count, count(*) FILTER (WHERE notes = 0) AS unannotated,
 CASE WHEN count(*) FILTER (WHERE notes = 0) > 0 THEN 'unannotated_tasks' END AS problem FROM tasks""",
)
def _(f):
    expected = f.base("orders").count()
    return A.freeze_check(raw_tasks(f), expected).drop("content_digest")


view("dup_boxes", ("boxes",), "SELECT task_id // 8 AS task_id, label, task_id % 8 * 10 + box_id AS box_id, floor(x / 4) * 4 AS x, y, width, height FROM boxes WHERE src = 'truth'")


@query(
    "g8_near_duplicates",
    with_views("dup_boxes")
    + f""", s AS (SELECT task_id, label, x, y, width, height, count(*) AS n, min(box_id) AS box_id FROM dup_boxes GROUP BY ALL),
 p AS (SELECT a.task_id, a.label, a.box_id AS a_id, b.box_id AS b_id, {_INTER} AS i, a.width * a.height + b.width * b.height AS t, a.n * b.n AS pairs
  FROM s a JOIN s b ON a.task_id = b.task_id AND a.label = b.label AND a.box_id < b.box_id)
 SELECT task_id, label, a_id, b_id, round(i / (t - i), 4) AS iou, pairs FROM p WHERE i / (t - i) >= 0.5e0
 UNION ALL SELECT task_id, label, box_id, box_id, 1.0e0, CAST(n * (n - 1) // 2 AS BIGINT) FROM s WHERE n > 1""",
)
def _(f):
    t = F.col("task_id")
    rows = truth(f).select(
        F.floor(t / 8).alias("task_id"), "label", (t % 8 * 10 + F.col("box_id")).alias("box_id"), (F.floor(F.col("x") / 4) * 4).cast("double").alias("x"),
        "y", "width", "height",
    )
    return M.near_duplicates(rows, 0.5)


@query(
    "g8_near_duplicate_members",
    with_views("dup_boxes") + "SELECT task_id, label, box_id, min(box_id) OVER (PARTITION BY task_id, label, x, y, width, height) AS stands_for FROM dup_boxes",
)
def _(f):
    t = F.col("task_id")
    rows = truth(f).select(F.floor(t / 8).alias("task_id"), "label", (t % 8 * 10 + F.col("box_id")).alias("box_id"), (F.floor(F.col("x") / 4) * 4).cast("double").alias("x"), "y", "width", "height")
    return M.near_duplicate_members(rows)


# one box per task and label on each side, so a match is a pair at or above the threshold
view("matched", ("pairs",), "SELECT task_id, label, truth_id, prediction_id, i / (s - i) AS iou FROM pairs WHERE i / (s - i) >= 0.7e0")
view("outcome", ("truth", "pred", "matched"), """SELECT t.task_id, t.label, CASE WHEN m.truth_id IS NULL THEN 'fn' ELSE 'tp' END AS outcome
 FROM truth t LEFT JOIN matched m ON m.task_id = t.task_id AND m.label = t.label AND m.truth_id = t.box_id
 UNION ALL SELECT p.task_id, p.label, 'fp' FROM pred p LEFT JOIN matched m ON m.task_id = p.task_id AND m.label = p.label AND m.prediction_id = p.box_id WHERE m.truth_id IS NULL""")


@query("g9_match_regions", with_views("matched") + "SELECT task_id, label, truth_id, prediction_id, round(iou, 6) AS iou FROM matched")
def _(f):
    return M.match_regions(truth(f), predictions(f), 0.7).withColumn("iou", F.round("iou", 6))


@query("g9_match_regions_crowded", with_choice("truth", "prediction", "DESC") + "SELECT task_id, label, chooser AS truth_id, pick.target AS prediction_id, round(pick.iou, 6) AS iou FROM c WHERE pick IS NOT NULL")
def _(f):
    rows = crowd(f)
    return M.match_regions(rows.filter("src = 'truth'"), rows.filter("src = 'prediction'"), 0.5).withColumn("iou", F.round("iou", 6))


def outcomes(f):
    t, p = truth(f), predictions(f)
    return M.outcomes(t, p, M.match_regions(t, p, 0.7))


@query(
    "g10_detection_metrics",
    with_views("outcome")
    + """, c AS (SELECT label, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn
  FROM outcome GROUP BY 1 UNION ALL SELECT '(all)', count(*) FILTER (WHERE outcome = 'tp'), count(*) FILTER (WHERE outcome = 'fp'), count(*) FILTER (WHERE outcome = 'fn') FROM outcome),
 m AS (SELECT l.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT unnest(["""
    + ", ".join(f"'{x}'" for x in [*V.BOX_LABELS, "(all)"])
    + """]) AS label) l LEFT JOIN c ON c.label = l.label)
 SELECT label, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 4) AS f1
 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM m) q""",
)
def _(f):
    return M.detection_metrics(outcomes(f))


@query(
    "g11_mismatches",
    with_views("outcome")
    + "SELECT task_id, CASE WHEN outcome = 'fn' THEN 'missing' ELSE 'extra' END AS kind, label, count(*) AS boxes FROM outcome WHERE outcome <> 'tp' GROUP BY ALL",
)
def _(f):
    return M.mismatches(outcomes(f))


def percent_lines(f, shift=0):
    """Line boxes in percent from the predicted boxes, one text per box."""
    return predictions(f).select(
        "task_id", F.col("box_id").alias("line_number"), F.concat(F.lit("text "), F.col("box_id").cast("string")).alias("text"),
        (F.col("x") + 4 + shift).alias("x"), (F.col("y") - 3).alias("y"), F.lit(14.0).alias("width"), F.lit(12.0).alias("height"),
    )


view("percent_lines", ("pred",), "SELECT task_id, box_id AS line_number, concat('text ', box_id) AS text, x + 4 AS x, y - 3 AS y, 14.0e0 AS width, 12.0e0 AS height FROM pred")
_COVER = f"""SELECT a.task_id, a.label, a.box_id, {_INTER} / (b.width * b.height) AS ratio, b.line_number, b.text FROM truth a JOIN {{lines}} b ON a.task_id = b.task_id"""
view("coverage", ("truth", "percent_lines"), f"""SELECT t.task_id, t.label, t.box_id, coalesce(c.ratio, 0) AS ratio, CASE WHEN c.ratio > 0 THEN c.text END AS text
 FROM truth t LEFT JOIN (SELECT * FROM ({_COVER.format(lines='percent_lines')}) q QUALIFY row_number() OVER (PARTITION BY task_id, label, box_id ORDER BY ratio DESC, line_number) = 1) c
 ON c.task_id = t.task_id AND c.label = t.label AND c.box_id = t.box_id""")


@query(
    "g12_ocr_coverage",
    with_views("coverage")
    + "SELECT task_id, label, box_id, round(ratio, 4) AS best_line_inside_ratio, ratio >= 0.5e0 AS ocr_seen, text AS best_line_text FROM coverage",
)
def _(f):
    return M.ocr_coverage(truth(f), percent_lines(f))


_LABELS = "SELECT coalesce(label, '(all)') AS label, count(*) AS reviewed_boxes, count(*) FILTER (WHERE ratio >= 0.5e0) AS ocr_seen, round(count(*) FILTER (WHERE ratio >= 0.5e0) / count(*), 4) AS ocr_line_coverage FROM coverage GROUP BY ROLLUP (label)"


@query("g12_coverage_by_label", with_views("coverage") + _LABELS)
def _(f):
    return M.coverage_by_label(M.ocr_coverage(truth(f), percent_lines(f)))


@query(
    "g13_extraction_gaps",
    with_views("coverage", "pairs")
    + """SELECT task_id, label, box_id, round(ratio, 4) AS best_line_inside_ratio, text AS best_line_text FROM coverage c WHERE ratio >= 0.5e0
 AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.task_id = c.task_id AND p.label = c.label AND p.truth_id = c.box_id AND i / (s - i) >= 0.5e0)
 QUALIFY row_number() OVER (PARTITION BY label ORDER BY task_id, box_id) <= 12""",
)
def _(f):
    t = truth(f)
    return M.extraction_gaps(M.ocr_coverage(t, percent_lines(f)), t, predictions(f)).drop("ocr_seen")


@query(
    "g14_coverage_reconcile",
    with_views("truth", "pred")
    + """SELECT coalesce(t.task_id, r.task_id + 1) AS task_id, CASE WHEN r.task_id IS NULL THEN 'missing' ELSE 'extra' END AS problem
 FROM (SELECT DISTINCT task_id FROM truth) t FULL JOIN (SELECT DISTINCT task_id FROM pred WHERE task_id % 7 <> 0) r ON t.task_id = r.task_id + 1
 WHERE t.task_id IS NULL OR r.task_id IS NULL""",
)
def _(f):
    run = predictions(f).filter("task_id % 7 <> 0").select((F.col("task_id") + 1).alias("task_id"))
    return M.coverage_reconcile(truth(f), run)


@query("g14_coverage_comparison")
def _(f):
    first = M.coverage_by_label(M.ocr_coverage(truth(f), percent_lines(f)))
    second = M.coverage_by_label(M.ocr_coverage(truth(f), percent_lines(f, 5)))
    return M.coverage_comparison(first, second)


# ------------------------------------------------------------------ pseudo labels

_NEXT = "LEFT JOIN ocr_lines b ON b.source_image_id = a.source_image_id AND b.line_number = a.line_number + 1"
view("pseudo", ("ocr_lines",), f"""SELECT source_image_id, 0 AS line_number, 'net_quantity' AS label, 10.0e0 AS x, 0.0e0 AS y, 200.0e0 AS w, 55.0e0 AS h FROM ocr_lines WHERE line_number = 0 AND source_image_id % 3 <> 2
 UNION ALL SELECT source_image_id, 1, 'net_quantity', 10.0e0, 30.0e0, 200.0e0, 25.0e0 FROM ocr_lines WHERE line_number = 0 AND source_image_id % 3 <> 2
 UNION ALL SELECT source_image_id, 2, 'mrp', 10.0e0, 60.0e0, 200.0e0, 25.0e0 FROM ocr_lines WHERE line_number = 2
 UNION ALL SELECT source_image_id, 4, 'mfg_or_pkd_date', 10.0e0, 120.0e0, 200.0e0, 25.0e0 FROM ocr_lines WHERE line_number = 4
 UNION ALL SELECT source_image_id, 7, 'consumer_care', 10.0e0, 210.0e0, 200.0e0, 25.0e0 FROM ocr_lines WHERE line_number = 7
 UNION ALL SELECT source_image_id, 8, 'country_of_origin', 10.0e0, 240.0e0, 200.0e0, 25.0e0 FROM ocr_lines WHERE line_number = 8""")


@query("g15_pseudo_label_candidates", with_views("pseudo") + "SELECT source_image_id, line_number, label, x, y, w, h FROM pseudo")
def _(f):
    return D.pseudo_label_candidates(f.ocr_lines()).drop("reason")


@query("g15_pseudo_label_candidates_samples")
def _(f):
    return D.pseudo_label_candidates(lines(f))


def proposals(f):
    i, n = F.col("source_image_id"), F.col("line_number")
    labels = F.array(*[F.lit(x) for x in V.BOX_LABELS])
    return f.ocr_lines().select(
        "source_image_id", F.element_at(labels, ((i + n) % 8).cast("int") + 1).alias("label"),
        (0.2 + ((i * 7 + n * 11) % 80) / F.lit(100.0)).alias("score"), F.lit(-20.0).alias("x1"), (30.0 * n - 10).alias("y1"),
        (150.0 + (i % 9) * 20).alias("x2"), (30.0 * n + 20).alias("y2"), F.lit(240).alias("width_px"), F.lit(260).alias("height_px"),
    )


view("proposals", ("ocr_lines",), f"""SELECT source_image_id, line_number, (ARRAY[{", ".join(f"'{x}'" for x in V.BOX_LABELS)}])[CAST((source_image_id + line_number) % 8 AS INT) + 1] AS label,
 round(0.2e0 + ((source_image_id * 7 + line_number * 11) % 80) / 100.0e0, 5) AS score, 0.0e0 AS x, greatest(0.0e0, 30.0e0 * line_number - 10) AS y,
 least(240.0e0, 150.0e0 + (source_image_id % 9) * 20) AS w, least(260.0e0, 30.0e0 * line_number + 20) - greatest(0.0e0, 30.0e0 * line_number - 10) AS h,
 0.2e0 + ((source_image_id * 7 + line_number * 11) % 80) / 100.0e0 AS raw FROM ocr_lines""")


def kept_proposals(f):
    return D.filter_proposals(proposals(f), 0.4)


@query(
    "g16_corroborate",
    with_views("pseudo", "proposals")
    + """SELECT c.source_image_id, c.line_number, c.label, max(p.score) AS detector_score, max(p.score) IS NOT NULL AS corroborated FROM pseudo c
 LEFT JOIN proposals p ON p.raw >= 0.4e0 AND p.source_image_id = c.source_image_id AND p.label = c.label AND c.x + c.w / 2 BETWEEN p.x - 20 AND p.x + p.w + 20
  AND c.y + c.h / 2 BETWEEN p.y - 20 AND p.y + p.h + 20 GROUP BY 1, 2, 3""",
)
def _(f):
    rows = D.corroborate(D.pseudo_label_candidates(f.ocr_lines()), kept_proposals(f))
    return rows.select("source_image_id", "line_number", "label", "detector_score", "corroborated")


@query(
    "g17_pseudo_label_summary",
    with_views("pseudo", "proposals")
    + """SELECT 'images_examined' AS metric, '' AS label, count(*) AS value FROM part UNION ALL SELECT 'images_with_candidates', '', count(DISTINCT source_image_id) FROM pseudo
 UNION ALL SELECT 'accepted_candidates', label, count(*) FROM pseudo GROUP BY label
 UNION ALL SELECT 'detector_only_rejected', label, count(*) FROM proposals WHERE raw >= 0.4e0 AND label IN ('product_name', 'manufacturer_or_packer', 'barcode') GROUP BY label""",
)
def _(f):
    return D.pseudo_label_summary(D.pseudo_label_candidates(f.ocr_lines()), kept_proposals(f), f.base("part"))


@query(
    "g18_calibrate_candidates",
    with_choice("prediction", "truth", "ASC")
    + """, n AS (SELECT l.label, (SELECT count(*) FROM c WHERE pick IS NOT NULL AND c.label = l.label) AS tp, (SELECT count(*) FROM crowd WHERE src = 'prediction' AND crowd.label = l.label) AS made,
  (SELECT count(*) FROM crowd WHERE src = 'truth' AND crowd.label = l.label) AS known FROM (SELECT unnest(['mrp', 'net_quantity']) AS label) l)
 SELECT label, tp, made - tp AS fp, known - tp AS fn, round(CASE WHEN made > 0 THEN tp / made ELSE 0.0e0 END, 4) AS precision, round(CASE WHEN known > 0 THEN tp / known ELSE 0.0e0 END, 4) AS recall,
 coalesce(made > 0 AND tp / made >= 0.85e0 AND tp >= 3, FALSE) AS eligible FROM n""",
)
def _(f):
    rows = crowd(f)
    return M.calibrate_candidates(rows.filter("src = 'prediction'"), rows.filter("src = 'truth'"), ["mrp", "net_quantity"])


@query(
    "g18_calibrate_candidates_sparse",
    with_views("truth", "pred", "pairs")
    + """, t AS (SELECT label, count(*) AS tp FROM pairs WHERE i / (s - i) >= 0.5e0 GROUP BY 1), p AS (SELECT label, count(*) AS made FROM pred GROUP BY 1),
 k AS (SELECT label, count(*) AS known FROM truth GROUP BY 1)
 SELECT l.label, coalesce(tp, 0) AS tp, coalesce(made, 0) - coalesce(tp, 0) AS fp, coalesce(known, 0) - coalesce(tp, 0) AS fn,
 round(CASE WHEN made > 0 THEN coalesce(tp, 0) / made ELSE 0.0e0 END, 4) AS precision, round(CASE WHEN known > 0 THEN coalesce(tp, 0) / known ELSE 0.0e0 END, 4) AS recall,
 coalesce(made > 0 AND tp / made >= 0.85e0 AND tp >= 3, FALSE) AS eligible
 FROM (SELECT unnest(['mrp', 'net_quantity', 'consumer_care', 'country_of_origin']) AS label) l LEFT JOIN t USING (label) LEFT JOIN p USING (label) LEFT JOIN k USING (label)""",
)
def _(f):
    return M.calibrate_candidates(predictions(f), truth(f), ["mrp", "net_quantity", "consumer_care", "country_of_origin"])


# ------------------------------------------------------------------ manifests, splits, COCO


def image_files(f):
    i = F.col("id")
    return f.images().select(
        F.concat(F.lit("raw/"), F.lpad(i.cast("string"), 8, "0"), F.lit(".jpg")).alias("source"), (300 + (i * 7) % 1200).alias("width"),
        (400 + (i * 11) % 900).alias("height"), F.when(i % 41 != 0, F.sha2((i % 211).cast("string"), 256)).alias("sha256"),
    )


view("image_files", ("images",), """SELECT concat('raw/', lpad(CAST(id AS VARCHAR), 8, '0'), '.jpg') AS source, 300 + (id * 7) % 1200 AS width, 400 + (id * 11) % 900 AS height,
 CASE WHEN id % 41 <> 0 THEN sha256(CAST(id % 211 AS VARCHAR)) END AS sha256 FROM images""")


@query(
    "g19_dedup_manifest",
    with_views("image_files")
    + """SELECT f.source, least(width, height) AS short_side, CASE WHEN f.source = canonical THEN 'eligible' ELSE 'excluded' END AS decision,
 CASE WHEN f.sha256 IS NULL THEN 'unreadable_image' WHEN f.source = canonical THEN 'meets_round1_quality_gate' WHEN least(width, height) < 600 THEN 'short_side_under_600px'
 ELSE 'exact_duplicate' END AS reason, CASE WHEN f.sha256 IS NOT NULL AND f.source <> canonical AND least(width, height) >= 600 THEN canonical END AS duplicate_of
 FROM image_files f LEFT JOIN (SELECT sha256, min(source) AS canonical FROM image_files WHERE least(width, height) >= 600 AND sha256 IS NOT NULL GROUP BY 1) c ON c.sha256 = f.sha256""",
)
def _(f):
    return D.dedup_manifest(image_files(f)).select("source", "short_side", "decision", "reason", "duplicate_of")


def coco_regions(f):
    t = F.col("task_id")
    return truth(f).select(
        t.alias("task_seq"), F.concat(F.lit("p"), (t % 97).cast("string")).alias("product_id"), F.concat(t.cast("string"), F.lit(".jpg")).alias("filename"),
        F.col("label"), F.col("box_id").alias("region_seq"), "x", "y", "width", "height", F.lit(800).alias("original_width"), F.lit(600).alias("original_height"),
    )


def split(f):
    return D.product_split(coco_regions(f), 8)


view("split", ("truth",), """SELECT p AS product_id, CASE WHEN row_number() OVER (ORDER BY sha256(p), p) <= 8 THEN 'validation' ELSE 'train' END AS split
 FROM (SELECT DISTINCT concat('p', task_id % 97) AS p FROM truth) q""")


@query("g20_product_split", with_views("split") + "SELECT * FROM split")
def _(f):
    return split(f)


_CAT = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(V.BOX_LABELS, 1)) + " END"
view("coco_images", ("truth", "split"), """SELECT row_number() OVER (ORDER BY task_id) AS id, t.task_id, concat('p', t.task_id % 97, '/', t.task_id, '.jpg') AS file_name, split
 FROM (SELECT DISTINCT task_id FROM truth) t JOIN split s ON s.product_id = concat('p', t.task_id % 97)""")
view("coco_boxes", ("truth", "coco_images"), f"""SELECT row_number() OVER (ORDER BY t.task_id, box_id) AS id, i.id AS image_id, {_CAT} AS category_id,
 800 * x / 100 AS x, 600 * y / 100 AS y, 800 * width / 100 AS w, 600 * height / 100 AS h, i.split FROM truth t JOIN coco_images i ON i.task_id = t.task_id""")


@query("g21_coco_images", with_views("coco_images") + "SELECT id, file_name, split FROM coco_images")
def _(f):
    return D.to_coco(coco_regions(f), split(f))[0].select("id", "file_name", "split")


@query("g21_coco_annotations", with_views("coco_boxes") + "SELECT id, image_id, category_id, x, w, w * h AS area, split FROM coco_boxes")
def _(f):
    return D.to_coco(coco_regions(f), split(f))[1].select(
        "id", "image_id", "category_id", F.get("bbox", F.lit(0)).alias("x"), F.get("bbox", F.lit(2)).alias("w"), "area", "split"
    )


@query(
    "s8_write_and_read_coco",
    with_views("coco_images", "coco_boxes")
    + "SELECT b.id, b.image_id, b.split, i.file_name, round(b.x, 4) AS x, round(b.h, 4) AS h FROM coco_boxes b JOIN coco_images i ON i.id = b.image_id",
)
def _(f):
    folder = new_folder(f.spark, "coco")
    A.write_coco(*D.to_coco(coco_regions(f), split(f)), folder)
    return A.read_coco(f.spark, folder).select("id", "image_id", "split", "file_name", F.round("x", 4).alias("x"), F.round("h", 4).alias("h"))


def union(f):
    images, notes = D.to_coco(coco_regions(f), split(f))
    side = lambda i, c: F.get("bbox", F.lit(i)).alias(c)
    boxes = notes.select("id", "image_id", "category_id", *[side(i, c) for i, c in enumerate(D.BOX)])
    found = D.pseudo_label_candidates(f.ocr_lines())
    category = F.when(F.col("label") == "mrp", 3).otherwise(2)
    pseudo = found.select((F.col("source_image_id") * 10 + F.col("line_number")).alias("id"), F.col("source_image_id").alias("image_id"), category.alias("category_id"), *D.BOX)
    scans = f.base("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("scan/"), F.col("p_partkey").cast("string")).alias("file_name"))
    return D.build_training_union(images.select("id", "file_name", "split"), boxes, scans, pseudo)


view("union_images", ("coco_images", "pseudo"), """SELECT row_number() OVER (PARTITION BY split ORDER BY source, id) AS new_id, * FROM (
 SELECT id, 0 AS source, file_name, split, CASE split WHEN 'train' THEN 'trusted' ELSE 'trusted_frozen_validation' END AS provenance FROM coco_images
 UNION ALL SELECT DISTINCT source_image_id, 1, concat('scan/', source_image_id), 'train', 'pseudo_candidate' FROM pseudo) q""")


@query("g22_union_images", with_views("union_images") + "SELECT new_id AS id, file_name, split, provenance FROM union_images")
def _(f):
    return union(f)[0]


@query(
    "g22_union_annotations",
    with_views("union_images", "coco_boxes", "pseudo")
    + """SELECT row_number() OVER (PARTITION BY u.split ORDER BY u.source, u.new_id, b.id) AS id, u.new_id AS image_id, round(b.w * b.h, 2) AS area, u.split, u.provenance
 FROM union_images u JOIN (SELECT id, image_id, w, h, 0 AS source FROM coco_boxes UNION ALL SELECT source_image_id * 10 + line_number, source_image_id, w, h, 1 FROM pseudo) b
 ON b.source = u.source AND b.image_id = u.id""",
)
def _(f):
    return union(f)[1].select("id", "image_id", F.round("area", 2).alias("area"), "split", "provenance")


@query(
    "g22_union_manifest",
    with_views("union_images", "coco_boxes", "pseudo")
    + """SELECT 'images' AS kind, provenance, count(*) AS value FROM union_images GROUP BY ALL UNION ALL SELECT 'boxes', provenance, count(*) FROM union_images u
 JOIN (SELECT image_id, 0 AS source FROM coco_boxes UNION ALL SELECT source_image_id, 1 FROM pseudo) b ON b.source = u.source AND b.image_id = u.id GROUP BY ALL""",
)
def _(f):
    return union(f)[2]


# ------------------------------------------------------------------ field blocks


def declarations(f):
    """Every line of every label as the anchor of a block."""
    i, n = F.col("source_image_id"), F.col("line_number")
    label = F.when(n == 5, "manufacturer_or_packer").when(n == 7, "consumer_care").when(n == 1, "net_quantity").when(n % 3 == 0, "mrp").otherwise("country_of_origin")
    return f.ocr_lines().select(
        (i * 100 + n).alias("declaration_id"), "source_image_id", label.alias("label"), F.col("text").alias("raw_text"), "confidence", "x", "y", "w", "h"
    )


def evidence(f):
    d = declarations(f)
    return D.declaration_evidence(d, D.connected_lines(d, f.ocr_lines()))


@query("g23_connected_lines")
def _(f):
    return D.connected_lines(declarations(f), f.ocr_lines())


@query("g24_declaration_evidence")
def _(f):
    return evidence(f)


def digit_lines(f):
    """Every label line replaced by digits; some are valid codes."""
    i, n = F.col("source_image_id"), F.col("line_number")
    code = F.element_at(F.array(*[F.lit(c) for c in ("4006381333931", "4006381333932", "9638-5074", "036000291452", "12345678")]), ((i + n) % 5).cast("int") + 1)
    return f.ocr_lines().withColumn("text", code)


@query(
    "g25_barcode_evidence",
    with_views("ocr_lines")
    + """, d AS (SELECT *, (ARRAY['4006381333931', '4006381333932', '96385074', '036000291452', '12345678'])[CAST((source_image_id + line_number) % 5 AS INT) + 1] AS code FROM ocr_lines),
 n AS (SELECT p_partkey, min(struct_pack(far := far, line := line_number, code := code, y := y)) AS b FROM (SELECT p_partkey, line_number, code, d.y,
   greatest(d.y - (100.0e0 + (p_partkey % 9) * 60 + 40), 100.0e0 + (p_partkey % 9) * 60 - (d.y + 25), 0) AS far FROM part JOIN d ON d.source_image_id = p_partkey
   WHERE (source_image_id + line_number) % 5 IN (0, 2, 3)) q WHERE far <= 135 GROUP BY 1)
 SELECT p.p_partkey AS source_image_id, coalesce(n.b.code, CASE WHEN p.p_partkey % 2 = 0 THEN 'scan' ELSE 'unreadable' END) AS text,
 least(100.0e0 + (p.p_partkey % 9) * 60, coalesce(n.b.y, 1e9)) - 5 AS y FROM part p LEFT JOIN n ON n.p_partkey = p.p_partkey""",
)
def _(f):
    p = F.col("p_partkey")
    barcodes = f.base("part").select(
        p.alias("source_image_id"), F.when(p % 2 == 0, " scan ").alias("barcode_data"), F.lit(10.0).alias("x"), (100.0 + p % 9 * 60).alias("y"),
        F.lit(200.0).alias("w"), F.lit(40.0).alias("h"),
    )
    return D.barcode_evidence(barcodes, digit_lines(f)).select("source_image_id", "text", "y")


def suggestions(f):
    """Rectangles with their transcriptions, some of them not worth showing."""
    i, n = F.col("source_image_id"), F.col("line_number")
    labels = F.array(*[F.lit(x) for x in V.BOX_LABELS])
    label = F.element_at(labels, ((i + n) % 8).cast("int") + 1)
    said = F.when(i % 3 == 0, "4006381333931").when(i % 3 == 1, "visit www.brand.com").otherwise(F.col("text"))
    kinds = F.array(
        F.struct(F.concat_ws("-", i.cast("string"), n.cast("string")).alias("region_id"), F.lit(None).cast("string").alias("parent_id"),
                 F.lit("rectanglelabels").alias("type"), label.alias("label"), F.lit(None).cast("string").alias("text")),
        F.struct(F.concat_ws("-", F.lit("t"), i.cast("string"), n.cast("string")).alias("region_id"), F.concat_ws("-", i.cast("string"), n.cast("string")).alias("parent_id"),
                 F.lit("textarea").alias("type"), F.lit(None).cast("string").alias("label"), said.alias("text")),
    )
    return f.ocr_lines().select(F.inline(kinds))


@query(
    "g26_clean_suggestions",
    with_views("ocr_lines")
    + f"""SELECT concat(k, source_image_id, '-', line_number) AS region_id FROM ocr_lines CROSS JOIN (VALUES (''), ('t-')) v(k)
 WHERE NOT ((source_image_id + line_number) % 8 = 0 AND (source_image_id % 3 = 1 OR (source_image_id % 3 = 2 AND regexp_matches(text, '{V.NAME_REJECT}', 'i'))))
 AND NOT ((source_image_id + line_number) % 8 = 7 AND source_image_id % 3 <> 0)""",
)
def _(f):
    return D.clean_suggestions(suggestions(f)).select("region_id")


@query(
    "g27_filter_proposals",
    with_views("proposals") + "SELECT source_image_id, label, score, x, y, w, h FROM proposals WHERE raw >= 0.4e0",
)
def _(f):
    return kept_proposals(f)


@query(
    "g28_review_regions",
    with_views("ocr_lines")
    + """, d AS (SELECT source_image_id * 100 + line_number AS declaration_id, *, CASE line_number WHEN 5 THEN 'manufacturer_or_packer' WHEN 7 THEN 'consumer_care' WHEN 1 THEN 'net_quantity'
   ELSE CASE line_number % 3 WHEN 0 THEN 'mrp' ELSE 'country_of_origin' END END AS label FROM ocr_lines WHERE y < 230)
 SELECT declaration_id, 'rectanglelabels' AS type, label AS value, round(10 * 100 / 180.0e0, 4) AS x, round(y * 100 / 230.0e0, 4) AS y, round(170 * 100 / 180.0e0, 4) AS width,
  round((least(230.0e0, y + 25) - y) * 100 / 230.0e0, 4) AS height FROM d
 UNION ALL SELECT declaration_id, 'textarea', text, NULL, NULL, NULL, NULL FROM d
 UNION ALL SELECT declaration_id, 'choices', CASE WHEN confidence >= 0.85e0 THEN 'clear' ELSE 'partly_obscured' END, NULL, NULL, NULL, NULL FROM d""",
)
def _(f):
    size = f.base("part").select(F.col("p_partkey").alias("source_image_id"), F.lit(180).alias("width_px"), F.lit(230).alias("height_px"))
    rows = D.review_regions(declarations(f).withColumnRenamed("raw_text", "text"), size)
    return rows.select("declaration_id", "type", "value", "x", "y", "width", "height")


@query(
    "g28_prediction_statistics",
    with_views("ocr_lines")
    + "SELECT source_image_id, count(*) AS ocr_line_count, round(avg(confidence), 4) AS score, count(*) FILTER (WHERE y < 230) AS suggestions FROM ocr_lines GROUP BY 1",
)
def _(f):
    size = f.base("part").select(F.col("p_partkey").alias("source_image_id"), F.lit(180).alias("width_px"), F.lit(230).alias("height_px"))
    return D.prediction_statistics(D.review_regions(declarations(f).withColumnRenamed("raw_text", "text"), size), f.ocr_lines())


@query(
    "g29_run_summary",
    with_views("proposals")
    + """SELECT 'images_requested' AS metric, '' AS label, count(*) AS value FROM part UNION ALL SELECT 'images_completed', '', count(*) FROM part WHERE p_partkey % 9 <> 4
 UNION ALL SELECT 'errors', concat('reader ', p_partkey % 2), count(*) FROM part WHERE p_partkey % 9 = 4 GROUP BY ALL
 UNION ALL SELECT 'proposals', label, count(*) FROM proposals WHERE raw >= 0.4e0 GROUP BY label""",
)
def _(f):
    requested = f.base("part").select(F.col("p_partkey").alias("source_image_id"))
    i = F.col("source_image_id")
    errors = requested.filter(i % 9 == 4).withColumn("error", F.concat(F.lit("reader "), (i % 2).cast("string")))
    return D.run_summary(requested, kept_proposals(f), errors)


@query(
    "s7_load_ocr_results",
    with_views("ocr_lines")
    + "SELECT CAST(source_image_id AS VARCHAR) AS source_image_id, CAST(line_number + 1 AS INT) AS line_number, text, round(confidence, 6) AS confidence, y FROM ocr_lines",
)
def _(f):
    item = F.struct("line_number", F.struct("text", "confidence", F.struct("x", "y", "w", "h").alias("bounding_box")).alias("line"))
    files = f.ocr_lines().groupBy(F.col("source_image_id").cast("string").alias("source_image_id")).agg(
        F.lit("local").alias("engine_used"), F.transform(F.sort_array(F.collect_list(item)), lambda e: e["line"]).alias("lines")
    )
    rows = A.load_ocr_results(f.spark, written_json(f.spark, files, "ocr"))
    return rows.select("source_image_id", "line_number", "text", F.round("confidence", 6).alias("confidence"), "y")
