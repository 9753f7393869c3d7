"""Golden numbers, tie rules, hot keys and negative cases on small tables."""

import random

from pyspark.sql import functions as F

from panelcheck.functions import boxes as BX
from panelcheck.functions import joins as J
from panelcheck.functions.expr import float_text, json_text
from panelcheck.operators import analytics as A
from panelcheck.operators import batches as B
from panelcheck.operators import crossmatch as C
from panelcheck.operators import datasets as D
from panelcheck.operators import evidence as E
from panelcheck.operators import matching as M
from panelcheck.operators import rules as R
from panelcheck.operators import quality as Q
from panelcheck.sources.rulepacks import active_pack, core_rule_pack

INSP = "id long, officer_id long, batch_id long, status string, commodity_category string, rule_pack_version string, is_self_check boolean, created_at timestamp"
VIOL = "id long, inspection_id long, rule_id string, citation string, description string, severity string"
FIELD = "id long, inspection_id long, source_image_id long, field_seq long, field_type string, raw_text string, parsed_value string, confidence double, box_h double, verdict string, reviewed_by_officer boolean, officer_override_value string"
IMAGE = "id long, inspection_id long, image_role string, width_px int, height_px int, calibration_scale_mm_per_px double"


def _insp(spark, rows):
    import datetime as dt

    at = dt.datetime(2026, 9, 1, 10)
    return spark.createDataFrame([(i, o, 1, s, c, "2026.02.01", self_check, at) for i, o, s, c, self_check in rows], INSP)


def _field(i, insp, image, ftype, value, conf=0.95, h=25.0, verdict="pass", reviewed=False):
    return (i, insp, image, i, ftype, value, value, conf, h, verdict, reviewed, None)


def small(spark):
    insp = _insp(spark, [(1, 1, "completed", None, False), (2, 1, "completed", None, False), (3, 2, "needs_review", None, False)])
    viol = spark.createDataFrame([(1, 2, "r1", "c", "MRP missing", "critical"), (2, 2, "r2", "c", "d", "major")], VIOL)
    logs = spark.createDataFrame([(1, 1)], "id long, actor_user_id long")
    return insp, viol, logs


def test_summary_golden(spark):
    row = A.analytics_summary(*small(spark)).collect()[0]
    assert (row.total_inspections, row.overall_compliance_rate, row.critical_violations, row.major_violations, row.total_audit_overrides) == (3, 50.0, 1, 1, 1)


def test_self_checks_change_no_enforcement_number(spark):
    insp, viol, logs = small(spark)
    more = insp.unionByName(_insp(spark, [(9, 1, "completed", None, True)]))
    bad = viol.unionByName(spark.createDataFrame([(7, 9, "r1", "c", "d", "critical")], VIOL))
    assert A.analytics_summary(more, bad, logs).collect() == A.analytics_summary(insp, viol, logs).collect()
    assert A.hotspots_by_rule(more, bad).collect() == A.hotspots_by_rule(insp, viol).collect()


def test_empty_tables(spark):
    insp, viol, logs = small(spark)
    row = A.analytics_summary(insp.limit(0), viol.limit(0), logs.limit(0)).collect()[0]
    assert row.overall_compliance_rate == 100.0 and row.total_violations == 0
    batches = spark.createDataFrame([(5, 1, "active")], "id long, officer_id long, status string")
    assert B.batch_metrics(batches, insp, viol).collect()[0].compliance_rate_pct == 0.0


def _font(spark, scale, h, **kw):
    insp = _insp(spark, [(1, 1, "draft", None, False)])
    fields = spark.createDataFrame([_field(1, 1, 10, "net_quantity", "500 g", h=h, **kw)], FIELD)
    images = spark.createDataFrame([(10, 1, "front_pdp", 1000, 1000, scale)], IMAGE)
    rows = R.evaluate_rules(insp, fields, images, core_rule_pack(spark))
    return rows.filter("rule_id = 'font-size-pdp-net-quantity'").collect()[0]


def test_font_height(spark):
    # a panel of 10 x 10 cm needs 1.5 mm
    assert _font(spark, 0.1, 25.0).verdict == "pass"
    row = _font(spark, 0.1, 10.0)
    assert row.verdict == "fail" and row.description == "Font height of 1.00mm is below the required minimum 1.5mm for PDP area 100.0cm²."
    row = _font(spark, None, 25.0)
    assert row.verdict == "needs_review" and not row.is_calibrated and row.warning
    assert _font(spark, None, 25.0, reviewed=True).verdict == "pass"
    assert _font(spark, 0.1, 10.0, reviewed=True).verdict == "fail"


def test_pan_masala_needs_a_price_the_extractor_names_otherwise(spark):
    insp = _insp(spark, [(1, 1, "draft", "pan_masala", False)])
    fields = spark.createDataFrame([_field(1, 1, 10, "rsp", "Rs. 5.00")], FIELD)
    images = spark.createDataFrame([], IMAGE)
    verdict = lambda **kw: R.evaluate_rules(insp, fields, images, core_rule_pack(spark), **kw).filter("rule_id = 'pan-masala-rsp'").collect()[0].verdict
    assert verdict() == "fail" and verdict(field_aliases={"rsp": "retail_sale_price"}) == "pass"


def test_unknown_pack_falls_back_to_the_core_rules(spark):
    insp = _insp(spark, [(1, 1, "draft", None, False)]).withColumn("rule_pack_version", F.lit("1999"))
    assert {r.rule_pack_version for r in R.applicable_rules(insp, core_rule_pack(spark)).collect()} == {"2026.02.01"}
    none = core_rule_pack(spark).withColumn("is_active", F.lit(False))
    assert active_pack(none, core_rule_pack(spark)).count() == 1


def _discrepancies(spark, *values):
    images = spark.createDataFrame([(i, 1, role, 100, 100, None) for i, (role, _) in enumerate(values)], IMAGE)
    fields = spark.createDataFrame([_field(i, 1, i, "mrp", v) for i, (_, v) in enumerate(values)], FIELD)
    return C.discrepancies(C.suspects(fields, images)).collect()


def test_sticker_above_the_printed_price(spark):
    (row,) = _discrepancies(spark, ("front_pdp", "Rs. 100.00"), ("sticker", "Rs. 135.00"))
    assert (row.discrepancy_type, row.severity, row.first_field_id) == ("mrp_altered_sticker", "critical", 1)
    assert "Rs. 135.00" in row.description


def test_only_the_first_panel_is_compared(spark):
    rows = _discrepancies(spark, ("front_pdp", "1"), ("back_panel", "2"), ("side_panel", "2"))
    assert len(rows) == 2 and {r.first_field_id for r in rows} == {0}


def test_ten_thousand_equal_stickers_make_no_pairs(spark):
    images = spark.range(20000).select("id", F.lit(1).cast("long").alias("inspection_id"), F.when(F.col("id") % 2 == 0, "sticker").otherwise("back_panel").alias("image_role"))
    fields = images.select("id", "inspection_id", F.col("id").alias("source_image_id"), F.col("id").alias("field_seq"), F.lit("mrp").alias("field_type"),
                           F.when(F.col("id") == 4, "9").otherwise("8").alias("parsed_value"))
    assert C.conflicting_values(C.suspects(fields, images)).count() == 1


def test_quantities_by_value_and_unit(spark):
    values = [('{"value": 500.0, "unit": "g", "raw_unit": "GMS"}'), ('{"value": 500.0, "unit": "g", "raw_unit": "g"}')]
    images = spark.createDataFrame([(0, 1, "front_pdp", 1, 1, None), (1, 1, "back_panel", 1, 1, None)], IMAGE)
    fields = spark.createDataFrame([_field(i, 1, i, "net_quantity", v) for i, v in enumerate(values)], FIELD)
    assert C.suspects(fields, images).count() == 2 and C.suspects(fields, images, "normalised").count() == 0


def test_ranked_equals_a_window(spark):
    from pyspark.sql import Window as W

    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.expr("pmod(hash(id), 900)").alias("v"), "id")
    got = J.ranked(df, ["k"], F.floor(F.col("v") / 64), [F.col("v"), F.col("id")], "r")
    want = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("v", "id")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_neighbours_cross_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 16)
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").alias("n"), F.col("id").cast("string").alias("t"))
    rows = J.with_neighbours(df, "g", "n", {"a": ("t", -1), "b": ("t", 3)}).collect()
    assert len(rows) == 100 and all((r.a or "-1") == str(r.n - 1) and (r.b or str(r.n + 3)) == str(r.n + 3) for r in rows)


def test_lookup_join_is_the_same_without_broadcast(spark, monkeypatch):
    big = spark.range(500).select("id", (F.col("id") % 3).alias("k"))
    small_ = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    want = sorted(map(tuple, J.lookup_join(big, small_, ["k"]).select("id", "v").collect()), key=str)
    monkeypatch.setattr(J, "BROADCAST_BYTES", -1)
    got = sorted(map(tuple, J.lookup_join(big, small_, ["k"]).select("id", "v").collect()), key=str)
    assert got == want and len(got) == 500


def greedy(truth, pred, t):
    """Reviewed boxes in order take the best free prediction, the later of equal ones."""
    free, out = dict(pred), []
    for i, a in truth:
        best = max(((_iou(a, b), j) for j, b in free.items()), default=None)
        if best and best[0] >= t:
            del free[best[1]]
            out.append((i, best[1]))
    return out


def _iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    i = max(0.0, w) * max(0.0, h)
    return i / (a[2] * a[3] + b[2] * b[3] - i)


BOXES = "task_id long, src string, box_id long, label string, x double, y double, width double, height double"


def _matched(df):
    return sorted((r.task_id, r.truth_id, r.prediction_id) for r in df.collect())


def test_greedy_matching(spark):
    rng = random.Random(3)
    rows, want = [], []
    for task in range(12):
        mk = lambda: (rng.randint(0, 12) * 2.0, rng.randint(0, 4) * 2.0, 20.0, 10.0)
        truth = [(i, mk()) for i in range(rng.randint(1, 9))]
        pred = [(i, mk()) for i in range(rng.randint(1, 9))]
        rows += [(task, "t", i, "mrp", *b) for i, b in truth] + [(task, "p", i, "mrp", *b) for i, b in pred]
        want += [(task, *m) for m in greedy(truth, pred, 0.5)]
    df = spark.createDataFrame(rows, BOXES)
    t, p = df.filter("src = 't'").drop("src"), df.filter("src = 'p'").drop("src")
    assert _matched(M.match_regions(t, p, 0.5)) == sorted(want)
    assert M.match_regions(t.limit(0), p, 0.5).collect() == M.match_regions(t, p.limit(0), 0.5).collect() == []


def test_crowds_are_cut_where_nothing_overlaps(spark):
    rng = random.Random(4)
    mk = lambda: (rng.randint(0, 40) * 25.0 + rng.randint(0, 5), rng.randint(0, 8) * 15.0 + rng.randint(0, 3), 20.0, 10.0)
    truth, pred = [(i, mk()) for i in range(700)], [(i, mk()) for i in range(700)]
    df = spark.createDataFrame([(1, s, i, "mrp", *b) for s, side in (("t", truth), ("p", pred)) for i, b in side], BOXES)
    t, p = df.filter("src = 't'").drop("src"), df.filter("src = 'p'").drop("src")
    parts = M.parts_of_crowds(t, p).collect()
    assert len(parts) == 700 and len({(r.part_x, r.part_y) for r in parts}) > 300
    assert _matched(M.match_regions(t, p, 0.5)) == sorted((1, *m) for m in greedy(truth, pred, 0.5))
    assert M.parts_of_crowds(t, p, 1400).collect() == []


def test_five_thousand_boxes_on_one_spot(spark):
    """All overlap all, so 25 million candidates in one group; box k of one side lies on box k of the other."""
    one = spark.range(5000).select(F.lit(1).alias("task_id"), F.lit("mrp").alias("label"), F.col("id").alias("box_id"), (10 + F.col("id") / 5000).alias("x"),
                                   F.lit(5.0).alias("y"), F.lit(10.0).alias("width"), F.lit(5.0).alias("height"))
    found = M.match_regions(one, one, 0.5).agg(F.count("*").alias("n"), F.count_if(F.col("truth_id") == F.col("prediction_id")).alias("same")).first()
    assert (found.n, found.same) == (5000, 5000)


def test_hot_pile_of_equal_boxes(spark):
    df = spark.range(5000).select(F.lit(1).alias("task_id"), F.lit("mrp").alias("label"), F.col("id").alias("box_id"),
                                  *[F.lit(v).alias(c) for c, v in (("x", 1.0), ("y", 1.0), ("width", 5.0), ("height", 5.0))])
    (row,) = M.near_duplicates(df).collect()
    assert row.pairs == 5000 * 4999 // 2


def test_polygons_and_mapping(spark):
    row = spark.createDataFrame([([[10.0, 0.0], [0.0, 0.0], [0.0, 5.0], [10.0, 5.0]],)], "p array<array<double>>").select(
        BX.canonical_polygon(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(5.0), F.col("p")).alias("p")).collect()[0]
    assert row.p == [[0.0, 0.0], [10.0, 0.0], [10.0, 5.0], [0.0, 5.0]]
    # forward rotation by 90 degrees, then a perspective; the inverse brings the point back
    rot, per = (0.0, -1.0, 100.0, 1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.001, 0.0, 1.0)
    x, y = 30.0, 40.0
    rx, ry = rot[0] * x + rot[1] * y + rot[2], rot[3] * x + rot[4] * y + rot[5]
    q = per[6] * rx + per[7] * ry + per[8]
    steps = F.array(F.struct(F.lit("rotation").alias("type"), F.lit(1.0).alias("scale"), F.array(*map(F.lit, rot)).alias("matrix")),
                    F.struct(F.lit("perspective").alias("type"), F.lit(1.0).alias("scale"), F.array(*map(F.lit, per)).alias("matrix")),
                    F.struct(F.lit("resize").alias("type"), F.lit(0.5).alias("scale"), F.array().cast("array<double>").alias("matrix")))
    out = spark.range(1).select(BX.unmapped_point(F.lit(rx / q * 0.5), F.lit(ry / q * 0.5), steps).alias("p")).collect()[0].p
    assert abs(out.x - x) < 1e-6 and abs(out.y - y) < 1e-6


def test_audit_links_and_tampering(spark):
    rows = [(i, 1, "a", "inspection", 1, None, '{"k": 1}', f"2026-01-0{i} 00:00:00") for i in range(1, 5)]
    logs = spark.createDataFrame(rows, "id long, actor_user_id long, action string, entity_type string, entity_id long, before_value string, after_value string, ts string")
    logs = logs.withColumn("created_at", F.to_timestamp("ts")).drop("ts").withColumn("inspection_id", F.lit(1)).withColumn("prev_hash", F.lit(None).cast("string"))
    hashed = logs.withColumn("entry_hash", E.audit_entry_hash())
    first = hashed.filter("id = 1").collect()[0].entry_hash
    linked = logs.withColumn("prev_hash", F.when(F.col("id") == 2, first).when(F.col("id") == 4, "0" * 64)).withColumn("entry_hash", E.audit_entry_hash())
    out = {r.id: (r.is_valid_hash, r.is_linked) for r in E.verify_audit_chain(linked).collect()}
    assert out == {1: (True, True), 2: (True, True), 3: (True, True), 4: (True, False)}
    changed = linked.withColumn("after_value", F.when(F.col("id") == 3, '{"k": 2}').otherwise(F.col("after_value")))
    assert {r.id for r in E.verify_audit_chain(changed).filter("NOT is_valid_hash").collect()} == {3}


def test_texts(spark):
    import json

    values = ['plain', 'quote " and \\', "tab\tline\n", "₹ 5", "smile 😀"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", json_text(F.col("v")).alias("j")).collect()
    assert all(r.j == json.dumps(r.v) for r in rows)
    nums = [1.0, 249.5, 0.07, 12345678.0, 1234567890.25]
    rows = spark.createDataFrame([(v,) for v in nums], "v double").select("v", float_text(F.col("v")).alias("t")).collect()
    assert all(r.t == repr(r.v) for r in rows)


def test_check_digits(spark):
    codes = {"4006381333931": True, "4006381333932": False, "9638-5074": True, "036000291452": True, "12345": False, "abc": False, "": False}
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", Q.valid_gtin(F.col("c")).alias("ok")).collect()
    assert {r.c: r.ok for r in rows} == codes


def _plain_block(anchor, raw, pattern, lines):
    """Picked lines, one by one: of the candidates in reach of the grown box the nearest, then the lowest number."""
    import math
    import re

    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    x, y, w, h = anchor
    r, b = x + w, y + h
    rest = [e for e in sorted(lines) if (w >= h) == (e[5] >= e[6])]
    rest = [e for e in rest if re.search(pattern, e[1] or "", re.I) or len(words(e[1]) & words(raw)) >= max(1, min(2, len(words(e[1]))))]
    picked = []
    while rest:
        near = []
        for k, (_, _, _, lx, ly, lw, lh) in enumerate(rest):
            dx, dy = max(x - (lx + lw), lx - r, 0), max(y - (ly + lh), ly - b, 0)
            if dx <= D.V.BLOCK_GAP_PX and dy <= D.V.BLOCK_GAP_PX and math.hypot(dx, dy) <= D.V.BLOCK_DIAGONAL_PX:
                near.append((math.hypot(dx, dy), k))
        if not near:
            break
        e = rest.pop(min(near)[1])
        picked.append(e[:2])
        x, y, r, b = min(x, e[3]), min(y, e[4]), max(r, e[3] + e[5]), max(b, e[4] + e[6])
    return picked


def test_blocks_equal_plain_growth(spark):
    rng = random.Random(23)
    words = ["made in", "India", "Acme", "Foods", "net", "500", "ghee", ""]
    lines, declared = [], []
    for image in range(6):
        for n in range(30):
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(4))) if n != 3 else None
            size = (60.0, 20.0) if rng.random() < 0.8 else (20.0, 60.0)
            lines.append((image, n // 2, text, 0.5, float(rng.randrange(900)), float(rng.randrange(900)), *size))
        lines.append(lines[-1])  # a line twice
    for k, (image, _, text, _, x, y, w, h) in enumerate(lines):
        declared.append((k, image, "country_of_origin" if k % 3 else "none of them" if k % 2 else None, text, 0.5, x, y, w, h))
    table = spark.createDataFrame(lines, "source_image_id long, line_number int, text string, confidence double, x double, y double, w double, h double")
    anchors = spark.createDataFrame(declared, "declaration_id long, source_image_id long, label string, raw_text string, confidence double, x double, y double, w double, h double")
    got = {}
    for row in sorted(D.connected_lines(anchors, table).collect()):
        got.setdefault(row.declaration_id, []).append((row.line_number, row.text))
    want = {}
    for k, image, label, raw, _, *anchor in declared:
        key = lambda e: (e[1], *e[4:], e[2] or "", e[3])
        mine = [(e[1], e[2], *e[3:]) for e in sorted((e for e in lines if e[0] == image), key=key)]
        ranked = [(i, *e) for i, e in enumerate(mine)]
        picked = _plain_block(anchor, raw, D.V.LINE_PATTERNS[label] if label in D.V.LINE_PATTERNS else "(?!)", [((i, e[0]), e[1], *e[2:]) for i, *e in ranked])
        if picked:
            want[k] = [(n[1], t) for n, t in picked]
    assert got == want and max(map(len, want.values())) > 4
    assert D.connected_lines(anchors.limit(0), table).collect() == [] and D.connected_lines(anchors, table.limit(0)).collect() == []
