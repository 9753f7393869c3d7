"""Catalog: sources, sinks and the streaming functions on tables."""

from pyspark.sql import functions as F

from panelcheck.plans.catalog.analytics import summary_sql
from panelcheck.plans.catalog.listings import reports
from panelcheck.plans.catalog.registry import ORACLES, query
from panelcheck.plans.catalog.views import view, with_views
from panelcheck.schemas import TABLES
from panelcheck.sources import files as FI
from panelcheck.sources import tables as TB
from panelcheck.streaming import monitor as MO
from panelcheck.streaming import summary as SU
from panelcheck.streaming import sync as SY

NOW = "2026-03-01 10:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def _typed(df, name):
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])


@query(
    "s1_load_tables",
    with_views("inspections", "users")
    + """SELECT CAST(i.id AS VARCHAR) AS id, CAST(i.officer_id AS VARCHAR) AS officer_id, i.status, i.is_self_check, i.created_at, u.full_name
 FROM inspections i JOIN users u ON u.id = i.officer_id""",
)
def _(f):
    folder = FI.new_folder(f.spark, "tables")
    _typed(f.inspections(), "inspections").write.parquet(f"{folder}/inspections")
    _typed(f.users(), "users").write.parquet(f"{folder}/users")
    t = TB.load_tables(f.spark, folder, ["inspections", "users"])
    people = t["users"].select(F.col("id").alias("officer_id"), "full_name")
    return t["inspections"].join(people, "officer_id").select("id", "officer_id", "status", "is_self_check", "created_at", "full_name")


def _nine(f):
    """The nine domain tables of the fixture."""
    batches = f.inspections().filter("batch_id IS NOT NULL").groupBy(F.col("batch_id").alias("id")).agg(F.min("officer_id").alias("officer_id"), F.min("created_at").alias("created_at"))
    return {
        "users": f.users(), "batch_sessions": batches, "inspections": f.inspections(), "inspection_images": f.images(), "extracted_fields": f.extracted_fields(),
        "violations": f.violations(), "reports": reports(f), "audit_logs": f.audit_logs(), "rule_packs": f.rule_packs(),
    }


@query(
    "s1_load_all_tables",
    with_views("users", "inspections", "images", "extracted_fields", "violations", "audit_logs")
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", count(*) AS rows, count(DISTINCT id) AS ids, CAST(sum(CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT)) AS BIGINT) AS id_sum FROM {source}"""
        for name, source in (
            ("users", "users"), ("batch_sessions", "(SELECT DISTINCT batch_id AS id FROM inspections WHERE batch_id IS NOT NULL)"), ("inspections", "inspections"), ("inspection_images", "images"),
            ("extracted_fields", "extracted_fields"), ("violations", "violations"), ("reports", "(SELECT id * 2 AS id FROM inspections WHERE status = 'completed')"), ("audit_logs", "audit_logs"),
            ("rule_packs", "(SELECT '2026.02.01' AS id)"),
        )
    ),
)
def _(f):
    """Every table written and loaded again: its rows and what its ids add up to."""
    folder = FI.new_folder(f.spark, "all-tables")
    for name, df in _nine(f).items():
        _typed(df, name).write.parquet(f"{folder}/{name}")
    out = None
    for name, df in TB.load_tables(f.spark, folder).items():
        key = "version" if name == "rule_packs" else "id"
        of_id = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("ids"), F.sum(of_id).alias("id_sum")).select(F.lit(name).alias("table"), "rows", "ids", "id_sum")
        out = row if out is None else out.unionByName(row)
    return out


def requests(f):
    """Sync requests made from inspections and their images; client ids repeat."""
    i = F.col("id")
    url = F.when(i % 8 == 5, "broken").otherwise(F.concat(F.lit("data:image/"), F.when(i % 3 == 0, "png").when(i % 3 == 1, "webp").otherwise("jpeg"),
                                                          F.lit(";base64,"), F.base64(F.concat(F.lit("img-"), i.cast("string")).cast("binary"))))
    image = F.struct(
        i.alias("k"), F.concat(F.lit("i"), (i % 10).cast("string")).alias("client_id"), "image_role", url.alias("data_url"), "quality_check_passed",
        F.col("width_px").cast("int").alias("width_px"), F.col("height_px").cast("int").alias("height_px"), "captured_at",
    )
    nested = f.images().groupBy(F.col("inspection_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(image)), lambda e: e.dropFields("k")).alias("images"))
    rows = f.inspections().join(nested, "id")
    return rows.select(
        F.col("id").alias("request_seq"), F.col("officer_id").cast("string").alias("officer_id"), "client_id", "commodity_category", "captured_offline",
        "created_at", "is_self_check", "region", "images",
    )


view("sent", ("images",), """SELECT inspection_id AS request_seq, row_number() OVER (PARTITION BY inspection_id ORDER BY id) - 1 AS pos, concat('i', id % 10) AS cid, image_role, id,
 id % 8 <> 5 AS valid FROM images""")


@query(
    "s3_flatten_sync_requests",
    with_views("sent", "inspections")
    + "SELECT s.request_seq, i.client_id, CAST(s.pos AS INT) AS image_pos, s.cid AS image_client_id, s.image_role FROM sent s JOIN inspections i ON i.id = s.request_seq",
)
def _(f):
    rows = TB.flatten_sync_requests(requests(f))
    return rows.select("request_seq", "client_id", "image_pos", "image_client_id", F.col("image_role"))


@query(
    "s4_decode_data_urls",
    with_views("sent")
    + """SELECT request_seq, CAST(pos AS INT) AS image_pos, CASE WHEN valid THEN CASE id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' ELSE 'jpg' END END AS extension,
 CASE WHEN valid THEN sha256(concat('img-', id)) END AS sha256_hash FROM sent""",
)
def _(f):
    rows = TB.flatten_sync_requests(requests(f))
    return FI.decode_data_urls(rows, "image_data_url").select("request_seq", "image_pos", "extension", "sha256_hash")


FILES = 16384  # of a folder, about: the driver lists one folder at a time


@query("s5_image_inventory")
def _(f):
    folder = FI.new_folder(f.spark, "files")
    pages = f.base("pages").select("page_id", "html")
    parts = max(1, -(-pages.count() // FILES))
    folders = [folder] if parts == 1 else [f"{folder}/{k}" for k in range(parts)]
    if parts > 1:
        by_part = FI.new_folder(f.spark, "pages")
        part = F.pmod(F.xxhash64("page_id"), F.lit(parts)).cast("int")
        pages.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(by_part)
    for k, to in enumerate(folders):
        rows = pages if parts == 1 else f.spark.read.schema(pages.schema).parquet(f"{by_part}/part={k}")
        rows.repartition("page_id").write.partitionBy("page_id").text(to)
    rows = FI.image_inventory(f.spark, *folders).filter(~F.col("path").contains("_SUCCESS"))
    return rows.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint").alias("page_id"), "length", "sha256")


@query(
    "s9_replace_snapshot",
    with_views("violations", "inspections")
    + """SELECT id, inspection_id, rule_id FROM violations WHERE inspection_id % 5 <> 0
 UNION ALL SELECT id * 1000, id, 'rerun' FROM inspections WHERE id % 10 = 0""",
)
def _(f):
    old = f.violations().select("id", "inspection_id", "rule_id")
    touched = f.inspections().filter("id % 5 = 0").select(F.col("id").alias("inspection_id"))
    new = touched.filter("inspection_id % 10 = 0").select((F.col("inspection_id") * 1000).alias("id"), "inspection_id", F.lit("rerun").alias("rule_id"))
    return TB.replace_snapshot(new, old, ["inspection_id"], touched)


_DEL = "status = 'completed' AND id % 7 = 3"


@query(
    "s10_delete_inspections",
    with_views("inspections", "images", "extracted_fields", "violations")
    + f""", gone AS (SELECT id FROM inspections WHERE {_DEL})
 SELECT 'inspections' AS "table", count(*) AS rows FROM inspections WHERE id NOT IN (SELECT id FROM gone)
 UNION ALL SELECT 'images', count(*) FROM images WHERE inspection_id NOT IN (SELECT id FROM gone)
 UNION ALL SELECT 'extracted_fields', count(*) FROM extracted_fields WHERE inspection_id NOT IN (SELECT id FROM gone)
 UNION ALL SELECT 'violations', count(*) FROM violations WHERE inspection_id NOT IN (SELECT id FROM gone)""",
)
def _(f):
    tables = {"inspections": f.inspections(), "images": f.images(), "extracted_fields": f.extracted_fields(), "violations": f.violations()}
    kept, _audit = TB.delete_inspections(tables, f.inspections().filter(_DEL), 1)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "s10_delete_audit",
    with_views("inspections")
    + f"""SELECT CAST(id AS VARCHAR) AS entity_id, concat('{{"commodity_category": ', CASE WHEN commodity_category IS NULL THEN 'null' ELSE concat('"', commodity_category, '"') END, ', "status": "completed"}}') AS before_value,
 '{{"deleted": true}}' AS after_value FROM inspections WHERE {_DEL}""",
)
def _(f):
    rows = f.inspections()
    return TB.delete_inspections({"inspections": rows}, rows.filter(_DEL), 1)[1].select("entity_id", "before_value", "after_value")


@query("s11_build_report_documents")
def _(f):
    return TB.build_report_documents(f.inspections(), f.users(), f.extracted_fields(), f.violations(), f.audit_logs(), now())


@query(
    "s12_report_audit_rows",
    with_views("reports")
    + """SELECT CAST(id AS VARCHAR) AS entity_id, generated_by AS actor_user_id, concat('{"filename": "report_', left(CAST(inspection_id AS VARCHAR), 8), '_', left(CAST(id AS VARCHAR), 8),
 CASE format WHEN 'editable' THEN '.json' ELSE '.pdf' END, '", "format": "', format, '", "storage_url": "', storage_url, '"}') AS after_value FROM reports""",
)
def _(f):
    return TB.report_audit_rows(reports(f)).select("entity_id", "actor_user_id", "after_value")


@query(
    "s15_tasks_from_inventory",
    with_views("images")
    + """SELECT CAST(inspection_id AS VARCHAR) AS sample_id, concat(p, id, '.JPG') AS source_filename, r AS image_role, concat('/data/local-files/?d=raw/', inspection_id, '/', p, id, '.JPG') AS image
 FROM (SELECT *, CASE id % 6 WHEN 0 THEN 'front_' WHEN 1 THEN 'Back' WHEN 2 THEN 'side' WHEN 3 THEN 'MRP-' WHEN 4 THEN 'sticker' ELSE 'img' END AS p,
  CASE id % 6 WHEN 0 THEN 'front_pdp' WHEN 1 THEN 'back_panel' WHEN 2 THEN 'side_panel' WHEN 3 THEN 'sticker' WHEN 4 THEN 'sticker' ELSE 'other' END AS r FROM images WHERE id % 13 <> 0) q""",
)
def _(f):
    i = F.col("id")
    names = F.element_at(F.array(*[F.lit(n) for n in ("front_", "Back", "side", "MRP-", "sticker", "img")]), (i % 6).cast("int") + 1)
    rows = f.images().select(
        F.concat(F.lit("/mnt/data/raw/"), F.col("inspection_id").cast("string"), F.lit("/"), names, i.cast("string"), F.when(i % 13 == 0, ".txt").otherwise(".JPG")).alias("path")
    )
    return FI.tasks_from_inventory(rows, "raw")


# ------------------------------------------------------------------ streaming functions on tables


def metric_events(f):
    e = F.col("event_id")
    return f.base("events").select(
        "ts", (F.col("user_id") % 7).alias("endpoint"), F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status_code"),
        (F.col("value") / 50).alias("value"), F.when(e % 3 == 0, "image").otherwise("inspection").alias("entity_type"),
        F.when(F.col("event_type") == "purchase", "conflict").otherwise("synced").alias("status"),
    )


view("metric", (), """SELECT ts, user_id % 7 AS endpoint, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status_code, value / 50 AS value,
 CASE WHEN event_id % 3 = 0 THEN 'image' ELSE 'inspection' END AS entity_type, CASE WHEN event_type = 'purchase' THEN 'conflict' ELSE 'synced' END AS status FROM events""")


def slide(minutes):
    return f"SELECT *, date_trunc('minute', ts) - INTERVAL (k) MINUTE AS window_start FROM metric CROSS JOIN range({minutes}) r(k)"


@query(
    "t6_alert_5xx",
    with_views("metric")
    + f"""SELECT *, ratio > 0.05e0 AS firing FROM (SELECT window_start, count(*) AS requests, count(*) FILTER (WHERE status_code >= 500) AS errors,
 count(*) FILTER (WHERE status_code >= 500) / count(*) AS ratio FROM ({slide(2)}) q GROUP BY 1) w""",
)
def _(f):
    return MO.alert_5xx(metric_events(f))


_B = [0.0, *MO.V.LATENCY_BUCKETS]


def _quantile_sql(q):
    cases = " ".join(
        f"WHEN b{i} >= {q} * n THEN {_B[i - 1]}e0 + {round(_B[i] - _B[i - 1], 6)}e0 * ({q} * n - {f'b{i - 1}' if i > 1 else 0}) / (b{i} - {f'b{i - 1}' if i > 1 else 0})"
        for i in range(1, len(_B))
    )
    return f"round(CASE {cases} ELSE {_B[-1]}e0 END, 6)"


@query(
    "t7_latency_quantiles",
    with_views("metric")
    + f"SELECT window_start, n, {_quantile_sql('0.5e0')} AS p50, {_quantile_sql('0.95e0')} AS p95, {_quantile_sql('0.99e0')} AS p99 FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE value <= {b}e0) AS b{i}" for i, b in enumerate(_B) if i)
    + " FROM metric GROUP BY 1) q",
)
def _(f):
    return MO.latency_quantiles(metric_events(f))


@query("t7_approximate_quantiles")
def _(f):
    return MO.approximate_quantiles(metric_events(f))


@query(
    "t8_alert_sync_conflicts",
    with_views("metric")
    + f"""SELECT *, ratio > 0.15e0 AS firing FROM (SELECT window_start, count(*) AS operations, count(*) FILTER (WHERE status = 'conflict') AS conflicts,
 (count(*) FILTER (WHERE status = 'conflict') / 300.0e0) / greatest(count(*) / 300.0e0, 0.001e0) AS ratio FROM ({slide(5)}) q GROUP BY 1) w""",
)
def _(f):
    return MO.alert_sync_conflicts(metric_events(f))


@query(
    "t9_event_rates",
    with_views("metric")
    + "SELECT date_trunc('minute', ts) AS window_start, endpoint, status_code, count(*) AS n, count(*) / 60.0e0 AS rate FROM metric GROUP BY 1, 2, 3",
)
def _(f):
    return MO.event_rates(metric_events(f), ["endpoint", "status_code"])


@query(
    "t10_domain_counters",
    with_views("inspections")
    + """SELECT CASE status WHEN 'completed' THEN 'compliant' ELSE 'non_compliant' END AS overall_verdict, coalesce(commodity_category, 'general') AS commodity_category,
 CASE WHEN is_self_check THEN 'true' ELSE 'false' END AS is_self_check, count(*) AS total FROM inspections WHERE status IN ('completed', 'needs_review') GROUP BY ALL""",
)
def _(f):
    return MO.inspection_counters(f.inspections())


@query(
    "t10_quality_outcomes",
    with_views("images")
    + "SELECT CASE WHEN quality_check_passed THEN 'pass' ELSE 'fail' END AS result, image_role AS role, count(*) AS total FROM images GROUP BY ALL",
)
def _(f):
    rows = f.images().select(F.when(F.col("quality_check_passed"), "pass").otherwise("fail").alias("result"), F.col("image_role").alias("role"))
    return MO.domain_counters(rows, ["result", "role"])


@query(
    "t11_sustained",
    with_views("metric")
    + f""", a AS (SELECT window_start, floor(epoch(window_start) / 60) AS m FROM ({slide(5)}) q GROUP BY 1, 2
  HAVING (count(*) FILTER (WHERE status = 'conflict') / 300.0e0) / greatest(count(*) / 300.0e0, 0.001e0) > 0.15e0)
 SELECT min(window_start) AS started_at, max(window_start) AS ended_at FROM (SELECT *, m - row_number() OVER (ORDER BY m) AS island FROM a) i GROUP BY island HAVING max(m) - min(m) >= 5""",
)
def _(f):
    return MO.sustained(MO.alert_sync_conflicts(metric_events(f)), 5)


def stream_entry(name, table_entry, keys, rule):
    """A stream whose quarters come in order of time, and then the first one again, far too late: it ends with the windows of the table,
    for the watermark leaves the late rows out."""

    @query(name, ORACLES[table_entry])
    def _(f):
        folder = FI.new_folder(f.spark, name)
        events = metric_events(f).withColumn("ts", F.col("ts").cast("timestamp"))
        low, high = events.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
        quarter = F.least(F.floor((F.unix_timestamp("ts") - F.lit(low)) * 4 / F.lit(max((high or 0) - (low or 0), 1))), F.lit(3))
        out = None
        for k in (0, 1, 2, 3, 0):
            events.filter(quarter == k).write.mode("append").parquet(f"{folder}/in")
            stream = f.spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            out = MO.newest_windows(rule(MO.watermarked(stream)), keys, folder)
        return out


stream_entry("t6_alert_5xx_stream", "t6_alert_5xx", ["window_start"], MO.alert_5xx)
stream_entry("t7_latency_stream", "t7_latency_quantiles", ["window_start"], MO.latency_quantiles)
stream_entry("t8_sync_conflicts_stream", "t8_alert_sync_conflicts", ["window_start"], MO.alert_sync_conflicts)
stream_entry("t9_rates_stream", "t9_event_rates", ["window_start", "endpoint", "status_code"], lambda events: MO.event_rates(events, ["endpoint", "status_code"]))


@query(
    "t3_lateness",
    with_views("inspections")
    + """SELECT CAST(created_at AS DATE) AS day, count(*) AS records, count(*) FILTER (WHERE (id * 977) % 200000 > 86400) AS late, max((id * 977) % 200000) AS max_late_seconds
 FROM inspections WHERE captured_offline GROUP BY 1""",
)
def _(f):
    late = (F.col("id") * 977) % 200000
    rows = f.inspections().filter("captured_offline").withColumn("synced_at", F.timestamp_seconds(F.unix_timestamp("created_at") + late))
    return SY.late_counts(rows)


def attempts(f):
    """Sync attempts from the event table, keyed by user."""
    e, k = F.col("event_id"), F.col("event_id") % 11
    outcome = (
        F.when(e % 97 == 5, "success").when(e % 89 == 7, "reset").when(k == 3, "conflict").when(k == 5, "permanent")
        .when(e % 101 == 9, "conflict_server_authoritative").otherwise("transient")
    )
    return f.base("events").select(
        F.concat(F.lit("k"), F.col("user_id").cast("string"), F.lit("-"), F.floor(e / 97).cast("string")).alias("client_id"), e.alias("seq"), "ts", outcome.alias("outcome")
    )


view("attempts", (), """SELECT concat('k', user_id, '-', event_id // 97) AS client_id, event_id AS seq, ts, CASE WHEN event_id % 97 = 5 THEN 'success' WHEN event_id % 89 = 7 THEN 'reset'
 WHEN event_id % 11 = 3 THEN 'conflict' WHEN event_id % 11 = 5 THEN 'permanent' WHEN event_id % 101 = 9 THEN 'conflict_server_authoritative' ELSE 'transient' END AS outcome FROM events""")
view("states", ("attempts",), """SELECT client_id, CASE WHEN o IN ('success', 'conflict_server_authoritative') THEN 'synced' WHEN o = 'reset' THEN 'sync_pending'
  WHEN o IN ('conflict', 'permanent') THEN 'dead_letter' WHEN n >= 5 THEN 'dead_letter' ELSE 'failed' END AS status, n AS attempts,
 CASE WHEN o IN ('conflict', 'permanent') THEN o WHEN o = 'transient' THEN 'transient' END AS failure_category
 FROM (SELECT client_id, arg_max(outcome, seq) AS o, count(*) FILTER (WHERE outcome <> 'reset' AND (r IS NULL OR seq > r)) AS n
  FROM (SELECT a.*, max(seq) FILTER (WHERE outcome = 'reset') OVER (PARTITION BY client_id) AS r
   FROM (SELECT *, min(seq) FILTER (WHERE outcome IN ('success', 'conflict_server_authoritative')) OVER (PARTITION BY client_id) AS e FROM attempts) a WHERE e IS NULL OR seq <= e) b GROUP BY 1) c""")


@query("t4_sync_state", with_views("states") + "SELECT * FROM states")
def _(f):
    return SY.sync_state(attempts(f)).drop("next_retry_at")


@query("t4_next_retry")
def _(f):
    return SY.sync_state(attempts(f)).filter("status = 'failed'").select("client_id", "attempts", "next_retry_at")


@query(
    "t5_queue_health",
    with_views("states")
    + """SELECT device, n AS queue_count, CASE WHEN n >= 50 THEN 'critical' WHEN n >= 40 THEN 'warning' ELSE 'normal' END AS severity, n >= 50 AS is_queue_full
 FROM (SELECT string_split(client_id, '-')[1] AS device, count(*) FILTER (WHERE status IN ('sync_pending', 'failed')) AS n FROM states GROUP BY 1) q""",
)
def _(f):
    states = SY.sync_state(attempts(f)).withColumn("device", F.substring_index("client_id", "-", 1))
    return SY.queue_health(states, ["device"])


# a request for every inspection against as many stored ones, of which a third has the keys that are sent
view("stored", ("inspections",), "SELECT id, officer_id, CASE WHEN id % 3 = 1 THEN client_id ELSE concat('old-', client_id) END AS client_id, status FROM inspections")


def sync_batch(f):
    stored = f.inspections().select(
        F.col("id").cast("string").alias("id"), F.col("officer_id").cast("string").alias("officer_id"),
        F.when(F.col("id") % 3 == 1, F.col("client_id")).otherwise(F.concat(F.lit("old-"), "client_id")).alias("client_id"), "status")
    images = f.images().select(
        F.col("inspection_id").cast("string").alias("inspection_id"), F.concat(F.lit("i"), (F.col("id") % 10).cast("string")).alias("client_id"))
    return SY.apply_sync(requests(f), stored, images, f.users(), F.lit("2026.02.01"), now())


@query(
    "t1_sync_results",
    with_views("inspections", "stored")
    + """, known AS (SELECT officer_id, client_id, arg_min(status, CAST(id AS VARCHAR)) AS status FROM stored GROUP BY 1, 2)
 SELECT r.id AS request_seq, r.client_id, CASE WHEN k.status = 'completed' THEN 'conflict' WHEN k.status IS NULL THEN 'created' ELSE 'reused' END AS outcome,
 coalesce(k.status, 'sync_pending') AS status FROM inspections r LEFT JOIN known k ON k.officer_id = r.officer_id AND k.client_id = r.client_id""",
)
def _(f):
    return sync_batch(f)["results"].select("request_seq", "client_id", "outcome", "status")


@query(
    "t1_sync_images",
    with_views("inspections", "stored", "sent", "images")
    + """, known AS (SELECT officer_id, client_id, arg_min(status, CAST(id AS VARCHAR)) AS status, min(CAST(id AS VARCHAR)) AS kid FROM stored GROUP BY 1, 2),
 r AS (SELECT i.id AS request_seq, coalesce(k.kid, concat(i.officer_id, '|', i.client_id)) AS iid, k.kid, k.status FROM inspections i
  LEFT JOIN known k ON k.officer_id = i.officer_id AND k.client_id = i.client_id),
 m AS (SELECT DISTINCT CAST(inspection_id AS VARCHAR) AS kid, concat('i', id % 10) AS cid, TRUE AS known FROM images),
 s AS (SELECT sent.*, r.iid, r.kid, row_number() OVER (PARTITION BY r.iid, cid, valid ORDER BY sent.request_seq, pos) AS rn FROM sent JOIN r ON r.request_seq = sent.request_seq
  WHERE coalesce(r.status, '') <> 'completed')
 SELECT request_seq, count(*) FILTER (WHERE new) AS images_synced, count(*) FILTER (WHERE NOT new) AS images_skipped
 FROM (SELECT s.*, valid AND rn = 1 AND m.known IS NULL AS new FROM s LEFT JOIN m ON m.kid = s.kid AND m.cid = s.cid) q GROUP BY 1""",
)
def _(f):
    return sync_batch(f)["results"].filter("outcome <> 'conflict'").select("request_seq", "images_synced", "images_skipped")


SYNC_FILES = 48  # files of a batch: each holds what PART_BYTES of orders become


@query(
    "t1_sync_target",
    with_views("inspections", "sent")
    + """SELECT CAST(i.officer_id AS VARCHAR) AS officer_id, i.client_id, 'sync_pending' AS status, count(DISTINCT s.cid) FILTER (WHERE s.valid) AS images
 FROM inspections i JOIN sent s ON s.request_seq = i.id GROUP BY 1, 2""",
)
def _(f):
    """The stored inspections and their images after a stream in which every device sends all its requests twice."""
    folder = FI.new_folder(f.spark, "sync")
    sent = requests(f).drop("request_seq")
    files = f.tasks(f.base("orders"))  # of each time, at most
    for mode in ("errorifexists", "append"):
        sent.coalesce(files).write.mode(mode).option("compression", "gzip").json(f"{folder}/in")
    target = SY.SyncTarget(f.spark, f"{folder}/out", buckets=8)
    # two batches for a small table; a large one has more of them, so that what a batch holds and shuffles does not grow with the table
    max_files = min(SYNC_FILES, files + files // 3 + 1)
    SY.sync_stream(f.spark, f"{folder}/in", target, f.users(), "2026.02.01", f"{folder}/mark", max_files=max_files).awaitTermination()
    per = target.read("images").groupBy(F.col("inspection_id").alias("id")).agg(F.count(F.lit(1)).alias("images"))
    return target.read("inspections").join(per, "id", "left").select("officer_id", "client_id", "status", F.coalesce("images", F.lit(0).cast("bigint")).alias("images"))


@query("t2_dedup_keys", with_views("inspections") + "SELECT DISTINCT CAST(officer_id AS VARCHAR) AS officer_id, client_id FROM inspections")
def _(f):
    """Keys that a stream of all captures lets through: every capture is sent twice, in several files."""
    folder = FI.new_folder(f.spark, "dedup")
    rows = f.inspections().select(F.col("officer_id").cast("string").alias("officer_id"), "client_id", F.col("created_at").cast("timestamp").alias("created_at"))
    rows.unionByName(rows).repartition(3).write.parquet(f"{folder}/in")
    stream = f.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    kept = SY.dedup_stream(stream, ["officer_id", "client_id"], delay="36500 days")
    writer = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark")
    writer.trigger(availableNow=True).start().awaitTermination()
    return f.spark.read.parquet(f"{folder}/out").select("officer_id", "client_id")


@query(
    "t12_late_counts",
    with_views("inspections")
    + """SELECT CAST(created_at AS DATE) AS day, count(*) AS records, count(*) FILTER (id % 5 * 40000 > 86400) AS late, max(id % 5 * 40000) AS max_late_seconds
 FROM inspections GROUP BY 1""",
)
def _(f):
    created = F.col("created_at").cast("timestamp")
    synced = F.timestamp_seconds(F.unix_timestamp(created) + F.col("id") % 5 * 40000)
    return SY.late_counts(f.inspections().select(created.alias("created_at"), synced.alias("synced_at")))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("t12_summary_stream", with_views("inspections", "violations", "audit_logs", "enforced", "vcount") + summary_sql())
def _(f):
    """All tables as changes in several batches: every inspection comes as a draft, then as it is; violations come before and after it."""
    folder = FI.new_folder(f.spark, "summary")
    drafts = f.inspections().withColumn("status", F.lit("draft"))
    rows = SU.changes_of(drafts, f.violations(), f.audit_logs()).unionByName(SU.changes_of(f.inspections(), seq=1))
    rows.repartition(6).write.parquet(f"{folder}/in")
    stream = f.spark.readStream.schema(SU.CHANGES).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    last = {}
    before = f.spark.conf.get(STATE_STORE)
    f.spark.conf.set(STATE_STORE, ROCKS)
    try:
        SU.incremental_summary(stream, folder, lambda df, batch: last.update(df=df, batch=batch), interval=None).awaitTermination()
    finally:
        f.spark.conf.set(STATE_STORE, before)
    return last["df"]
