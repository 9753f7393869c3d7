"""Streaming results equal the results of the same functions on tables."""

import datetime as dt
import time
import uuid

import pytest
from pyspark.sql import functions as F

from panelcheck.plans.catalog.flows import attempts, metric_events, requests
from panelcheck.streaming import monitor as MO
from panelcheck.streaming import sync as SY


@pytest.fixture()
def place(tmp_path):
    return str(tmp_path)


def stream_of(spark, df, folder, files=3):
    df.repartition(files).write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(stream, mode):
    name = "q" + uuid.uuid4().hex
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def key(df):
    return sorted(map(str, df.collect()))


def test_windowed_alerts_equal_the_batch(spark, fx, place):
    events = metric_events(fx).withColumn("ts", F.col("ts").cast("timestamp"))
    live = MO.alert_5xx(MO.watermarked(stream_of(spark, events, place), "60 days"))
    assert key(run(live, "complete")) == key(MO.alert_5xx(events))


def test_late_events_change_no_closed_window(spark, place):
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    table = lambda minutes: spark.createDataFrame([(at(m), 503) for m in minutes], "ts timestamp, status_code int")
    # minutes 1 and 2 come again when the watermark has passed them, minute 55 when it has not
    for minutes in ([0, 1, 2], [60], [61], [1, 2, 55]):
        table(minutes).coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = MO.watermarked(spark.readStream.schema("ts timestamp, status_code int").parquet(f"{place}/in"))
        live = MO.newest_windows(MO.alert_5xx(stream), ["window_start"], place)
    assert key(live) == key(MO.alert_5xx(table([0, 1, 2, 60, 61, 55])))


def test_counters_equal_the_batch(spark, fx, place):
    rows = fx.images().select("image_role", "quality_check_passed")
    live = run(MO.domain_counters(stream_of(spark, rows, place), ["image_role", "quality_check_passed"]), "update")
    last = live.groupBy("image_role", "quality_check_passed").agg(F.max("total").alias("total"))
    assert key(last) == key(MO.domain_counters(rows, ["image_role", "quality_check_passed"]))


def test_retry_state_equals_the_batch(spark, fx, place):
    events = attempts(fx).withColumn("ts", F.col("ts").cast("timestamp"))
    # events of a key must arrive in order, as one device sends them
    cut = events.agg(F.max("seq").alias("m")).collect()[0].m // 2
    for i, part in enumerate((events.filter(F.col("seq") <= cut), events.filter(F.col("seq") > cut))):
        part.coalesce(1).write.mode("append").parquet(f"{place}/in")
    live = SY.sync_state_stream(
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in").withColumn("order", F.lit(0)).drop("order")
    )
    state = F.struct("status", "attempts", "failure_category")
    got = run(live, "update").groupBy("client_id").agg(F.max_by(state, "last_seq").alias("s")).select("client_id", "s.*")
    want = SY.sync_state(events).select("client_id", "status", "attempts", "failure_category")
    assert key(got) == key(want) and events.filter("outcome = 'reset'").count() > 0


def test_replayed_and_late_events_change_nothing(spark, place):
    def event(client, seq, outcome):
        return (client, seq, dt.datetime(2026, 1, 1, 0, 0, seq), outcome)

    schema = "client_id string, seq bigint, ts timestamp, outcome string"
    first = [event("a", 1, "transient"), event("a", 3, "transient"), event("b", 1, "transient"), event("b", 2, "reset")]
    again = [event("a", 1, "transient"), event("a", 2, "permanent"), event("b", 2, "reset"), event("b", 3, "transient")]
    for rows in (first, again):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
        time.sleep(1.1)
    live = SY.sync_state_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in"))
    last = run(live, "update").groupBy("client_id").agg(F.max_by(F.struct("status", "attempts"), "last_seq").alias("s")).select("client_id", "s.*")
    assert sorted(map(tuple, last.collect())) == [("a", "failed", 2), ("b", "failed", 1)]


def test_requests_that_differ_anywhere_are_two(spark):
    base = {"officer_id": "1", "client_id": "c", "created_at": dt.datetime(2026, 1, 1), "commodity_category": "food", "region": "n"}
    rows = [base, base | {"commodity_category": "general"}, base | {"region": None}, base]
    table = spark.createDataFrame(rows, "officer_id string, client_id string, created_at timestamp, commodity_category string, region string")
    names = [r["request_seq"] for r in SY.number_requests(table).collect()]
    assert len(set(names)) == 4 and sorted(names) == sorted(r["request_seq"] for r in SY.number_requests(table.repartition(3)).collect())


def test_backoff_column_equals_the_function(spark):
    rows = spark.createDataFrame([(a, f"k{a}") for a in range(8)], "a int, k string").select("a", "k", SY.backoff_column(F.col("a"), F.col("k")).alias("ms"))
    assert all(r.ms == SY.backoff_ms(r.a, r.k) for r in rows.collect())


def test_dedup_stream(spark, fx, place):
    rows = fx.inspections().select("officer_id", "client_id", "created_at")
    twice = rows.unionByName(rows)
    out = run(SY.dedup_stream(stream_of(spark, twice, place), ["officer_id", "client_id"], delay="36500 days"), "append")
    assert out.count() == rows.select("officer_id", "client_id").distinct().count()


def test_sync_twice_is_sync_once(spark, fx, place):
    sent = requests(fx).filter("request_seq < 200").drop("request_seq")
    sent.repartition(3).write.json(f"{place}/in")
    target = SY.SyncTarget(spark, f"{place}/out", buckets=4)

    def go(source, mark):
        q = SY.sync_stream(spark, source, target, fx.users(), "2026.02.01", f"{place}/{mark}", max_files=1)
        q.awaitTermination(240)
        assert q.exception() is None

    go(f"{place}/in", "c1")
    first = (target.read("inspections").count(), target.read("images").count())
    assert first[0] == sent.select("officer_id", "client_id").distinct().count() > 0
    # the same payload again, as later batches of the same stream
    sent.repartition(2).write.mode("append").json(f"{place}/in")
    go(f"{place}/in", "c1")
    assert (target.read("inspections").count(), target.read("images").count()) == first
    results = target.results()
    late = results.filter(F.col("batch_id") >= 3)
    assert late.agg(F.sum("images_synced")).collect()[0][0] == 0 and late.filter("outcome = 'created'").count() == 0


NUMBERS = {"rows": ("k string, v bigint", ["k"])}


def test_target_reads_only_touched_buckets_and_merges(spark, place):
    from panelcheck.streaming.target import MERGE, BucketedTarget

    target = BucketedTarget(spark, place, NUMBERS, buckets=3)
    assert target.stored("rows").collect() == [] and target.latest() is None
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v bigint")
    for batch in range(MERGE + 3):
        target.commit(batch, {"rows": row("hot", batch)})
    touched = target.touched(row("hot", 0), ["k"])
    assert len(touched) == 1 and len(target.folders("rows", touched)) < MERGE
    assert sorted(r.v for r in target.stored("rows", touched).collect()) == list(range(MERGE + 3))
    # other buckets do not add to what a batch of this key opens; a null key and an empty batch count too
    before = target.folders("rows", touched)
    target.commit(MERGE + 3, {"rows": spark.createDataFrame([(f"k{i}", i) for i in range(50)] + [(None, 7)], "k string, v bigint").filter(~target.bucket(["k"]).isin(touched))})
    assert target.folders("rows", touched) == before and target.stored("rows").count() > MERGE + 3
    target.commit(MERGE + 4, {"rows": row("x", 1).limit(0)})
    assert target.folders("rows", touched) == before
    with pytest.raises(ValueError):
        target.commit(MERGE + 5, {"rows": row("x", 1).withColumn("more", F.lit(1))})


def test_failed_batch_leaves_nothing_visible(spark, place):
    from panelcheck.streaming.target import BucketedTarget

    two = NUMBERS | {"more": ("k string, v bigint", ["k"])}
    target = BucketedTarget(spark, place, two, buckets=2)
    good = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v bigint")
    target.commit(0, {"rows": good})
    bad = good.withColumn("v", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        target.commit(1, {"rows": good, "more": bad})
    assert target.latest() == 0 and sorted(map(tuple, target.stored("rows").collect())) == [("a", 1), ("b", 2)]
    for _ in range(2):  # the batch again, and once more as a replay
        target.commit(1, {"rows": good, "more": good})
        assert target.stored("rows").count() == 4 and target.stored("more").count() == 2


def test_clock_of_a_batch_is_kept(spark, place):
    target = SY.SyncTarget(spark, place)
    first = target.clock(3)
    assert target.clock(3) == first and target.clock(4) >= first


def test_summary_stream(spark, fx, place):
    rows = fx.inspections().select("id")
    seen = []
    q = SY.summary_stream(
        stream_of(spark, rows, place, 2), lambda: (fx.inspections(), fx.violations(), fx.audit_logs()),
        lambda df, batch: seen.append(df.collect()[0].asDict()), f"{place}/c", None,
    )
    q.awaitTermination(240)
    assert q.exception() is None and len(seen) == 2 and seen[0] == seen[1] and seen[0]["total_inspections"] > 0


def test_incremental_summary_equals_recomputation_after_every_batch(spark, fx, place):
    from panelcheck.operators.analytics import analytics_summary
    from panelcheck.streaming import summary as SU

    i, v, a = (d.cache() for d in (fx.inspections(), fx.violations(), fx.audit_logs()))
    drafts, half = i.withColumn("status", F.lit("draft")), F.col("id") % 2 == 0
    gone = F.col("id") % 5 == 0
    steps = [
        (SU.changes_of(drafts.filter(half), v, a.filter(half)), (drafts.filter(half), v, a.filter(half))),
        (SU.changes_of(i, None, a.filter(~half), seq=2), (i, v, a)),
        # an old version comes late and changes nothing; some violations are taken back
        (SU.changes_of(drafts, seq=1).unionByName(SU.changes_of(None, v.filter(gone), sign=-1)), (i, v.filter(~gone), a)),
    ]
    seen = {}
    for changes, tables in steps:
        changes.coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(SU.CHANGES).parquet(f"{place}/in")
        SU.incremental_summary(stream, str(place), lambda df, batch: seen.update({batch: df.first().asDict()}), interval=None).awaitTermination()
        assert seen[max(seen)] == analytics_summary(*tables).first().asDict()
    assert len(seen) == len(steps)


def test_sustained_runs_cross_midnight_and_larger_borders(spark):
    import random

    rng = random.Random(5)
    big = 1440 << 10
    minutes = set(range(1430, 1450)) | set(range(2 * big - 4000, 2 * big + 3000)) | set(range(-10, 4)) | {1439 + 1440 * 9} | {rng.randrange(20 * 1440) for _ in range(8000)}
    rows = [(k, dt.datetime.fromtimestamp(m * 60, dt.timezone.utc), m in minutes) for k in ("a", "b") for m in sorted(minutes | {5000, 5001})]
    df = spark.createDataFrame(rows, "name string, window_start timestamp, firing boolean")
    want, begun, last = [], None, None
    for m in [*sorted(minutes), None]:
        if last is not None and m != last + 1:
            want += [(begun, last)] if last - begun >= 3 else []
            begun = m
        begun, last = m if begun is None else begun, m
    at = lambda c: (F.unix_timestamp(c) / 60).cast("bigint")
    plain = sorted(tuple(r) for r in MO.sustained(df.filter("name = 'a'"), 3).select(at("started_at"), at("ended_at")).collect())
    keyed = sorted(tuple(r) for r in MO.sustained(df, 3, ["name"]).select("name", at("started_at"), at("ended_at")).collect())
    assert plain == want and keyed == [(k, *w) for k in "ab" for w in want]


def test_sync_target_keeps_what_devices_send_compressed(spark, folder, place, monkeypatch):
    """Both times are sent whole, in two batches, and no file holds plain text: that took most of the disk."""
    import glob

    from __spark_entry__ import queries
    from panelcheck.sources import files as FI

    monkeypatch.setattr(FI, "new_folder", lambda spark, name: f"{place}/{name}")
    rows = queries()["t1_sync_target"](spark, folder)
    files = glob.glob(f"{place}/sync/in/part-*")
    assert files and all(x.endswith(".json.gz") for x in files)
    sent, results = spark.read.json(f"{place}/sync/in"), spark.read.parquet(f"{place}/sync/out/results")
    assert sent.count() == results.count() > 0 and results.select("batch_id").distinct().count() == 2
    assert rows.count() == sent.select("officer_id", "client_id").distinct().count()


def test_summary_state_is_kept_by_slot(spark, place, monkeypatch):
    """Fifty inspections in three states, not fifty: a call for each of them took nearly all of the time.  A null id is an inspection too."""
    from panelcheck.streaming import summary as SU

    monkeypatch.setattr(SU, "SLOTS", 3, raising=False)
    row = lambda e, seq, status, officer="o1": (e, "inspection", seq, officer, status, False, None, 1)
    bad = lambda e, severity, sign=1: (e, "violation", 0, None, None, None, severity, sign)
    ids = [None, 'é"\n', *(f"i{k}" for k in range(48))]
    steps = [
        [bad("i1", "critical"), *(row(e, 1, "draft") for e in ids), ("audit-1", "audit", 0, None, None, None, None, 1)],
        [row(None, 2, "completed", None), row("i1", 2, "completed", "o2"), row("i2", 0, "completed"), bad("i2", "minor"), row("i3", 2, "completed"), bad(None, "major")],
        [bad("i1", "critical", -1)],
    ]
    rows = []
    for changes in steps:
        spark.createDataFrame(changes, SU.CHANGES).coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(SU.CHANGES).parquet(f"{place}/in")
        q = SU.incremental_summary(stream, place, lambda df, batch: rows.append(df.first()), interval=None)
        q.awaitTermination(240)
        assert q.exception() is None
    of = lambda r: (r.total_inspections, r.draft_inspections, r.compliant_inspections, r.violation_inspections, r.total_violations, r.critical_violations, r.active_officers_count, r.total_audit_overrides)
    assert [of(r) for r in rows] == [(50, 50, 0, 0, 1, 1, 1, 1), (50, 47, 1, 2, 3, 1, 2, 1), (50, 47, 2, 1, 2, 0, 2, 1)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
