"""Windowed monitoring.

Each function takes a table of events or a stream of them; on a stream, put the
watermark on before the call (``watermarked``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import TimestampType

from panelcheck import fixed_values as V
from panelcheck.functions.joins import last_row


def watermarked(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time as TIMESTAMP (a time without zone cannot carry a watermark) with a watermark."""
    return _timed(events).withWatermark("ts", delay)


def newest_windows(windows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Every window as it stands when a stream has read what there is.

    Runs in update mode: a batch writes the windows it changed into a folder of its own, which a replay overwrites, and the newest version of a
    window counts.  Rows whose windows the watermark has closed change nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/batch={batch_id}")

    writer = windows.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    versions = windows.sparkSession.read.option("basePath", f"{folder}/windows").parquet(f"{folder}/windows")
    return last_row(versions, keys, [F.col("batch")], windows.columns)


def _timed(events: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP.  A column that is one stays untouched: a cast, even to its own type, would lose the watermark."""
    return events if isinstance(events.schema["ts"].dataType, TimestampType) else events.withColumn("ts", F.col("ts").cast("timestamp"))


def _window(length: str, slide: str | None = None) -> Column:
    return F.window("ts", length, slide or length).alias("w")


def _bounds(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").alias("window_start"), *[c for c in df.columns if c != "w"])


def alert_5xx(events: DataFrame, slide: str = "1 minute") -> DataFrame:
    """Share of 5xx answers in sliding two-minute windows."""
    bad = F.count_if(F.col("status_code").between(500, 599))
    rows = _timed(events).groupBy(_window(V.ALERT_5XX["window"], slide)).agg(F.count(F.lit(1)).alias("requests"), bad.alias("errors"))
    ratio = F.col("errors") / F.col("requests")
    return _bounds(rows).withColumn("ratio", ratio).withColumn("firing", F.col("ratio") > V.ALERT_5XX["ratio"])


def bucket_quantile(counts: Column, total: Column, q: float, bounds: list[float]) -> Column:
    """Quantile from cumulative bucket counts, linear inside a bucket; above the last bound it is that bound."""
    rank = total * q
    out = None
    for i, hi in enumerate(bounds):
        lo = bounds[i - 1] if i else 0.0
        below = F.get(counts, i - 1) if i else F.lit(0)
        here = F.get(counts, i)
        value = F.lit(lo) + (hi - lo) * (rank - below) / (here - below)
        out = (F.when if out is None else out.when)(here >= rank, value)
    return out.otherwise(F.lit(bounds[-1]))


def latency_quantiles(events: DataFrame, length: str = "5 minutes", slide: str | None = None, bounds: list[float] | None = None) -> DataFrame:
    """p50, p95 and p99 from histogram buckets; only one row of counts per window is shuffled."""
    bounds = bounds or V.LATENCY_BUCKETS
    rows = _timed(events).groupBy(_window(length, slide)).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("value") <= b) for b in bounds]).alias("counts")
    )
    p = lambda q: F.round(bucket_quantile(F.col("counts"), F.col("n"), q, bounds), 6)
    return _bounds(rows).select("window_start", "n", p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def latency_alerts(quantiles: DataFrame, limit: float = V.ALERT_P95["request_seconds"]) -> DataFrame:
    return quantiles.withColumn("firing", F.col("p95") > limit)


def approximate_quantiles(events: DataFrame, length: str = "5 minutes") -> DataFrame:
    """Quantiles from a sketch of the values instead of buckets."""
    rows = _timed(events).groupBy(_window(length)).agg(F.percentile_approx("value", [0.5, 0.95, 0.99], 1000).alias("p"))
    return _bounds(rows).select("window_start", *[F.get("p", i).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def alert_sync_conflicts(events: DataFrame, slide: str = "1 minute") -> DataFrame:
    """Conflicts per second over all operations per second, with a floor under the latter."""
    a = V.ALERT_CONFLICT
    rows = _timed(events).groupBy(_window(a["window"], slide)).agg(
        F.count(F.lit(1)).alias("operations"), F.count_if(F.col("status") == "conflict").alias("conflicts")
    )
    ratio = (F.col("conflicts") / 300.0) / F.greatest(F.col("operations") / 300.0, F.lit(a["floor"]))
    return _bounds(rows).withColumn("ratio", ratio).withColumn("firing", F.col("ratio") > a["ratio"])


def event_rates(events: DataFrame, keys: list[str], length: str = "1 minute", seconds: float = 60.0) -> DataFrame:
    """Events per second by the given labels in tumbling windows."""
    rows = _timed(events).groupBy(_window(length), *keys).agg(F.count(F.lit(1)).alias("n"))
    return _bounds(rows).withColumn("rate", F.col("n") / seconds)


def domain_counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals by label; on a stream use update mode."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))


def inspection_counters(inspections: DataFrame) -> DataFrame:
    """Totals by verdict, category and self-check flag."""
    verdict = F.when(F.col("status") == "completed", "compliant").otherwise("non_compliant")
    rows = inspections.filter(F.col("status").isin("completed", "needs_review")).select(
        verdict.alias("overall_verdict"), F.coalesce(F.nullif("commodity_category", F.lit("")), F.lit("general")).alias("commodity_category"),
        F.col("is_self_check").cast("string").alias("is_self_check"),
    )
    return domain_counters(rows, ["overall_verdict", "commodity_category", "is_self_check"])


def _across(runs: DataFrame, keys: list[str], size: int, larger: int, shift: int) -> DataFrame:
    """Runs that reach a border of their piece (``size`` minutes) are joined to those that go on across it, inside larger pieces."""
    reaches = (F.pmod("first", F.lit(size)) == 0) | (F.pmod("last", F.lit(size)) == size - 1)
    placed = runs.withColumn("open", reaches).withColumn("piece", F.when(F.col("open"), F.floor((F.col("first") + shift) / larger)).otherwise(F.floor(F.col("first") / size)))
    order = W.partitionBy(*keys, "open", "piece").orderBy("first")
    linked = placed.withColumn("fresh", F.coalesce(F.col("first") != F.lag("last").over(order) + 1, F.lit(True)).cast("int"))
    return linked.withColumn("run", F.sum("fresh").over(order)).groupBy(*keys, "open", "piece", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("open", "piece", "run")


def sustained(alerts: DataFrame, minutes: int, keys: list[str] | None = None) -> DataFrame:
    """Runs of consecutive firing minutes that last long enough.

    Input is one row per window, already aggregated, so a series is as long as
    its time range and no longer.
    """
    keys = keys or []
    minute = F.floor(F.unix_timestamp("window_start") / 60)
    fired = alerts.filter("firing").select(*keys, "window_start", minute.alias("minute"))
    # a day is its own partition for numbering, so runs are joined across midnight below
    w = W.partitionBy(*keys, F.floor(F.col("minute") / 1440)).orderBy("minute")
    runs = (
        fired.withColumn("island", F.col("minute") - F.row_number().over(w))
        .groupBy(*keys, F.floor(F.col("minute") / 1440).alias("day"), "island")
        .agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
    )
    runs = runs.select(*keys, "first", "last")
    # a run that reaches no border of its piece is whole; the others, at most two a piece, meet in the next larger pieces
    # days, 1024 days, and all minutes that a timestamp can have
    for size, larger, shift in ((1440, 1440 << 10, 0), (1440 << 10, 1440 << 24, 1440 << 23)):
        runs = _across(runs, keys, size, larger, shift)
    return (
        runs.filter(F.col("last") - F.col("first") >= minutes)
        .select(*keys, F.timestamp_seconds(F.col("first") * 60).alias("started_at"), F.timestamp_seconds(F.col("last") * 60).alias("ended_at"))
    )
