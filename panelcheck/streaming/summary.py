"""The dashboard summary kept up to date by what changes, not by reading the tables again.

A stream of change rows is grouped by slot, a hash of the inspection.  The state of a slot holds the latest row and the violations of each of its inspections,
so a batch knows what an inspection added to every number before and adds now; only the differences leave it.  A batch adds their sums to the totals, one row
per number and officer, and writes them as the batch's own version: a batch that runs again reads the version before it and writes the
same.  A call into Python costs milliseconds, an inspection in it microseconds: with a state of its own for each inspection nearly all time went into
calls.  A batch reads and writes the slots of its inspections, each a ``SLOTS``-th of all states, and nothing else of the tables.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelcheck.functions.expr import ratio

CHANGES = "entity string, kind string, seq bigint, officer_id string, status string, is_self_check boolean, severity string, sign int"
COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
NOTHING = [None, None, None, None, 0, 0, 0, 0]  # seq, officer, status, is_self_check, violations, and those of each severity
SLOTS = 1024  # of a stream: fixed for its checkpoint
DELTAS = "metric string, officer_id string, delta bigint"
SEVERITIES = ("critical", "major", "moderate")
STATUSES = ("completed", "needs_review", "draft")


def changes_of(inspections: DataFrame | None = None, violations: DataFrame | None = None, audit_logs: DataFrame | None = None, seq=0, sign: int = 1) -> DataFrame:
    """Rows of the domain tables as changes.  ``seq`` orders the versions of an inspection; sign -1 takes violations or audit rows back."""
    none = lambda kind: F.lit(None).cast(kind)
    order = seq if not isinstance(seq, int) else F.lit(seq)
    parts = []
    if inspections is not None:
        parts.append(inspections.select(
            F.col("id").cast("string").alias("entity"), F.lit("inspection").alias("kind"), order.cast("bigint").alias("seq"), F.col("officer_id").cast("string").alias("officer_id"),
            "status", "is_self_check", none("string").alias("severity"), F.lit(1).alias("sign")))
    if violations is not None:
        parts.append(violations.select(
            F.col("inspection_id").cast("string").alias("entity"), F.lit("violation").alias("kind"), order.cast("bigint").alias("seq"), none("string").alias("officer_id"),
            none("string").alias("status"), none("boolean").alias("is_self_check"), "severity", F.lit(sign).alias("sign")))
    if audit_logs is not None:  # counted only: any spread of keys will do
        parts.append(audit_logs.select(
            F.concat(F.lit("audit-"), F.pmod(F.xxhash64("id"), F.lit(256)).cast("string")).alias("entity"), F.lit("audit").alias("kind"), order.cast("bigint").alias("seq"),
            none("string").alias("officer_id"), none("string").alias("status"), none("boolean").alias("is_self_check"), none("string").alias("severity"), F.lit(sign).alias("sign")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contribution(state: list | None) -> Counter:
    """What an inspection adds to each (metric, officer); nothing before its own row has come, nor as a self-check."""
    if state is None or state[0] is None or state[3] is not False:
        return Counter()
    _, officer, status, _, n, *by_severity = state
    out = Counter({("total_inspections", None): 1, ("total_violations", None): n})
    if officer is not None:
        out["officer", officer] = 1
    if status in STATUSES:
        out[f"{status}_inspections", None] = 1
    if status == "completed":
        out["violation_inspections" if n else "compliant_inspections", None] = 1
    out.update({(f"{s}_violations", None): k for s, k in zip(SEVERITIES, by_severity, strict=True)})
    return out


class SummaryProcessor(StatefulProcessor):
    """Differences that a batch makes to the totals, by slot.  The state is the JSON text of the slot's inspections."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("inspections", "entities string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get() if self.state.exists() else None
        states = {e: s for e, s in json.loads(stored[0])} if stored else {}
        old: dict[str | None, list | None] = {}
        audits = 0
        for frame in rows:
            for entity, kind, at, officer, status, own, severity, sign in zip(*(frame[c].tolist() for c in COLUMNS), strict=True):
                if kind == "audit":
                    audits += int(sign)
                    continue
                entity = None if pd.isna(entity) else entity
                if entity not in old:
                    old[entity] = states.get(entity)
                    states[entity] = list(old[entity] or NOTHING)
                new = states[entity]
                if kind == "violation":
                    new[4] += int(sign)
                    if severity in SEVERITIES:
                        new[5 + SEVERITIES.index(severity)] += int(sign)
                elif new[0] is None or at >= new[0]:
                    new[:4] = int(at), None if pd.isna(officer) else officer, None if pd.isna(status) else status, None if pd.isna(own) else bool(own)
        delta = Counter({("total_audit_overrides", None): audits})
        changed = [e for e, was in old.items() if states[e] != (was or NOTHING)]
        for e in changed:
            delta.update(contribution(states[e]))
            delta.subtract(contribution(old[e]))
        if changed:
            self.state.update((json.dumps([[e, s] for e, s in states.items() if s != NOTHING], separators=(",", ":")),))
        found = [(*k, v) for k, v in delta.items() if v]
        if found:
            yield pd.DataFrame(found, columns=["metric", "officer_id", "delta"])

    def close(self) -> None:
        pass


def summary_of(totals: DataFrame) -> DataFrame:
    """The summary row of the totals (metric, officer_id, delta)."""
    of = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("delta"))), F.lit(0).cast("bigint"))
    clean, dirty = of("compliant_inspections"), of("violation_inspections")
    counts = ["total_inspections", *(f"{s}_inspections" for s in STATUSES), "compliant_inspections", "violation_inspections"]
    return totals.agg(
        *[of(m).alias(m) for m in counts], ratio(clean, clean + dirty, 2, 100.0).alias("overall_compliance_rate"),
        *[of(f"{s}_violations").alias(f"{s}_violations") for s in ("total", *SEVERITIES)],
        F.count_if((F.col("metric") == "officer") & (F.col("delta") > 0)).alias("active_officers_count"), of("total_audit_overrides").alias("total_audit_overrides"),
    )


def incremental_summary(changes: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], interval: str | None = "15 seconds") -> StreamingQuery:
    """Keeps the summary of a stream of ``changes``; needs the RocksDB state store.

    ``sink(df, batch_id)`` gets the summary row after every batch.  ``folder`` holds the checkpoint and the totals of the
    batches, of which only the last two are ever read.
    """
    spark: SparkSession = changes.sparkSession
    slot = F.pmod(F.xxhash64("entity"), F.lit(SLOTS)).cast("int")
    deltas = changes.withColumn("slot", slot).groupBy("slot").transformWithStateInPandas(statefulProcessor=SummaryProcessor(), outputStructType=DELTAS, outputMode="Update", timeMode="None")

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("metric", "officer_id", "delta")
        if batch_id:
            rows = rows.unionByName(spark.read.schema(DELTAS).parquet(f"{folder}/totals/{batch_id - 1}"))
        totals = rows.groupBy("metric", "officer_id").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
        totals.write.mode("overwrite").parquet(f"{folder}/totals/{batch_id}")
        sink(summary_of(spark.read.schema(DELTAS).parquet(f"{folder}/totals/{batch_id}")), batch_id)

    writer = deltas.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
