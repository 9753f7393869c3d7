"""What several operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcheck.sources.files import written_parquet


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package; where it isn't installed, they find it beside the driver's copy.
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe when executors are lost."""
    return written_parquet(df.sparkSession, df, name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``rank``: the row's place, from 0, in the order of the whole table (``order`` is unique).

    One range sort deals all rows evenly, whatever their keys; a row's rank is its place in its
    partition plus the sizes of the partitions before, of which there are no more than tasks.
    """
    placed = written(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), name)
    part, index = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg((F.max(index) + 1).alias("size"))
    before = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(starts, part == F.col("part")).select(*df.columns, (F.col("start") + index).alias("rank"))


def per_text(
    df: DataFrame, keep: list[str], text: str, fn: Callable[[str | None], tuple], schema: str, make: Callable[[], object] | None = None
) -> DataFrame:
    """One row per row of ``df``: the kept columns as they are, then the fields that ``fn`` returns for the text.

    ``make`` builds, once per task, a state that ``fn`` gets as its second argument.
    """
    source = df.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = fields_of(schema)
    kinds = [pa_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (make(),) if make else ()
        for batch in batches:
            rows = [fn(t, *state) for t in batch.column(len(keep)).to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{head}, {schema}")


def fields_of(ddl: str) -> list:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl).fields


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def span_digest(spans: list[tuple[int, int, str, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    """``kind:start:end`` of (start, rank of the kind, kind, end), comma-joined in that order."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def spans_text(spans):
    """The same text from an array column of structs (start, ord, kind, end, ...)."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(spans), one))
