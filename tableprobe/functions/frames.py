"""Small helpers to shape results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import col


_ARROW = {
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
    T.DoubleType(): pa.float64(),
    T.StringType(): pa.string(),
    T.BooleanType(): pa.bool_(),
    T.TimestampType(): pa.timestamp("us", tz="UTC"),
    T.ArrayType(T.StringType()): pa.list_(pa.string()),
}


def report_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A DataFrame for facts about columns or files, which number at most a few per column.

    Built from an Arrow table, it is a local relation: no Python worker has to start.
    """
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(list(v), _ARROW[f.dataType]) for v, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=fields.names), schema=fields)


def per_column(
    df: DataFrame, values: Mapping[str, Column], aggregates: Mapping[str, Column], steps: Sequence[Mapping[str, Column]] = ()
) -> DataFrame:
    """Aggregate many columns of one kind: (position, column, *aggregates), a row for each.

    ``values`` maps a column name to an expression, all of one type; ``aggregates``
    are written over ``value`` (and ``id``, which is c0, c1, ... in the given order). The columns are stacked into rows inside the scan
    stage and folded before the shuffle, so the generated code holds the aggregates
    once instead of once per column and stays small however wide the table is.
    ``steps`` are columns to derive from ``value`` first, so that aggregates share them.
    """
    names = list(values)
    labels = report_frame(df.sparkSession, list(enumerate(names)), "position int, column string")
    if not names:
        return labels.select("*", *[F.lit(None).alias(k) for k in aggregates])
    ids = [f"c{i}" for i in range(len(names))]
    stacked = df.select(*[values[n].alias(i) for i, n in zip(ids, names)]).unpivot([], ids, "id", "value")
    for step in steps:
        stacked = stacked.select("*", *[v.alias(k) for k, v in step.items()])
    folded = stacked.groupBy("id").agg(*[v.alias(k) for k, v in aggregates.items()])
    counts = {f.name for f in folded.schema.fields if isinstance(f.dataType, T.LongType)}
    # The result has one row per column of the table.
    return labels.join(F.broadcast(folded), F.concat(F.lit("c"), F.col("position")) == F.col("id"), "left").select(
        "position", "column", *[F.coalesce(k, F.lit(0)).alias(k) if k in counts else F.col(k) for k in aggregates]
    )


def one_row_per_column(df: DataFrame, fields: dict[str, dict[str, Column]]) -> DataFrame:
    """Like ``per_column`` where every column needs its own aggregates.

    ``fields`` maps a column name to {result field: aggregate}; all columns share
    the same result fields.
    """
    names = list(fields)
    packed = df.agg(
        *[F.struct(*[v.alias(k) for k, v in fields[n].items()]).alias(f"s{i}") for i, n in enumerate(names)]
    )
    entries = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.col(f"s{i}").alias("s")) for i, n in enumerate(names)]
    )
    return packed.select(F.inline(entries)).select("position", "column", "s.*")


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating column, for display or comparison."""
    return df.select(
        *[
            F.round(col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)
            for f in df.schema.fields
        ]
    )
