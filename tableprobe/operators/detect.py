"""Finding columns that hold dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import col, is_text, is_time, percent
from tableprobe.functions.dates import to_timestamp
from tableprobe.functions.frames import report_frame

PARSE_SHARE = 70.0
NEAR_MISS_SHARE = 50.0
LONG_TEXT = 64


def _candidates(df: DataFrame) -> list[str]:
    """Text columns, apart from those already marked as categories."""
    return [
        f.name for f in df.schema.fields if is_text(f.dataType) and (f.metadata or {}).get("logical") != "categorical"
    ]


def _parsed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(id, filled, parsed): how many values of each column there are, and how many read as dates.

    Equal texts are folded first, so each is read once, and reading is spread over the tasks
    of that shuffle however few tasks the table is scanned by. Long texts do not travel.
    """
    value, long = F.col("value"), F.length("value") > LONG_TEXT
    stacked = df.select(*[col(c).alias(str(i)) for i, c in enumerate(names)]).unpivot([], [str(i) for i in range(len(names))], "id", "value")
    texts = stacked.where(value.isNotNull()).select(
        F.col("id").cast("int").alias("id"),
        F.when(~long, value).alias("value"),
        F.when(long, to_timestamp(value).isNotNull()).alias("long_parsed"),
    )
    folded = texts.groupBy("id", "value", "long_parsed").agg(F.count(F.lit(1)).alias("n"))
    parsed = F.coalesce(F.col("long_parsed"), to_timestamp(value).isNotNull())
    return folded.groupBy("id").agg(F.sum("n").alias("filled"), F.sum(F.when(parsed, F.col("n")).otherwise(0)).alias("parsed"))


def datetime_detection_summary(df: DataFrame) -> DataFrame:
    """(column, detected, confidence, invalid) for native and parseable date columns.

    All values are read, so the share and the invalid count are exact.
    """
    native = [f.name for f in df.schema.fields if is_time(f.dataType)]
    names = _candidates(df)
    schema = "position int, column string, detected string, confidence double, invalid bigint"
    order = {c: i for i, c in enumerate(df.columns)}
    out = report_frame(df.sparkSession, [(order[c], c, "native", 100.0, 0) for c in native], schema)
    if names:
        scores = _parsed(df, names)
        text = scores.select(
            F.get(F.array(*[F.lit(order[c]) for c in names]), "id").alias("position"),
            F.get(F.array(*[F.lit(c) for c in names]), "id").alias("column"),
            F.lit("parseable").alias("detected"),
            percent(F.col("parsed"), F.col("filled")).alias("confidence"),
            (F.col("filled") - F.col("parsed")).alias("invalid"),
        )
        out = out.unionByName(text.where(F.col("confidence") >= NEAR_MISS_SHARE))
    return out.orderBy("position").drop("position")


def detect_datetime_columns(df: DataFrame) -> list[str]:
    """Names of columns that are dates or read as dates."""
    return [r["column"] for r in datetime_detection_summary(df).collect() if r["confidence"] >= PARSE_SHARE]
