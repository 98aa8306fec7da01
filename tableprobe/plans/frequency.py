"""Value counts in long form: one shuffle serves distinct counts, modes, top lists and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import as_number, col, is_integral, is_numeric, is_text
from tableprobe.functions.frames import per_column, report_frame
from tableprobe.functions.text import short_key
from tableprobe.plans.ordered import chunk_rows, running
from tableprobe.plans.selection import selected_quantiles
from tableprobe.plans.storage import materialize


def _long(df: DataFrame, columns: Sequence[str], values: list[Column]) -> DataFrame:
    """Unpivot to (column, value) without nulls and count equal values."""
    names = [f"c{i}" for i in range(len(columns))]
    wide = df.select(*[v.alias(n) for v, n in zip(values, names)])
    labels = F.create_map(*[x for n, c in zip(names, columns) for x in (F.lit(n), F.lit(c))])
    return (
        wide.unpivot([], names, "column", "value")
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("column", labels[F.col("column")])
    )


def value_texts(df: DataFrame, columns: Sequence[str], short: bool = False) -> list[Column]:
    """What stands for a value of any simple type when equal ones are counted."""
    values = []
    for c in columns:
        dtype = df.schema[c].dataType
        # Adding zero folds -0.0 into 0.0 so that both count as one value.
        x = as_number(col(c), dtype) + F.lit(0.0) if isinstance(dtype, (T.FloatType, T.DoubleType)) else col(c)
        text = x.cast("string")
        values.append(short_key(text) if short and is_text(dtype) else text)
    return values


def value_counts(df: DataFrame, columns: Sequence[str], short: bool = False) -> DataFrame:
    """(column, value as text, n) for columns of any simple type.

    ``short`` lets digests stand in for long text, for callers who only count.
    """
    return _long(df, columns, value_texts(df, columns, short))


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """(column, unique). Exact counts shuffle every distinct value; a sketch per column does not."""
    if approx:
        sketch = F.hll_sketch_estimate(F.hll_sketch_agg("value", F.lit(12)))
        return per_column(df, {c: col(c).cast("string") for c in columns}, {"unique": sketch}).drop("position")
    return value_counts(df, columns, short=True).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))


def number_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as double, n) for numeric columns; whole numbers are counted exactly."""
    whole = [c for c in columns if is_integral(df.schema[c].dataType)]
    other = [c for c in columns if c not in whole]
    parts = []
    if whole:
        counts = _long(df, whole, [col(c).cast("bigint") for c in whole])
        parts.append(counts.withColumn("value", F.col("value").cast("double")))
    if other:
        parts.append(_long(df, other, [as_number(col(c), df.schema[c].dataType) + F.lit(0.0) for c in other]))
    if not parts:
        return report_frame(df.sparkSession, [], "column string, value double, n bigint")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def quantiles_of_counts(
    counts: DataFrame,
    by: Sequence[str],
    probabilities: Sequence[float],
    at_most: int,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of weighted values per group.

    Returns the group columns, ``n`` (weight), ``distinct`` and ``q`` (an array in
    the order of the probabilities). When a group can fit one task the built-in
    weighted ``percentile`` does it; beyond that the ranks come from running counts,
    so that no task ever holds a whole group.
    """
    size = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")]
    if at_most <= chunk_rows(counts, rows_per_chunk):
        points = F.array(*[F.lit(float(p)) for p in probabilities])
        return counts.groupBy(*by).agg(*size, F.percentile("value", points, F.col("n")).alias("q"))
    counts = materialize(counts)  # read for the totals and for the ranks
    ranked = running(counts, order=["value"], by=by, sums={"upto": "n"}, rows_per_chunk=rows_per_chunk)
    totals = counts.groupBy(*by).agg(*size)
    names = [f"__t{i}" for i in range(len(by))]
    match = F.lit(True)
    for b, t in zip(by, names):
        match = match & F.col(b).eqNullSafe(F.col(t))
    placed = ranked.withColumnRenamed("n", "weight").join(
        totals.select(*[F.col(b).alias(t) for b, t in zip(by, names)], "n", "distinct"), match
    )
    picks, keep = [], F.lit(False)
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("upto") - F.col("weight") <= rank) & (rank < F.col("upto"))
            keep = keep | hit
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"{side}{i}"))
    found = placed.where(keep).groupBy(*by).agg(F.max("n").alias("n"), F.max("distinct").alias("distinct"), *picks)
    q = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        part = (F.floor(at) + 1 - at) * lo + (at - F.floor(at)) * hi
        q.append(F.when(lo == hi, lo).otherwise(part))
    return found.select(*by, "n", "distinct", F.array(*q).alias("q"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of a few columns, as plain numbers (one short list per column)."""
    numbers = {c: as_number(col(c), df.schema[c].dataType) + F.lit(0.0) for c in columns if is_numeric(df.schema[c].dataType)}
    return selected_quantiles(df, numbers, probabilities) if numbers else {}
