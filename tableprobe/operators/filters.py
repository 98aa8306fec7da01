"""Filters as native, pushable predicates, with the bookkeeping around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import as_number, col, columns_of, is_integral, is_numeric, is_text, numeric_columns, percent, text_columns
from tableprobe.functions.dates import to_timestamp
from tableprobe.functions.frames import per_column, report_frame
from tableprobe.plans.frequency import value_counts

MAX_OPTIONS = 200


class Filter:
    """A predicate together with what it did: rules applied, rules refused."""

    def __init__(self, predicate: Column | None, rules: list[str], messages: list[str]):
        self.predicate, self.rules, self.messages = predicate, rules, messages

    @property
    def active(self) -> bool:
        return self.predicate is not None

    def __and__(self, other: Filter) -> Filter:
        both = [p for p in (self.predicate, other.predicate) if p is not None]
        joined = both[0] & both[1] if len(both) == 2 else (both[0] if both else None)
        return Filter(joined, self.rules + other.rules, self.messages + other.messages)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate) if self.active else df


def _bound(value, name: str, side: str, messages: list[str]) -> float | None:
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    if not isinstance(value, str):
        return value
    try:
        return float(value)
    except ValueError:
        messages.append(f"{name}: {side} is not a number and was ignored.")
        return None


def range_filter(column: str, low=None, high=None) -> Filter:
    """Inclusive range; an open side is left out, a crossed range is skipped."""
    messages: list[str] = []
    lo, hi = _bound(low, column, "minimum", messages), _bound(high, column, "maximum", messages)
    if lo is None and hi is None:
        return Filter(None, [], messages)
    if lo is not None and hi is not None and lo > hi:
        return Filter(None, [], messages + [f"{column}: minimum {lo:g} is above maximum {hi:g}; rule skipped."])
    # NaN sorts above infinity, so an open side ends before infinity: both count as missing.
    low_side = col(column) > F.lit(float("-inf")) if lo is None else col(column) >= F.lit(lo)
    high_side = col(column) < F.lit(float("inf")) if hi is None else col(column) <= F.lit(hi)
    predicate = low_side & high_side
    return Filter(predicate, [f"{column} in [{'' if lo is None else f'{lo:g}'}, {'' if hi is None else f'{hi:g}'}]"], messages)


def in_filter(df: DataFrame, column: str, values: Sequence) -> Filter:
    """Membership by text; no values keeps everything. Native types where possible."""
    chosen = [str(v) for v in values]
    if not chosen:
        return Filter(None, [], [])
    dtype = df.schema[column].dataType
    predicate = col(column).cast("string").isin(*chosen)
    if is_text(dtype):
        predicate = col(column).isin(*chosen)
    elif is_integral(dtype):
        whole = [int(v) for v in chosen if v.lstrip("-").isdigit() and str(int(v)) == v]
        predicate = col(column).isin(*whole) if whole else F.lit(False)
    elif isinstance(dtype, T.BooleanType):
        flags = [v.lower() == "true" for v in chosen if v.lower() in ("true", "false")]
        predicate = col(column).isin(*flags) if flags else F.lit(False)
    return Filter(predicate, [f"{column} in {len(chosen)} values"], [])


def filter_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    return range_filter(column, low, high).apply(df)


def filter_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return in_filter(df, column, values).apply(df)


def filter_summary(df: DataFrame, rule: Filter) -> DataFrame:
    """One row: original, kept and dropped rows, percent kept, and the rules."""
    kept = F.count_if(rule.predicate) if rule.active else F.count(F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("original_rows"), kept.alias("kept_rows")).select(
        "original_rows",
        "kept_rows",
        (F.col("original_rows") - F.col("kept_rows")).alias("dropped_rows"),
        percent(F.col("kept_rows"), F.col("original_rows")).alias("percent_kept"),
        F.array(*[F.lit(r) for r in rule.rules]).cast("array<string>").alias("rules"),
    )


def excluded_rows(df: DataFrame, rule: Filter) -> DataFrame:
    """Everything the filter removed, rows with an undecided predicate included."""
    return df.where(~F.coalesce(rule.predicate, F.lit(False))) if rule.active else df.where(F.lit(False))


def filter_options(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choices for category filters (column, value) and ranges for numeric ones."""
    names = text_columns(df) + columns_of(df, lambda t: isinstance(t, T.BooleanType))
    numbers = numeric_columns(df)
    spark = df.sparkSession
    options = report_frame(spark, [], "column string, value string")
    if names:
        # A bounded sketch finds the eligible columns; only those are counted exactly.
        sketch = {"d": F.hll_sketch_estimate(F.hll_sketch_agg("value", F.lit(12)))}
        rough = per_column(df, {c: col(c).cast("string") for c in names}, sketch).collect()  # one row per column
        likely = [r["column"] for r in rough if (r["d"] or 0) <= 1.5 * MAX_OPTIONS]
        if likely:
            counts = value_counts(df, likely)
            small = counts.groupBy("column").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= MAX_OPTIONS)
            options = counts.join(F.broadcast(small), "column", "left_semi").select("column", "value").orderBy("column", "value")
    ranges = report_frame(spark, [], "column string, low double, high double")
    if numbers:
        values = {c: as_number(col(c), df.schema[c].dataType) for c in numbers}
        ranges = per_column(df, values, {"low": F.min("value"), "high": F.max("value")}).drop("position")
    return options, ranges


def time_between(df: DataFrame, column: str, start=None, end=None) -> Column:
    """Inclusive time window; text is parsed, and what does not parse is left out."""
    dtype = df.schema[column].dataType
    t = to_timestamp(col(column)) if is_text(dtype) else col(column)
    kind = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
    if is_numeric(dtype):
        raise ValueError(f"{column} is numeric; convert it to a timestamp first.")
    predicate = F.lit(True)
    if start is not None:
        predicate = predicate & (t >= F.lit(start).cast(kind))
    if end is not None:
        predicate = predicate & (t <= F.lit(end).cast(kind))
    return predicate


def filter_time_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Keep rows inside the window; a window that ends before it starts is skipped."""
    if start is None and end is None:
        return df
    inside = time_between(df, column, start, end)
    if start is not None and end is not None:
        # both are times, not text; the optimizer folds the comparison away
        inside = inside | (F.lit(start).cast("timestamp") > F.lit(end).cast("timestamp"))
    return df.where(inside)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows in an order the caller names."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)
