"""Reading dates from text and numbers, with counts of what did not parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import as_number, col, is_numeric, is_text, is_time, numeric_columns, percent
from tableprobe.functions.dates import (
    FORMAT_PRESETS,
    NUMERIC_TIME_RANGES,
    builder_to_pattern,
    number_to_timestamp,
    parse_format,
    to_timestamp,
)
from tableprobe.functions.frames import one_row_per_column, per_column, report_frame
from tableprobe.functions.text import DATE_NULL_TOKENS, clean_text

PRESET_SHARE = 0.5
NUMERIC_SHARE = 80.0

__all__ = [
    "builder_to_pattern",
    "combine_date_time",
    "convert_numeric_datetime",
    "detect_numeric_datetime",
    "failed_values",
    "parse_datetime",
    "parse_stats",
    "suggest_formats",
]


def parse_stats(df: DataFrame, given: Column, parsed: Column) -> DataFrame:
    """One row: total, non_null, parsed, failed, percent."""
    n, ok = F.count(given), F.count(F.when(given.isNotNull(), parsed))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        n.alias("non_null"),
        ok.alias("parsed"),
        (n - ok).alias("failed"),
        percent(ok, n).alias("percent"),
    )


def _given(df: DataFrame, column: str) -> Column:
    return clean_text(col(column), DATE_NULL_TOKENS) if is_text(df.schema[column].dataType) else col(column)


def parsed_column(df: DataFrame, column: str, fmt: str | None = None, dayfirst: bool = False) -> Column:
    """The column as a timestamp expression."""
    dtype = df.schema[column].dataType
    if is_time(dtype):
        return col(column).cast("timestamp")
    return to_timestamp(col(column).cast("string"), fmt, dayfirst)


def parse_datetime(
    df: DataFrame, column: str, fmt: str | None = None, output: str | None = None, dayfirst: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(table with the parsed column, one row of statistics); both lazy."""
    parsed = parsed_column(df, column, fmt, dayfirst)
    return df.withColumn(output or column, parsed), parse_stats(df, _given(df, column), parsed)


def suggest_formats(df: DataFrame, column: str, top_n: int = 5) -> DataFrame:
    """(format, parsed, non_null, percent): presets that read at least half, best first.

    All presets are scored over all rows in one aggregate.
    """
    text = col("text")
    cleaned = df.select(clean_text(col(column), DATE_NULL_TOKENS).alias("text"))
    scores = one_row_per_column(
        cleaned, {f: {"parsed": F.count(parse_format(text, f)), "non_null": F.count(text)} for f in FORMAT_PRESETS}
    )
    return (
        scores.where((F.col("non_null") > 0) & (F.col("parsed") >= F.lit(PRESET_SHARE) * F.col("non_null")))
        .select("position", F.col("column").alias("format"), "parsed", "non_null", percent(F.col("parsed"), F.col("non_null")).alias("percent"))
        .orderBy(F.desc("percent"), "position")
        .limit(top_n)
        .drop("position")
    )


def _time_micros(text: Column) -> Column:
    """Clock text such as 7:05:09.25 to microseconds; null when it is something else."""
    shape = r"^(\d+):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6}))?$"

    def part(i: int) -> Column:
        return F.regexp_extract(text, shape, i)

    whole = part(1).try_cast("bigint") * 3600 + part(2).try_cast("bigint") * 60 + part(3).try_cast("bigint")
    fraction = F.rpad(part(4), 6, "0").try_cast("bigint")
    ok = text.rlike(shape) & (part(2).try_cast("int") < 60) & (part(3).try_cast("int") < 60)
    return F.when(ok, whole * 1_000_000 + F.coalesce(fraction, F.lit(0)))


def combined_column(
    df: DataFrame, date_column: str, time_column: str, date_format: str | None = None, time_format: str | None = None
) -> Column:
    clock = clean_text(col(time_column).cast("string"), DATE_NULL_TOKENS)
    if is_time(df.schema[date_column].dataType):
        day = F.date_trunc("day", col(date_column).cast("timestamp"))
        shift = F.when(clock.isNull(), F.lit(0).cast("bigint")).otherwise(_time_micros(clock))
        return F.timestamp_micros(F.unix_micros(day) + shift)
    date = clean_text(col(date_column).cast("string"), DATE_NULL_TOKENS)
    joined = F.concat(date, F.lit(" "), F.coalesce(clock, F.lit("00:00:00")))
    fmt = f"{date_format} {time_format}" if date_format and time_format else None
    return to_timestamp(joined, fmt)


def combine_date_time(
    df: DataFrame,
    date_column: str,
    time_column: str,
    output: str,
    date_format: str | None = None,
    time_format: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(table with the merged timestamp, statistics). No time means midnight, no date null."""
    merged = combined_column(df, date_column, time_column, date_format, time_format)
    return df.withColumn(output, merged), parse_stats(df, _given(df, date_column), merged)


def detect_numeric_datetime(df: DataFrame) -> DataFrame:
    """(position, column, mode, excel_serial, unix_s, unix_ms): shares in each plausible range.

    ``mode`` is the best encoding when it covers 80 % of at least three values;
    ties go to the encoding listed first.
    """
    names = numeric_columns(df)
    if not names:
        return report_frame(
            df.sparkSession, [], "position int, column string, mode string, excel_serial double, unix_s double, unix_ms double"
        )
    x = F.col("value")
    shares = {n: percent(F.count_if(x.between(lo, hi)), F.count(x)) for n, lo, hi in NUMERIC_TIME_RANGES}
    scores = per_column(df, {c: as_number(col(c), df.schema[c].dataType) for c in names}, {"filled": F.count(x), **shares})
    modes = [name for name, _, _ in NUMERIC_TIME_RANGES]
    best = F.greatest(*modes)
    mode = F.when((F.col("filled") < 3) | (best < NUMERIC_SHARE), F.lit(None).cast("string"))
    for m in modes:
        mode = mode.when(F.col(m) == best, F.lit(m))
    return scores.select("position", "column", mode.alias("mode"), *modes)


def convert_numeric_datetime(df: DataFrame, column: str, mode: str, output: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table with the converted column, statistics)."""
    dtype = df.schema[column].dataType
    x = as_number(col(column), dtype) if is_numeric(dtype) else col(column).try_cast("double")
    parsed = number_to_timestamp(x, mode)
    return df.withColumn(output or column, parsed), parse_stats(df, x, parsed)


def failed_values(df: DataFrame, column: str, fmt: str | None = None, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(the most frequent texts that do not parse with counts, one row: distinct failures)."""
    given = _given(df, column)
    bad = df.where(given.isNotNull() & parsed_column(df, column, fmt).isNull())
    counts = bad.groupBy(given.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(n), counts.agg(F.count(F.lit(1)).alias("distinct_failures"))
