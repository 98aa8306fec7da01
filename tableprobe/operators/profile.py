"""Profiling aggregates: size, gaps, repeats, outliers and column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.columns import (
    as_number,
    col,
    is_floating,
    is_numeric,
    is_text,
    is_time,
    numeric_columns,
    percent,
    present,
    time_columns,
)
from tableprobe.functions.frames import per_column, report_frame
from tableprobe.functions.stats import sample_kurtosis, sample_skewness
from tableprobe.operators.filters import time_between
from tableprobe.operators.typing import split_columns, stringify_nested
from tableprobe.plans.frequency import (
    column_quantiles,
    distinct_counts,
    number_counts,
    value_counts,
)


def _filled(df: DataFrame, name: str) -> Column:
    """The column with NaN counted as missing."""
    dtype = df.schema[name].dataType
    return as_number(col(name), dtype) if is_floating(dtype) else col(name)


def _number(df: DataFrame, name: str) -> Column:
    return as_number(col(name), df.schema[name].dataType)


# ----------------------------------------------------------------- whole table


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns and missing cells."""
    gaps = F.size(F.filter(F.array(*[_filled(df, c).isNull() for c in df.columns]), lambda gap: gap))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_cells"),
    )


def _completeness(df: DataFrame) -> DataFrame:
    """(position, column, rows, filled)."""
    present_cells = {c: _filled(df, c).isNotNull() for c in df.columns}
    return per_column(df, present_cells, {"rows": F.count(F.lit(1)), "filled": F.count_if("value")})


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct), worst first."""
    gap = F.col("rows") - F.col("filled")
    return (
        _completeness(df)
        .select("position", "column", gap.alias("missing"), percent(gap, F.col("rows")).alias("missing_pct"))
        .orderBy(F.desc("missing_pct"), "position")
        .drop("position")
    )


def row_keys(flat: DataFrame) -> list[Column]:
    """k0, k1, ...: one for each column, equal when the cells of two rows count as equal."""
    keys = []
    for i, c in enumerate(flat.columns):
        dtype, x = flat.schema[c].dataType, _filled(flat, c)
        if is_floating(dtype):
            x = x + F.lit(0.0)
        elif is_time(dtype):
            x = F.unix_micros(x.cast("timestamp"))  # text forms of a time may drop digits
        keys.append(x.alias(f"k{i}"))
    return keys


def row_digest(keys: Sequence[str | Column]) -> Column:
    """32 bytes that stand for the content of a row."""
    return F.unhex(F.sha2(F.to_json(F.struct(*keys)), 256))


def _identical_rows(df: DataFrame) -> DataFrame:
    """(n, gaps): size of each group of identical rows and missing cells per row.

    Map-side counting folds copies before the shuffle, so a row repeated very
    often costs no more than any other. Rows with text or many columns are grouped
    by the SHA-256 digest of their content: 32 bytes per different row travel, not
    the row.
    """
    flat, _ = stringify_nested(df)
    keys = row_keys(flat)
    names = [f"k{i}" for i in range(len(keys))]
    rows = flat.select(*keys)
    gaps = F.lit(0)
    for k in names:
        gaps = gaps + F.col(k).isNull().cast("int")
    wide = len(names) > 8 or any(is_text(f.dataType) for f in flat.schema.fields)
    if wide:
        digest = row_digest(names)
        return rows.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.max(gaps).alias("gaps"))
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select("n", gaps.alias("gaps"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each identical row, and their share."""
    rows, extra = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return _identical_rows(df).agg(rows.alias("rows"), extra.alias("duplicates"), percent(extra, rows).alias("duplicate_pct"))


# -------------------------------------------------------------------- outliers


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float | None, float | None]]:
    """Lower and upper fence per column; None where there are no values."""
    out = {}
    for c, (q1, q3) in column_quantiles(df, columns, [0.25, 0.75]).items():
        out[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def zscore_bounds(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> dict[str, tuple[float | None, float | None]]:
    """mean ± threshold · population deviation; None where there is no spread."""
    if not columns:
        return {}
    x = F.col("value")
    got = per_column(df, {c: _number(df, c) for c in columns}, {"mean": F.avg(x), "deviation": F.stddev_pop(x)})
    out = {}
    for r in got.collect():  # one row per column
        mean, deviation = r["mean"], r["deviation"]
        out[r["column"]] = (mean - threshold * deviation, mean + threshold * deviation) if deviation else (None, None)
    return {c: out[c] for c in columns}


def _outside(x: Column, bounds: tuple[float | None, float | None]) -> Column:
    lo, hi = bounds
    if lo is None:
        return F.lit(False)
    return F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))


def _outlier_table(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    schema = "position int, column string, outliers bigint, outlier_pct double, lower double, upper double"
    if not bounds:
        return report_frame(df.sparkSession, [], schema).drop("position")
    def fence(side: int) -> Column:
        """The fence of the column a stacked value came from."""
        entries = [(F.lit(f"c{i}"), F.lit(b[side]).cast("double")) for i, b in enumerate(bounds.values())]
        return F.create_map(*[x for pair in entries for x in pair])[F.col("id")]

    x, lo, hi = F.col("value"), fence(0), fence(1)
    return per_column(
        df,
        {c: _number(df, c) for c in bounds},
        {"filled": F.count(x), "outliers": F.count_if((x < lo) | (x > hi)), "lower": F.max(lo), "upper": F.max(hi)},
    ).select("column", "outliers", percent(F.col("outliers"), F.col("filled")).alias("outlier_pct"), "lower", "upper")


def outliers_iqr(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Per numeric column: values outside the quartile fences."""
    return _outlier_table(df, iqr_bounds(df, present(df, columns or numeric_columns(df)), k))


def outliers_zscore(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Per numeric column: values too many deviations from the mean."""
    return _outlier_table(df, zscore_bounds(df, present(df, columns or numeric_columns(df)), threshold))


def flag_outliers(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    k: float = 1.5,
    threshold: float = 3.0,
    time_column: str | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Rows holding a value, each flagged against bounds of the chosen time window."""
    if time_column and (start is not None or end is not None):
        df = df.where(time_between(df, time_column, start, end))
    bounds = (zscore_bounds(df, [column], threshold) if method == "zscore" else iqr_bounds(df, [column], k))[column]
    x = _number(df, column)
    return df.where(x.isNotNull()).select(
        "*",
        F.lit(bounds[0]).cast("double").alias("lower"),
        F.lit(bounds[1]).cast("double").alias("upper"),
        _outside(x, bounds).alias("is_outlier"),
    )


def outlier_counts(flagged: DataFrame, group: str | None = None) -> DataFrame:
    """Flagged rows and their share, overall or per group label."""
    keys = [col(group)] if group else []
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_outlier").alias("outliers"),
        percent(F.count_if("is_outlier"), F.count(F.lit(1))).alias("outlier_pct"),
    )


# --------------------------------------------------------------------- columns


def numeric_statistics(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, gaps, distinct values, moments and quartiles of every numeric column.

    ``approx`` takes distinct values and quartiles from bounded sketches (within
    2 % and 0.01 % of the rows), which leaves one scan without a shuffle of values.
    """
    names = [c for c in present(df, columns or numeric_columns(df)) if is_numeric(df.schema[c].dataType)]
    if not names:
        return report_frame(
            df.sparkSession,
            [],
            "column string, count bigint, missing bigint, missing_pct double, unique bigint, mean double, std double,"
            " min double, q25 double, median double, q75 double, max double, skew double, kurtosis double",
        )
    x = F.col("value")
    values = {c: _number(df, c) for c in names}
    moments = per_column(
        df,
        values,
        {
            "rows": F.count(F.lit(1)),
            "count": F.count(x),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "max": F.max(x),
            "skew": sample_skewness(x),
            "kurtosis": sample_kurtosis(x),
        },
    )
    quartiles = [0.25, 0.5, 0.75]
    if approx:
        q = F.percentile_approx(x, F.array(*[F.lit(p) for p in quartiles]), F.lit(10_000))
        distinct = F.hll_sketch_estimate(F.hll_sketch_agg(x.cast("string"), F.lit(12)))
        ranks = per_column(df, values, {"distinct": distinct, "q": q}).drop("position")
    else:
        q = column_quantiles(df, names, quartiles)
        distinct = number_counts(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        known = report_frame(df.sparkSession, [(c, *q[c]) for c in names], "column string, q0 double, q1 double, q2 double")
        # Both sides have one row per column.
        ranks = known.join(F.broadcast(distinct), "column", "left").select("column", "distinct", F.array("q0", "q1", "q2").alias("q"))
    # Both sides have one row per column.
    return statistics_of(moments.join(F.broadcast(ranks), "column", "left"))


def statistics_of(columns: DataFrame) -> DataFrame:
    """The table of ``numeric_statistics`` from moments, ``distinct`` and three quartiles ``q``."""
    gap = F.col("rows") - F.col("count")
    return columns.select(
        "column",
        "count",
        gap.alias("missing"),
        percent(gap, F.col("rows")).alias("missing_pct"),
        F.coalesce("distinct", F.lit(0)).alias("unique"),
        "mean",
        "std",
        "min",
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q75"),
        "max",
        "skew",
        "kurtosis",
    )


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """(column, distinct, rank, value, n, pct): the most frequent values, ties by value."""
    counts = value_counts(df, columns)
    best = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("filled"))
    # One row per column on the right side.
    return top.join(F.broadcast(totals), "column").select(
        "column", "distinct", F.col("rank").cast("bigint").alias("rank"), "value", "n", percent(F.col("n"), F.col("filled")).alias("pct")
    )


def categorical_statistics(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """Top values of every categorical column; rank 1 is the mode."""
    names = present(df, columns) if columns is not None else split_columns(df)["categorical"]
    if not names:
        return report_frame(df.sparkSession, [], "column string, distinct bigint, rank bigint, value string, n bigint, pct double")
    return top_values(df, names, n)


def column_detail(df: DataFrame, name: str) -> DataFrame:
    """(metric, number, text) for one column; booleans are described like text."""
    dtype = df.schema[name].dataType
    if is_numeric(dtype):
        x = _number(df, name)
        extra = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives")).first()
        one = numeric_statistics(df, [name]).select("*", *[F.lit(v).alias(k) for k, v in extra.asDict().items()])
        metrics = {
            "total": F.col("rows"),
            "missing": F.col("missing"),
            "missing_pct": F.col("missing_pct"),
            "unique": F.col("unique"),
            "mean": F.col("mean"),
            "median": F.col("median"),
            "std": F.col("std"),
            "min": F.col("min"),
            "q25": F.col("q25"),
            "q75": F.col("q75"),
            "max": F.col("max"),
            "range": F.col("max") - F.col("min"),
            "iqr": F.col("q75") - F.col("q25"),
            "skew": F.col("skew"),
            "kurtosis": F.col("kurtosis"),
            "zeros": F.col("zeros"),
            "negatives": F.col("negatives"),
        }
        return _metrics(one, {k: (v.cast("double"), F.lit(None).cast("string")) for k, v in metrics.items()})
    flat, _ = stringify_nested(df.select(col(name)))
    totals = flat.agg(F.count(F.lit(1)).alias("rows"), F.count(col(name)).alias("filled")).first()
    counts = value_counts(flat, [name])
    unique = counts.count()
    best = counts.orderBy(F.desc("n"), "value").limit(5)
    top = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "value")))
    one = best.agg(top.alias("top")).select(
        "top", F.lit(totals["rows"]).alias("rows"), F.lit(totals["filled"]).alias("filled"), F.lit(unique).alias("unique")
    )
    gap = F.col("rows") - F.col("filled")
    none, empty = F.lit(None).cast("double"), F.lit(None).cast("string")
    first = F.get(F.col("top"), F.lit(0))
    return _metrics(
        one,
        {
            "total": (F.col("rows").cast("double"), empty),
            "missing": (gap.cast("double"), empty),
            "missing_pct": (percent(gap, F.col("rows")), empty),
            "unique": (F.col("unique").cast("double"), empty),
            "mode": (none, first["value"]),
            "top_frequency": ((-first["k"]).cast("double"), empty),
            "top_pct": (percent(-first["k"], F.col("filled")), empty),
            "examples": (none, F.array_join(F.col("top.value"), ", ")),
        },
    )


def _metrics(one: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("metric"), n.alias("number"), t.alias("text")) for k, (n, t) in fields.items()]
    return one.select(F.inline(F.array(*rows)))


def column_health(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, type, missing_pct, unique, status), worst first.

    ``approx`` takes distinct values from sketches; then only exact counts of one
    value stay certain, and "Unique key" is not claimed.
    """
    flat, _ = stringify_nested(df)
    filled = _completeness(flat)
    unique = distinct_counts(flat, flat.columns, approx)
    types = F.create_map(*[x for n, t in df.dtypes for x in (F.lit(n), F.lit(t))])
    return health_of(filled.join(F.broadcast(unique), "column", "left").withColumn("type", types[F.col("column")]), approx)


def health_of(columns: DataFrame, approx: bool = False) -> DataFrame:
    """Status of each column, from (position, column, type, rows, filled, unique)."""
    distinct = F.coalesce("unique", F.lit(0))
    share = percent(F.col("rows") - F.col("filled"), F.col("rows"))
    status = (
        F.when(share >= 50, "High missing")
        .when(share >= 10, "Some missing")
        .when((distinct == 1) & (F.col("rows") > 1), "Constant")
        .when(F.lit(not approx) & (distinct == F.col("rows")) & (F.col("rows") > 0), "Unique key")
        .otherwise("OK")
    )
    return (
        columns.select("position", "column", "type", share.alias("missing_pct"), distinct.alias("unique"), status.alias("status"))
        .orderBy(F.desc("missing_pct"), "position")
        .drop("position")
    )


def time_coverage(df: DataFrame) -> DataFrame:
    """The timestamp column with the widest span: start, end, duration and filled rows."""
    names = time_columns(df)
    schema = "column string, start timestamp, end timestamp, duration_seconds double, non_null bigint"
    if not names:
        return report_frame(df.sparkSession, [], schema)
    t = F.col("value")
    spans = per_column(
        df, {c: col(c).cast("timestamp") for c in names}, {"start": F.min(t), "end": F.max(t), "non_null": F.count(t)}
    )
    return widest_span(spans)


def widest_span(spans: DataFrame) -> DataFrame:
    """The time column to show, from (position, column, start, end, non_null)."""
    span = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(1e6)
    return (
        spans.withColumn("duration_seconds", span)
        .where("duration_seconds > 0")
        .orderBy(F.desc("duration_seconds"), "position")
        .limit(1)
        .select("column", "start", "end", "duration_seconds", "non_null")
    )


def quality_status(df: DataFrame) -> DataFrame:
    """One row: missing and duplicate shares with a bad / warn / ok grade."""
    one = _identical_rows(df).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(F.col("n") * F.col("gaps")), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )
    return graded_quality(one)


def graded_quality(one: DataFrame) -> DataFrame:
    """Shares and grades, from (rows, columns, missing_cells, duplicates)."""
    missing = percent(F.col("missing_cells"), F.col("rows") * F.col("columns"))
    repeated = percent(F.col("duplicates"), F.col("rows"))

    def grade(share: Column, bad: float, warn: float) -> Column:
        return F.when(share >= bad, "bad").when(share >= warn, "warn").otherwise("ok")

    return one.select(
        "rows",
        "columns",
        "missing_cells",
        missing.alias("missing_pct"),
        grade(missing, 30, 10).alias("missing_status"),
        "duplicates",
        repeated.alias("duplicate_pct"),
        grade(repeated, 20, 5).alias("duplicate_status"),
    )


def type_counts(df: DataFrame) -> DataFrame:
    """(kind, columns) for numeric, categorical and datetime columns."""
    groups = split_columns(df)
    return report_frame(df.sparkSession, [(k, len(v)) for k, v in groups.items()], "kind string, columns bigint")
