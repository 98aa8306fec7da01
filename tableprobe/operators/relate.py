"""Relations between columns and comparison with a target."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import as_number, col, is_floating, is_numeric, no_nan, numeric_columns, percent, present
from tableprobe.functions.frames import one_row_per_column, report_frame
from tableprobe.operators.profile import numeric_statistics
from tableprobe.plans.comoments import pair_correlations


def _number(df: DataFrame, name: str) -> Column:
    return as_number(col(name), df.schema[name].dataType)


def _pair_table(df: DataFrame, names: Sequence[str], target: str | None = None) -> DataFrame:
    """(position, a, b, r) for all pairs, or for each name with the target.

    All pairs come from matrix products over batches of rows, see ``plans/comoments.py``;
    what travels is one row per column and task.
    """
    columns = [*names, *([target] if target else [])]
    p = len(columns)
    r = pair_correlations(df, [_number(df, c) for c in columns], target is not None).select("i", "j", "r")
    spine = [(i, p - 1) for i in range(p - 1)] if target else list(combinations(range(p), 2))
    labels = report_frame(
        df.sparkSession, [(n, i, j, columns[i], columns[j]) for n, (i, j) in enumerate(spine)], "position int, i int, j int, a string, b string"
    )
    # One row per pair of columns on both sides.
    return labels.join(F.broadcast(r), ["i", "j"], "left").select("position", "a", "b", "r")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) for each pair of numeric columns, over rows where both are present."""
    names = present(df, columns or numeric_columns(df))
    if len(names) < 2:
        return report_frame(df.sparkSession, [], "position int, a string, b string, r double")
    return _pair_table(df, names)


def top_correlations(df: DataFrame, n: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """The strongest pairs with strength and direction words."""
    return strongest(correlation_matrix(df, columns), n)


def strongest(pairs: DataFrame, n: int) -> DataFrame:
    """The same, from (position, a, b, r)."""
    size = F.abs("r")
    return (
        pairs.where("r is not null")
        .orderBy(size.desc(), "position")
        .limit(n)
        .select(
            "a",
            "b",
            "r",
            F.when(size >= 0.7, "Strong").when(size >= 0.4, "Moderate").otherwise("Weak").alias("strength"),
            F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("neutral").alias("direction"),
        )
    )


def _correlation_strength(size: Column) -> Column:
    return (
        F.when(size >= 0.7, "Very Strong").when(size >= 0.5, "Strong").when(size >= 0.3, "Moderate").when(size >= 0.1, "Weak")
        .otherwise("Negligible")
    )


def _score_strength(score: Column) -> Column:
    return (
        F.when(score >= 0.5, "Very Strong").when(score >= 0.2, "Strong").when(score >= 0.1, "Moderate").when(score >= 0.05, "Weak")
        .otherwise("Negligible")
    )


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """(feature, r, strength, direction) by absolute r; an undefined r comes last."""
    features = [c for c in numeric_columns(df) if c != target]
    if not features or not is_numeric(df.schema[target].dataType):
        return report_frame(df.sparkSession, [], "feature string, r double, strength string, direction string")
    return (
        _pair_table(df, features, target)
        .orderBy(F.abs("r").desc_nulls_last(), "position")
        .select(
            F.col("a").alias("feature"),
            "r",
            _correlation_strength(F.abs("r")).alias("strength"),
            F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"),
        )
    )


def target_summary(df: DataFrame, target: str) -> dict[str, DataFrame]:
    """``summary`` for any target, plus ``classes`` with counts for a categorical one."""
    if is_numeric(df.schema[target].dataType):
        return {"summary": numeric_statistics(df, [target]).drop("column")}
    counts = df.groupBy(col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("class").isNotNull()
    # Mode by count, then smallest value, as one aggregate instead of a sort.
    best = F.min_by(F.struct("class", "n"), F.when(known, F.struct(-F.col("n"), F.col("class"))))
    filled = F.sum(F.when(known, F.col("n")).otherwise(0))
    summary = counts.agg(F.sum("n").alias("rows"), filled.alias("filled"), F.count("class").alias("unique"), best.alias("best")).select(
        "rows",
        (F.col("rows") - F.col("filled")).alias("missing"),
        percent(F.col("rows") - F.col("filled"), F.col("rows")).alias("missing_pct"),
        "unique",
        F.col("best.class").alias("top_value"),
        F.col("best.n").alias("top_n"),
        percent(F.col("best.n"), F.col("filled")).alias("top_pct"),
    )
    total = F.lit(df.agg(F.count(col(target))).first()[0])
    classes = counts.where(known).select("class", "n", percent(F.col("n"), total).alias("pct"))
    return {"summary": summary, "classes": classes}


def group_means(df: DataFrame, target: str) -> DataFrame:
    """Mean of each numeric column per target value; missing targets (null and NaN) are one group."""
    features = [c for c in numeric_columns(df) if c != target]
    key = no_nan(col(target)) if is_floating(df.schema[target].dataType) else col(target)
    return df.groupBy(key.alias(target)).agg(*[F.avg(_number(df, c)).alias(c) for c in features])


def feature_importance(df: DataFrame, target: str) -> DataFrame:
    """(feature, score, strength): spread of group means relative to the overall mean."""
    features = [c for c in numeric_columns(df) if c != target]
    if not features:
        return report_frame(df.sparkSession, [], "feature string, score double, strength string")
    key = _number(df, target) if is_floating(df.schema[target].dataType) else col(target)
    parts = []
    for i, c in enumerate(features):
        x = _number(df, c)
        parts += [F.sum(x).alias(f"s{i}"), F.count(x).alias(f"n{i}")]
    groups = df.groupBy(key.alias("g")).agg(*parts)
    fields = {}
    for i, c in enumerate(features):
        overall = F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}"))
        mean = F.when(F.col("g").isNotNull(), F.try_divide(F.col(f"s{i}"), F.col(f"n{i}")))
        spread = F.stddev_pop(mean)
        score = F.when(overall.isNull() | (overall == 0), spread).otherwise(F.abs(F.try_divide(spread, overall)))
        fields[c] = {"score": F.coalesce(score, F.lit(0.0))}
    return (
        one_row_per_column(groups, fields)
        .orderBy(F.desc("score"), "position")
        .select(F.col("column").alias("feature"), "score", _score_strength(F.col("score")).alias("strength"))
    )


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares line through the rows where both values are present."""
    a, b = _number(df, x), _number(df, y)
    both = a.isNotNull() & b.isNotNull()
    sxx = F.regr_sxx(b, a)
    slope = F.try_divide(F.regr_sxy(b, a), sxx)
    enough = F.count_if(both) >= 2
    return df.agg(
        F.count_if(both).alias("n"),
        F.when(enough, slope).alias("slope"),
        F.when(enough, F.regr_avgy(b, a) - slope * F.regr_avgx(b, a)).alias("intercept"),
        F.min(F.when(both, a)).alias("x_min"),
        F.max(F.when(both, a)).alias("x_max"),
    )
