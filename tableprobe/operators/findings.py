"""Plain-language findings and the tables of a report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import is_numeric, numeric_columns
from tableprobe.functions.frames import report_frame
from tableprobe.operators.profile import duplicate_summary, missing_summary, numeric_statistics, outliers_iqr, top_values
from tableprobe.operators.relate import correlation_matrix, feature_importance, strongest, target_correlations
from tableprobe.operators.state import table_state
from tableprobe.operators.typing import split_columns

# When something is worth telling.
MISSING_PCT = 20.0
STRONG_R = 0.7
SKEW = 1.0
DOMINANT_PCT = 60.0
OUTLIER_PCT = 5.0

SCHEMA = "rule string, subject string, value double, text string"


def _row(rule: str, subject: Column, value: Column, told: Column, limit: str | None = None) -> list[Column]:
    """A finding as typed fields; its text only strings them together: rule, subject, what was measured, limit."""
    parts = [F.concat(F.lit(rule), F.lit(":")), subject, told, F.lit(f"(limit {limit})" if limit else None)]
    return [
        F.lit(rule).alias("rule"),
        subject.cast("string").alias("subject"),
        value.cast("double").alias("value"),
        F.concat_ws(" ", *parts).alias("text"),
    ]


def _nothing(rule: str, value: float | None, limit: str | None = None) -> list[Column]:
    return _row(rule, F.lit(None).cast("string"), F.lit(value), F.lit("nothing"), limit)


def _missing_lines(gaps: DataFrame) -> DataFrame:
    pct = F.col("missing_pct")
    high = gaps.where(pct >= MISSING_PCT).select(
        *_row("missing", F.col("column"), pct, F.format_string("%.1f %%", pct), f"{MISSING_PCT:.0f} %")
    )
    none = gaps.agg(F.sum("missing").alias("m")).where("m = 0").select(*_nothing("missing", 0.0))
    return high.unionByName(none)


def findings_missing(df: DataFrame) -> DataFrame:
    """Columns missing a fifth or more; or one line when nothing is missing at all."""
    return _missing_lines(missing_summary(df))


def _duplicate_lines(repeated: DataFrame) -> DataFrame:
    n, pct = F.col("duplicates"), F.col("duplicate_pct")
    told = F.when(n > 0, F.format_string("%d rows, %.1f %%", n, pct)).otherwise("nothing")
    return repeated.select(*_row("duplicates", F.lit(None).cast("string"), n, told))


def findings_duplicates(df: DataFrame) -> DataFrame:
    """Always one line."""
    return _duplicate_lines(duplicate_summary(df))


def _correlation_lines(pairs: DataFrame) -> DataFrame:
    r, limit = F.col("r"), f"{STRONG_R:.2f}"
    strong = pairs.where(F.abs(r) >= STRONG_R).select(
        *_row("correlation", F.concat_ws(" ~ ", "a", "b"), r, F.format_string("%+.2f", r), limit)
    )
    none = pairs.agg(F.coalesce(F.max(F.abs(r)), F.lit(0.0)).alias("best")).where(F.col("best") < STRONG_R).select(
        *_nothing("correlation", None, limit)
    )
    return strong.unionByName(none)


def findings_correlation(df: DataFrame) -> DataFrame:
    """Pairs with |r| of 0.7 or more; or one line when there are pairs but none is strong."""
    if len(numeric_columns(df)) < 2:
        return report_frame(df.sparkSession, [], SCHEMA)
    return _correlation_lines(correlation_matrix(df))


def _skew_lines(stats: DataFrame) -> DataFrame:
    skew = F.col("skew")
    return stats.where((F.col("count") >= 3) & (F.abs(skew) >= SKEW)).select(
        *_row("skew", F.col("column"), skew, F.format_string("%+.2f", skew), f"{SKEW:.2f}")
    )


def findings_skew(df: DataFrame) -> DataFrame:
    return _skew_lines(numeric_statistics(df))


def _dominant_lines(top: DataFrame) -> DataFrame:
    pct = F.col("pct")
    return top.where(pct >= DOMINANT_PCT).select(
        *_row("dominant", F.col("column"), pct, F.format_string("'%s' %.1f %%", F.col("value"), pct), f"{DOMINANT_PCT:.0f} %")
    )


def findings_dominant(df: DataFrame) -> DataFrame:
    """Categories where one value has 60 % or more."""
    names = split_columns(df)["categorical"]
    if not names:
        return report_frame(df.sparkSession, [], SCHEMA)
    return _dominant_lines(top_values(df, names, 1))


def _outlier_lines(outliers: DataFrame) -> DataFrame:
    n, pct = F.col("outliers"), F.col("outlier_pct")
    return outliers.where((n > 0) & (pct >= OUTLIER_PCT)).select(
        *_row("outliers", F.col("column"), pct, F.format_string("%d values, %.1f %%", n, pct), f"{OUTLIER_PCT:.0f} %")
    )


def findings_outliers(df: DataFrame) -> DataFrame:
    """Columns where the quartile fences leave out 5 % or more."""
    return _outlier_lines(outliers_iqr(df))


def findings(df: DataFrame) -> DataFrame:
    """(position, rule, subject, value, text): all rules in order, strongest first within a rule.

    All of them come from one profile of the table, see ``operators/state.py``.
    """
    known = table_state(df, all_values=False, top_share=DOMINANT_PCT)
    several = sum(1 for c in known.columns if c["numeric"]) > 1
    parts = [
        _missing_lines(known.missing()),
        _duplicate_lines(known.repeated()),
        _correlation_lines(known.correlations()) if several else report_frame(df.sparkSession, [], SCHEMA),
        _skew_lines(known.statistics()),
        _dominant_lines(known.dominant()),
        _outlier_lines(known.outliers()),
    ]
    out = parts[0].withColumn("position", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("position", F.lit(i)))
    return out.select("position", "rule", "subject", "value", "text").orderBy("position", F.abs("value").desc_nulls_last(), "subject")


def target_findings(df: DataFrame, target: str) -> DataFrame:
    """(rule, subject, value, text): one row per numeric feature, strongest first.

    The rule says what was measured, ``correlation`` with a number or ``group_means``
    over the groups of anything else, and whether it tells something: features below
    the weakest strength have ``_none`` added.
    """
    if target not in df.columns:
        raise ValueError(f"There is no column {target}.")
    numeric = is_numeric(df.schema[target].dataType)
    rule = "correlation" if numeric else "group_means"
    measured = target_correlations(df, target) if numeric else feature_importance(df, target)
    value = F.coalesce("r" if numeric else "score", F.lit(0.0))
    level = F.lower(F.coalesce("strength", F.lit("Negligible")))
    text = F.format_string("%s and %s: %s (%+.2f)", F.col("feature"), F.lit(target), level, value)
    name = F.when(level == "negligible", F.lit(f"{rule}_none")).otherwise(F.lit(rule))
    return measured.select(name.alias("rule"), F.col("feature").alias("subject"), value.alias("value"), text.alias("text"))


def merge_findings(schemas: DataFrame, merge_report: dict[str, Any], survival: DataFrame | None = None) -> list[str]:
    """Sentences about missing columns, clashing types and the merge that was chosen.

    With ``survival`` (from ``merge.type_survival``) each clashing column also says
    how many of its filled cells keep their value in the common type.
    """
    lines = []
    clashes: list[str] = []
    for r in schemas.collect():  # one row per input table
        clashes = r["clashing"]
        if r["missing"]:
            more = f" (+{len(r['missing']) - 5} more)" if len(r["missing"]) > 5 else ""
            lines.append(f"{r['table']} lacks {len(r['missing'])} columns others have: {', '.join(r['missing'][:5])}{more}.")
    if clashes:
        lines.append(f"{len(clashes)} shared columns have different types across tables.")
    if survival is not None:
        kept = survival.groupBy("column", "common_type").agg(F.sum("filled").alias("filled"), F.sum("survive").alias("survive"), F.countDistinct("type").alias("types"))
        for r in kept.where("types > 1").orderBy("column").collect():  # one row per clashing column
            lines.append(f"{r['column']} becomes {r['common_type']}: {r['survive']} of {r['filled']} filled cells keep their value.")
    if merge_report.get("merge") == "time_align":
        used = ", ".join(f"{n}: {c}" for n, c in merge_report["time_columns"].items())
        lines.append(f"Tables were aligned on time ({used}).")
    return lines + merge_report.get("warnings", [])


def sanitize_findings(report: dict[str, Any]) -> list[str]:
    """Sentences about what cleaning changed."""
    lines = []
    if report.get("tokens_replaced_total"):
        lines.append(f"Cleaned {report['tokens_replaced_total']:,} placeholder values.")
    for key, what in (("numeric_conversions", "numbers"), ("datetime_conversions", "dates"), ("boolean_conversions", "booleans")):
        if report.get(key):
            lines.append(f"Converted {len(report[key])} text columns to {what}.")
    if report.get("infinities_replaced"):
        lines.append(f"Removed {report['infinities_replaced']:,} infinite values.")
    if report.get("nested_columns"):
        lines.append(f"Turned {len(report['nested_columns'])} nested columns into text.")
    return lines


def report_tables(df: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """The content of a report, one table per section, all from one profile."""
    known = table_state(df)
    pairs = known.correlations()
    return {
        "overview": known.overview(),
        "quality": known.quality(),
        "types": known.types(),
        "time_coverage": known.coverage(),
        "column_health": known.health(),
        "numeric": known.statistics(),
        "correlation": pairs.drop("position"),
        "top_correlations": strongest(pairs, top),
    }


def write_report(df: DataFrame, path: str, top: int = 5) -> dict[str, str]:
    """Save each section as its own Parquet folder below ``path``."""
    paths = {}
    for name, table in report_tables(df, top).items():
        paths[name] = f"{path.rstrip('/')}/{name}"
        table.write.mode("errorifexists").parquet(paths[name])
    return paths
