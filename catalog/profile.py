"""Profiling queries."""

from __future__ import annotations

from catalog.base import Section, derived, derived_sql, table, ts_text, union_sql
from tableprobe.operators import profile as op

S = Section()
G = derived_sql("gauges")
R = derived_sql("readings", ["l_orderkey", "l_linenumber", "disc", "tax", "qty_inf", "flag_text", "empty_col", "const_col"])
NUM = ["line", "price", "disc", "tax", "qty", "peak", "const_col", "empty_col"]


def clean(c: str) -> str:
    """SQL for a double with NaN and infinities as null."""
    return f"(CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END)"


_gaps = {
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "disc": "disc",
    "tax": "tax",
    "qty_inf": clean("qty_inf"),
    "flag_text": "flag_text",
    "empty_col": "empty_col",
    "const_col": "const_col",
}


@S.add(
    "overview",
    f"WITH t AS ({R}) SELECT count(*) AS rows, CAST(8 AS BIGINT) AS columns, CAST("
    + " + ".join(f"(count(*) - count({e}))" for e in _gaps.values())
    + " AS BIGINT) AS missing_cells FROM t",
)
def overview(spark, sf):
    return op.overview(derived(spark, sf, "readings", list(_gaps)))


@S.add(
    "missing_summary",
    f"WITH t AS ({R}) "
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({e}) AS missing, round(100.0 * (count(*) - count({e})) / count(*), 6) AS missing_pct FROM t"
            for c, e in _gaps.items()
        ]
    ),
)
def missing_summary(spark, sf):
    return op.missing_summary(derived(spark, sf, "readings", list(_gaps)))


def _duplicates_sql(select: str, source: str) -> str:
    return (
        f"WITH g AS (SELECT {select}, count(*) AS n FROM {source} GROUP BY {select}) "
        "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, "
        "round(100.0 * sum(n - 1) / sum(n), 6) AS duplicate_pct FROM g"
    )


@S.add("duplicate_summary", _duplicates_sql("text", "documents"))
def duplicate_summary(spark, sf):
    return op.duplicate_summary(table(spark, sf, "documents").select("text"))


@S.add("duplicate_summary_wide", _duplicates_sql("line, disc, tax, qty, returnflag, status", f"({G})"))
def duplicate_summary_wide(spark, sf):
    return op.duplicate_summary(derived(spark, sf, "gauges", ["line", "disc", "tax", "qty", "returnflag", "status"]))


def _outlier_sql(lower: str, upper: str, stats: str, columns=NUM) -> str:
    return f"WITH t AS ({G}) " + union_sql(
        [
            f"SELECT '{c}' AS \"column\", coalesce(count_if(t.{c} < b.lo OR t.{c} > b.hi), 0)::BIGINT AS outliers, "
            f"round(coalesce(100.0 * count_if(t.{c} < b.lo OR t.{c} > b.hi) / nullif(count(t.{c}), 0), 0.0), 6)::DOUBLE AS outlier_pct, "
            "round(any_value(b.lo), 6) AS lower, round(any_value(b.hi), 6) AS upper "
            f"FROM t, (SELECT {lower} AS lo, {upper} AS hi FROM (SELECT {stats.format(c=c)} FROM t)) b"
            for c in columns
        ]
    )


@S.add(
    "outliers_iqr",
    _outlier_sql(
        "q1 - 1.5 * (q3 - q1)",
        "q3 + 1.5 * (q3 - q1)",
        "quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3",
    ),
)
def outliers_iqr(spark, sf):
    return op.outliers_iqr(derived(spark, sf, "gauges"))


@S.add(
    "outliers_zscore",
    _outlier_sql(
        "CASE WHEN s > 0 THEN m - 3 * s END",
        "CASE WHEN s > 0 THEN m + 3 * s END",
        "avg({c}::DOUBLE) AS m, stddev_pop({c}::DOUBLE) AS s",
    ),
)
def outliers_zscore(spark, sf):
    return op.outliers_zscore(derived(spark, sf, "gauges"))


def _numeric_sql(columns=NUM, source=G) -> str:
    return f"WITH t AS ({source}) " + union_sql(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, "
            f"round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, count(DISTINCT {c}) AS \"unique\", "
            f"round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, round(min({c})::DOUBLE, 6) AS min, "
            f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, "
            f"round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max, "
            f"round(skewness({c}::DOUBLE), 6) AS skew, round(kurtosis({c}::DOUBLE), 6) AS kurtosis FROM t"
            for c in columns
        ]
    )


@S.add("numeric_statistics", _numeric_sql())
def numeric_statistics(spark, sf):
    return op.numeric_statistics(derived(spark, sf, "gauges"))


_CATS = ["returnflag", "status", "open_line"]


def _top_sql(columns, source, n) -> str:
    return f"WITH t AS ({source}) " + union_sql(
        [
            f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM t) AS \"distinct\", rank, value, n, "
            f"round(100.0 * n / (SELECT count({c}) FROM t), 6) AS pct FROM ("
            f"SELECT CAST({c} AS STRING) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS STRING)) AS rank "
            f"FROM t WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {n}"
            for c in columns
        ]
    )


@S.add("categorical_statistics", _top_sql(_CATS, G, 5))
def categorical_statistics(spark, sf):
    return op.categorical_statistics(derived(spark, sf, "gauges"))


@S.add("categorical_statistics_documents", _top_sql(["lang", "source"], "SELECT * FROM documents", 5))
def categorical_statistics_documents(spark, sf):
    return op.categorical_statistics(table(spark, sf, "documents"), ["lang", "source"])


_DETAIL = (
    f"WITH t AS ({G}), s AS (SELECT count(*) AS rows, count(disc) AS n, count(DISTINCT disc) AS u, avg(disc) AS m, quantile_cont(disc, 0.5) AS q2, "
    "stddev_samp(disc) AS sd, min(disc) AS lo, quantile_cont(disc, 0.25) AS q1, quantile_cont(disc, 0.75) AS q3, max(disc) AS hi, "
    "skewness(disc) AS sk, kurtosis(disc) AS ku, count_if(disc = 0) AS z, count_if(disc < 0) AS neg FROM t) "
    "SELECT metric, round(number::DOUBLE, 6) AS number, CAST(NULL AS STRING) AS text FROM ("
    + union_sql(
        [
            f"SELECT '{k}' AS metric, ({e})::DOUBLE AS number FROM s"
            for k, e in {
                "total": "rows",
                "missing": "rows - n",
                "missing_pct": "100.0 * (rows - n) / rows",
                "unique": "u",
                "mean": "m",
                "median": "q2",
                "std": "sd",
                "min": "lo",
                "q25": "q1",
                "q75": "q3",
                "max": "hi",
                "range": "hi - lo",
                "iqr": "q3 - q1",
                "skew": "sk",
                "kurtosis": "ku",
                "zeros": "z",
                "negatives": "neg",
            }.items()
        ]
    )
    + ")"
)


@S.add("column_detail", _DETAIL)
def column_detail(spark, sf):
    return op.column_detail(derived(spark, sf, "gauges"), "disc")


@S.add(
    "column_detail_text",
    "WITH c AS (SELECT source AS v, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), "
    "s AS (SELECT count(*) AS rows, count(source) AS filled, (SELECT count(*) FROM c) AS u, "
    "(SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS mode, (SELECT n FROM c ORDER BY n DESC, v LIMIT 1) AS top, "
    "(SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM (SELECT * FROM c ORDER BY n DESC, v LIMIT 5)) AS ex FROM documents) "
    + union_sql(
        [
            f"SELECT '{k}' AS metric, round(({n})::DOUBLE, 6) AS number, CAST({t} AS STRING) AS text FROM s"
            for k, (n, t) in {
                "total": ("rows", "NULL"),
                "missing": ("rows - filled", "NULL"),
                "missing_pct": ("100.0 * (rows - filled) / rows", "NULL"),
                "unique": ("u", "NULL"),
                "mode": ("NULL", "mode"),
                "top_frequency": ("top", "NULL"),
                "top_pct": ("100.0 * top / filled", "NULL"),
                "examples": ("NULL", "ex"),
            }.items()
        ]
    ),
)
def column_detail_text(spark, sf):
    return op.column_detail(table(spark, sf, "documents"), "source")


_HEALTH = {
    "line": "bigint",
    "price": "double",
    "disc": "double",
    "tax": "double",
    "qty": "double",
    "peak": "double",
    "const_col": "double",
    "empty_col": "double",
    "returnflag": "string",
    "status": "string",
    "open_line": "boolean",
}


def _health_sql(types, source) -> str:
    return (
        f"WITH t AS ({source}), h AS ("
        + union_sql(
            [
                f"SELECT '{c}' AS \"column\", '{kind}' AS type, 100.0 * (count(*) - count({c})) / count(*) AS p, count(DISTINCT {c}) AS \"unique\", count(*) AS n FROM t"
                for c, kind in types.items()
            ]
        )
        + ') SELECT "column", type, round(p, 6) AS missing_pct, "unique", CASE WHEN p >= 50 THEN \'High missing\' WHEN p >= 10 THEN \'Some missing\' '
        "WHEN \"unique\" = 1 AND n > 1 THEN 'Constant' WHEN \"unique\" = n THEN 'Unique key' ELSE 'OK' END AS status FROM h"
    )


@S.add("column_health", _health_sql(_HEALTH, G))
def column_health(spark, sf):
    return op.column_health(derived(spark, sf, "gauges"))


@S.add(
    "column_health_customer",
    _health_sql(
        {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
        "SELECT * FROM customer",
    ),
)
def column_health_customer(spark, sf):
    return op.column_health(table(spark, sf, "customer"))


@S.add(
    "time_coverage",
    f"SELECT 'ts' AS \"column\", {ts_text('min(ts)')} AS start, {ts_text('max(ts)')} AS \"end\", "
    "round(epoch_us(max(ts) - min(ts)) / 1e6, 6) AS duration_seconds, count(ts) AS non_null FROM events",
)
def time_coverage(spark, sf):
    return op.time_coverage(table(spark, sf, "events"))


@S.add(
    "flag_outliers",
    f"WITH t AS (SELECT line, peak FROM ({G})), b AS (SELECT quantile_cont(peak, 0.25) AS q1, quantile_cont(peak, 0.75) AS q3 FROM t), "
    "k AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b) "
    "SELECT line, round(peak, 6) AS peak, round(lower, 6) AS lower, round(upper, 6) AS upper, (peak < lower OR peak > upper) AS is_outlier "
    "FROM t, k WHERE peak IS NOT NULL",
)
def flag_outliers(spark, sf):
    return op.flag_outliers(derived(spark, sf, "gauges", ["line", "peak"]), "peak")


@S.add(
    "flag_outliers_window",
    "WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'), "
    "b AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM w) "
    "SELECT event_type, count(*) AS n, count_if(value < m - 1.5 * s OR value > m + 1.5 * s)::BIGINT AS outliers, "
    "round(100.0 * count_if(value < m - 1.5 * s OR value > m + 1.5 * s) / count(*), 6) AS outlier_pct "
    "FROM w, b GROUP BY event_type",
)
def flag_outliers_window(spark, sf):
    flagged = op.flag_outliers(
        table(spark, sf, "events"), "value", "zscore", threshold=1.5, time_column="ts", start="2024-01-05 00:00:00", end="2024-01-20 00:00:00"
    )
    return op.outlier_counts(flagged, "event_type")


@S.add(
    "quality_status",
    f"WITH t AS (SELECT line, disc, tax, qty, returnflag, status, empty_col FROM ({G})), "
    "d AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM t GROUP BY line, disc, tax, qty, returnflag, status, empty_col)), "
    "m AS (SELECT count(*) AS rows, 7 * count(*) - count(line) - count(disc) - count(tax) - count(qty) - count(returnflag) - count(status) - count(empty_col) AS miss FROM t), "
    "p AS (SELECT *, 100.0 * miss / (7 * rows) AS mp, 100.0 * dup / rows AS dp FROM d, m) "
    "SELECT rows, CAST(7 AS BIGINT) AS columns, CAST(miss AS BIGINT) AS missing_cells, round(mp, 6) AS missing_pct, "
    "CASE WHEN mp >= 30 THEN 'bad' WHEN mp >= 10 THEN 'warn' ELSE 'ok' END AS missing_status, CAST(dup AS BIGINT) AS duplicates, "
    "round(dp, 6) AS duplicate_pct, CASE WHEN dp >= 20 THEN 'bad' WHEN dp >= 5 THEN 'warn' ELSE 'ok' END AS duplicate_status FROM p",
)
def quality_status(spark, sf):
    return op.quality_status(derived(spark, sf, "gauges", ["line", "disc", "tax", "qty", "returnflag", "status", "empty_col"]))


@S.add(
    "type_counts",
    f"WITH t AS ({G}), d AS (SELECT count(*) AS n, count(DISTINCT returnflag) AS a, count(DISTINCT status) AS b FROM t) "
    "SELECT 'numeric' AS kind, CAST(8 AS BIGINT) AS columns UNION ALL SELECT 'datetime', 0 UNION ALL "
    "SELECT 'categorical', 1 + CAST((a <= 50 OR (n >= 1000 AND a <= 0.5 * n)) AS INT) + CAST((b <= 50 OR (n >= 1000 AND b <= 0.5 * n)) AS INT) FROM d",
)
def type_counts(spark, sf):
    return op.type_counts(derived(spark, sf, "gauges"))


QUERIES, SQL = S.queries, S.sql
