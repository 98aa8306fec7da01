"""Queries for findings and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Section, derived, derived_sql, table, union_sql
from catalog.profile import NUM
from catalog.relate import STRENGTH_CV, pairs_sql
from tableprobe.functions.frames import report_frame
from tableprobe.operators import findings as op
from tableprobe.plans.storage import scratch_path

S = Section()
G = derived_sql("gauges")
ALL = [*NUM, "returnflag", "status", "open_line"]


@S.add(
    "findings_missing",
    f"WITH t AS ({G}), m AS ("
    + union_sql([f"SELECT '{c}' AS c, 100.0 * (count(*) - count({c})) / count(*) AS p FROM t" for c in ALL])
    + ") SELECT 'missing' AS rule, c AS subject, round(p, 6) AS value, format('missing: {} {:.1f} % (limit 20 %)', c, p) AS text FROM m WHERE p >= 20",
)
def findings_missing(spark, sf):
    return op.findings_missing(derived(spark, sf, "gauges"))


@S.add(
    "findings_missing_none",
    "SELECT 'missing' AS rule, CAST(NULL AS STRING) AS subject, 0.0::DOUBLE AS value, 'missing: nothing' AS text FROM (SELECT count(*) - count(o_totalprice) AS m FROM orders) WHERE m = 0",
)
def findings_missing_none(spark, sf):
    return op.findings_missing(table(spark, sf, "orders"))


@S.add(
    "findings_duplicates",
    "WITH d AS (SELECT sum(n - 1)::BIGINT AS d, sum(n) AS r FROM (SELECT count(*) AS n FROM documents GROUP BY text)) "
    "SELECT 'duplicates' AS rule, CAST(NULL AS STRING) AS subject, d::DOUBLE AS value, CASE WHEN d > 0 THEN format('duplicates: {} rows, {:.1f} %', d, 100.0 * d / r) ELSE 'duplicates: nothing' END AS text FROM d",
)
def findings_duplicates(spark, sf):
    return op.findings_duplicates(table(spark, sf, "documents").select("text"))


@S.add(
    "findings_correlation",
    pairs_sql() + "SELECT 'correlation' AS rule, a || ' ~ ' || b AS subject, round(r, 6) AS value, "
    "format('correlation: {} ~ {} {:+.2f} (limit 0.70)', a, b, r) AS text FROM r WHERE abs(r) >= 0.7 "
    "UNION ALL SELECT 'correlation', NULL, NULL, 'correlation: nothing (limit 0.70)' FROM r HAVING coalesce(max(abs(r)), 0) < 0.7",
)
def findings_correlation(spark, sf):
    return op.findings_correlation(derived(spark, sf, "gauges"))


_LINKED = "SELECT l_quantity AS qty, l_quantity * 3 + l_tax AS load, 50 - l_quantity + l_discount AS rest, l_tax AS tax FROM lineitem"


@S.add(
    "findings_correlation_strong",
    pairs_sql(_LINKED, ["qty", "load", "rest", "tax"]) + "SELECT 'correlation' AS rule, a || ' ~ ' || b AS subject, round(r, 6) AS value, "
    "format('correlation: {} ~ {} {:+.2f} (limit 0.70)', a, b, r) AS text FROM r WHERE abs(r) >= 0.7",
)
def findings_correlation_strong(spark, sf):
    linked = table(spark, sf, "lineitem").selectExpr(
        "l_quantity AS qty", "l_quantity * 3 + l_tax AS load", "50 - l_quantity + l_discount AS rest", "l_tax AS tax"
    )
    return op.findings_correlation(linked)


@S.add(
    "findings_skew",
    f"WITH t AS ({G}), s AS ("
    + union_sql([f"SELECT '{c}' AS c, skewness({c}::DOUBLE) AS k FROM t" for c in NUM])
    + ") SELECT 'skew' AS rule, c AS subject, round(k, 6) AS value, format('skew: {} {:+.2f} (limit 1.00)', c, k) AS text FROM s WHERE abs(k) >= 1",
)
def findings_skew(spark, sf):
    return op.findings_skew(derived(spark, sf, "gauges"))


@S.add(
    "findings_dominant",
    "WITH t AS (SELECT CASE WHEN l_linenumber <= 5 THEN 'usual' ELSE l_returnflag END AS mix, l_linestatus FROM lineitem), v AS ("
    + union_sql(
        [
            f"SELECT * FROM (SELECT '{c}' AS c, {c} AS v, 100.0 * count(*) / (SELECT count({c}) FROM t) AS p FROM t GROUP BY {c} ORDER BY p DESC, v LIMIT 1)"
            for c in ("mix", "l_linestatus")
        ]
    )
    + ") SELECT 'dominant' AS rule, c AS subject, round(p, 6) AS value, format('dominant: {} ''{}'' {:.1f} % (limit 60 %)', c, v, p) AS text FROM v WHERE p >= 60",
)
def findings_dominant(spark, sf):
    mix = F.when(F.col("l_linenumber") <= 5, "usual").otherwise(F.col("l_returnflag"))
    return op.findings_dominant(table(spark, sf, "lineitem").select(mix.alias("mix"), "l_linestatus"))


_WILD = "SELECT CASE WHEN l_linenumber = 1 THEN l_quantity * 100 ELSE l_quantity END AS wild, l_tax FROM lineitem"


@S.add(
    "findings_outliers",
    f"WITH t AS ({_WILD}), o AS ("
    + union_sql(
        [
            f"SELECT '{c}' AS c, count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS o, count({c}) AS n "
            f"FROM t, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t)"
            for c in ("wild", "l_tax")
        ]
    )
    + ") SELECT 'outliers' AS rule, c AS subject, round(100.0 * o / n, 6) AS value, format('outliers: {} {} values, {:.1f} % (limit 5 %)', c, o, 100.0 * o / n) AS text FROM o WHERE o > 0 AND 100.0 * o / n >= 5",
)
def findings_outliers(spark, sf):
    wild = F.when(F.col("l_linenumber") == 1, F.col("l_quantity") * 100).otherwise(F.col("l_quantity"))
    return op.findings_outliers(table(spark, sf, "lineitem").select(wild.alias("wild"), "l_tax"))


@S.add(
    "findings",
    "SELECT * FROM (SELECT 0 AS position, 'missing' AS rule, CAST(NULL AS STRING) AS subject, 0.0::DOUBLE AS value, 'missing: nothing' AS text "
    "FROM (SELECT 5 * count(*) - count(c_custkey) - count(c_name) - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment) AS m FROM customer) WHERE m = 0) UNION ALL "
    "SELECT 1, 'duplicates', NULL, d::DOUBLE, CASE WHEN d > 0 THEN format('duplicates: {} rows, {:.1f} %', d, 100.0 * d / r) ELSE 'duplicates: nothing' END "
    "FROM (SELECT sum(n - 1)::BIGINT AS d, sum(n) AS r FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)) UNION ALL "
    "SELECT 2, 'correlation', NULL, NULL, 'correlation: nothing (limit 0.70)' FROM (SELECT greatest(abs(corr(c_custkey, c_nationkey)), abs(corr(c_custkey, c_acctbal)), abs(corr(c_nationkey, c_acctbal))) AS r FROM customer) WHERE r < 0.7",
)
def findings(spark, sf):
    return op.findings(table(spark, sf, "customer"))


@S.add(
    "target_findings",
    f"WITH t AS ({G}), g AS (SELECT returnflag, "
    + ", ".join(f"avg({c}::DOUBLE) AS {c}" for c in NUM)
    + " FROM t GROUP BY returnflag), s AS ("
    + union_sql(
        [
            f"SELECT {i} AS i, '{c}' AS feature, coalesce((SELECT stddev_pop({c}) FROM g) / abs((SELECT nullif(avg({c}::DOUBLE), 0) FROM t)), 0.0) AS score"
            for i, c in enumerate(NUM)
        ]
    )
    + f"), k AS (SELECT *, lower({STRENGTH_CV}) AS word FROM s) "
    "SELECT 'group_means' || CASE WHEN score < 0.05 THEN '_none' ELSE '' END AS rule, feature AS subject, round(score, 6) AS value, "
    "format('{} and returnflag: {} ({:+.2f})', feature, word, score) AS text FROM k",
)
def target_findings(spark, sf):
    return op.target_findings(derived(spark, sf, "gauges"), "returnflag")


@S.add("merge_findings", "SELECT line FROM (SELECT 'open lacks 1 columns others have: o_orderpriority.' AS line UNION ALL SELECT '1 shared columns have different types across tables.' UNION ALL "
    "SELECT format('o_custkey becomes string: {} of {} filled cells keep their value.', count(CAST(o_custkey AS STRING)), count(o_custkey)) FROM orders) WHERE (SELECT count(*) FROM orders) > 0")
def merge_findings(spark, sf):
    from catalog.merge import _parts
    from tableprobe.operators.merge import compare_schemas, type_survival

    parts = _parts(spark, sf)
    lines = op.merge_findings(compare_schemas(spark, parts), {"merge": "stack"}, type_survival(spark, parts))
    return report_frame(spark, [(line,) for line in lines], "line string")


@S.add(
    "sanitize_findings",
    "SELECT format('Cleaned {:,} placeholder values.', count_if(event_type = 'error')) AS line FROM events",
)
def sanitize_findings(spark, sf):
    from tableprobe.operators.typing import sanitize

    lines = op.sanitize_findings(sanitize(table(spark, sf, "events").select("event_id", "event_type", "value"))[1])
    return report_frame(spark, [(line,) for line in lines], "line string")


@S.add(
    "report_tables",
    union_sql(
        [
            f"SELECT '{name}' AS section, {rows}::BIGINT AS rows"
            for name, rows in {
                "overview": 1,
                "quality": 1,
                "types": 3,
                "time_coverage": "(SELECT count(*) FROM (SELECT 1 FROM orders HAVING max(o_orderdate) > min(o_orderdate)))",
                "column_health": 6,
                "numeric": 3,
                "correlation": 3,
                "top_correlations": 3,
            }.items()
        ]
    ),
)
def report_tables(spark, sf):
    """Written below the shared folder and read back, one Parquet folder per section."""
    paths = op.write_report(table(spark, sf, "orders"), scratch_path(spark, "report"))
    parts = [spark.read.parquet(p).agg(F.lit(n).alias("section"), F.count(F.lit(1)).alias("rows")) for n, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")
_FIELDS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_MEASURES = {
    "count": "count({c})",
    "unique": "count(DISTINCT {c})",
    "mean": "avg({c}::DOUBLE)",
    "std": "stddev_samp({c}::DOUBLE)",
    "min": "min({c})",
    "q25": "quantile_cont({c}::DOUBLE, 0.25)",
    "median": "quantile_cont({c}::DOUBLE, 0.5)",
    "q75": "quantile_cont({c}::DOUBLE, 0.75)",
    "max": "max({c})",
    "skew": "skewness({c}::DOUBLE)",
    "kurtosis": "kurtosis({c}::DOUBLE)",
}


def _told(section: str, subject: str, metric: str, number: str, source: str = "orders") -> str:
    return f"SELECT '{section}' AS section, '{subject}' AS subject, '{metric}' AS metric, round(({number})::DOUBLE, 6) AS number FROM {source}"


@S.add(
    "report_contents",
    union_sql(
        [
            _told("overview", "table", "rows", "count(*)"),
            _told("overview", "table", "columns", "6", "(SELECT 1)"),
            _told("overview", "table", "missing_cells", " + ".join(f"count(*) - count({c})" for c in _FIELDS)),
            _told("quality", "table", "duplicates", "sum(n - 1)", f"(SELECT count(*) AS n FROM orders GROUP BY {', '.join(_FIELDS)})"),
            _told("types", "numeric", "columns", "3", "(SELECT 1)"),
            _told("types", "categorical", "columns", "(count(DISTINCT o_orderstatus) <= 10)::INT + (count(DISTINCT o_orderpriority) <= 10)::INT"),
            _told("types", "datetime", "columns", "1", "(SELECT 1)"),
            _told("time_coverage", "o_orderdate", "duration_seconds", "epoch(max(o_orderdate)) - epoch(min(o_orderdate))"),
            _told("time_coverage", "o_orderdate", "non_null", "count(o_orderdate)"),
            *[_told("column_health", c, "unique", f"count(DISTINCT {c})") for c in _FIELDS],
            *[_told("column_health", c, "missing_pct", f"100.0 * (count(*) - count({c})) / count(*)") for c in _FIELDS],
            *[_told("numeric", c, m, e.format(c=c)) for c in _NUMBERS for m, e in _MEASURES.items()],
            *[_told("correlation", f"{a} ~ {b}", "r", f"corr({a}::DOUBLE, {b}::DOUBLE)") for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]],
        ]
    ),
)
def report_contents(spark, sf):
    """Every number of the sections, one below the other."""
    report = op.report_tables(table(spark, sf, "orders"))
    whole, pair = F.lit("table"), F.concat_ws(" ~ ", "a", "b")
    wanted = {
        "overview": (whole, ("rows", "columns", "missing_cells")),
        "quality": (whole, ("duplicates",)),
        "types": (F.col("kind"), ("columns",)),
        "time_coverage": (F.col("column"), ("duration_seconds", "non_null")),
        "column_health": (F.col("column"), ("unique", "missing_pct")),
        "numeric": (F.col("column"), tuple(_MEASURES)),
        "correlation": (pair, ("r",)),
    }
    out = None
    for section, (subject, metrics) in wanted.items():
        numbers = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("number")) for m in metrics]
        part = report[section].select(F.lit(section).alias("section"), subject.alias("subject"), F.inline(F.array(*numbers)))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES, SQL = S.queries, S.sql
