"""Queries about relations between columns and with a target."""

from __future__ import annotations

from itertools import combinations

from catalog.base import Section, derived, derived_sql, table, union_sql
from tableprobe.operators import relate as op

S = Section()
G = derived_sql("gauges")
NUM = ["line", "price", "disc", "tax", "qty", "peak", "const_col", "empty_col"]


def corr_sql(a: str, b: str) -> str:
    return f"(CASE WHEN isnan(corr({a}, {b})) OR abs(corr({a}, {b})) > 1.5 THEN NULL ELSE corr({a}, {b}) END)"


def pairs_sql(source=G, columns=NUM) -> str:
    return f"WITH t AS ({source}), r AS (" + union_sql(
        [f"SELECT {i} AS position, '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS r FROM t" for i, (a, b) in enumerate(combinations(columns, 2))]
    ) + ") "


@S.add("correlation_matrix", pairs_sql() + "SELECT a, b, round(r, 6) AS r FROM r")
def correlation_matrix(spark, sf):
    return op.correlation_matrix(derived(spark, sf, "gauges")).drop("position")


@S.add(
    "top_correlations",
    pairs_sql()
    + "SELECT a, b, round(r, 6) AS r, CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength, "
    "CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'neutral' END AS direction "
    "FROM r WHERE r IS NOT NULL ORDER BY abs(r) DESC, position LIMIT 5",
)
def top_correlations(spark, sf):
    return op.top_correlations(derived(spark, sf, "gauges"))


STRENGTH_R = (
    "CASE WHEN abs(r) >= 0.7 THEN 'Very Strong' WHEN abs(r) >= 0.5 THEN 'Strong' WHEN abs(r) >= 0.3 THEN 'Moderate' "
    "WHEN abs(r) >= 0.1 THEN 'Weak' ELSE 'Negligible' END"
)
STRENGTH_CV = (
    "CASE WHEN score >= 0.5 THEN 'Very Strong' WHEN score >= 0.2 THEN 'Strong' WHEN score >= 0.1 THEN 'Moderate' "
    "WHEN score >= 0.05 THEN 'Weak' ELSE 'Negligible' END"
)


@S.add(
    "target_correlations",
    f"WITH t AS ({G}), r AS ("
    + union_sql([f"SELECT '{c}' AS feature, {corr_sql(c, 'price')} AS r FROM t" for c in NUM if c != "price"])
    + f") SELECT feature, round(r, 6) AS r, {STRENGTH_R} AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM r",
)
def target_correlations(spark, sf):
    return op.target_correlations(derived(spark, sf, "gauges"), "price")


@S.add(
    "target_summary_numeric",
    'SELECT count(o_totalprice) AS count, count(*) - count(o_totalprice) AS missing, 0.0::DOUBLE AS missing_pct, count(DISTINCT o_totalprice) AS "unique", '
    "round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, round(min(o_totalprice), 6) AS min, "
    "round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS median, "
    "round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(max(o_totalprice), 6) AS max, round(skewness(o_totalprice), 6) AS skew, "
    "round(kurtosis(o_totalprice), 6) AS kurtosis FROM orders",
)
def target_summary_numeric(spark, sf):
    return op.target_summary(table(spark, sf, "orders"), "o_totalprice")["summary"]


@S.add(
    "target_summary_categorical",
    f"WITH t AS ({G}), c AS (SELECT status AS v, count(*) AS n FROM t WHERE status IS NOT NULL GROUP BY status), "
    "b AS (SELECT v, n FROM c ORDER BY n DESC, v LIMIT 1) "
    "SELECT count(*) AS rows, count(*) - count(status) AS missing, round(100.0 * (count(*) - count(status)) / count(*), 6) AS missing_pct, "
    'count(DISTINCT status) AS "unique", any_value(b.v) AS top_value, any_value(b.n) AS top_n, '
    "round(100.0 * any_value(b.n) / count(status), 6) AS top_pct FROM t, b",
)
def target_summary_categorical(spark, sf):
    return op.target_summary(derived(spark, sf, "gauges"), "status")["summary"]


@S.add(
    "target_classes",
    f"WITH t AS ({G}) SELECT status AS class, count(*) AS n, round(100.0 * count(*) / (SELECT count(status) FROM t), 6) AS pct "
    "FROM t WHERE status IS NOT NULL GROUP BY status",
)
def target_classes(spark, sf):
    return op.target_summary(derived(spark, sf, "gauges"), "status")["classes"]


@S.add(
    "group_means",
    f"WITH t AS ({G}) SELECT status, " + ", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in NUM) + " FROM t GROUP BY status",
)
def group_means(spark, sf):
    return op.group_means(derived(spark, sf, "gauges"), "status")


@S.add(
    "group_means_labels",
    "SELECT quality, round(avg(doc_id::DOUBLE), 6) AS doc_id, round(avg(toxic::DOUBLE), 6) AS toxic FROM labels GROUP BY quality",
)
def group_means_labels(spark, sf):
    return op.group_means(table(spark, sf, "labels"), "quality")


@S.add(
    "feature_importance",
    f"WITH t AS ({G}), g AS (SELECT returnflag, "
    + ", ".join(f"avg({c}::DOUBLE) AS {c}" for c in NUM)
    + " FROM t WHERE returnflag IS NOT NULL GROUP BY returnflag), s AS ("
    + union_sql(
        [
            f"SELECT '{c}' AS feature, coalesce((SELECT stddev_pop({c}) FROM g) / abs((SELECT nullif(avg({c}::DOUBLE), 0) FROM t)), 0.0) AS score"
            for c in NUM
        ]
    )
    + f") SELECT feature, round(score, 6) AS score, {STRENGTH_CV} AS strength FROM s",
)
def feature_importance(spark, sf):
    return op.feature_importance(derived(spark, sf, "gauges"), "returnflag")


@S.add(
    "feature_importance_orders",
    "WITH g AS (SELECT avg(o_orderkey::DOUBLE) AS a, avg(o_custkey::DOUBLE) AS b, avg(o_totalprice) AS c FROM orders GROUP BY o_orderpriority), s AS ("
    "SELECT 'o_orderkey' AS feature, stddev_pop(a) / (SELECT avg(o_orderkey::DOUBLE) FROM orders) AS score FROM g UNION ALL "
    "SELECT 'o_custkey', stddev_pop(b) / (SELECT avg(o_custkey::DOUBLE) FROM orders) FROM g UNION ALL "
    f"SELECT 'o_totalprice', stddev_pop(c) / (SELECT avg(o_totalprice) FROM orders) FROM g) SELECT feature, round(score, 6) AS score, {STRENGTH_CV} AS strength FROM s",
)
def feature_importance_orders(spark, sf):
    return op.feature_importance(table(spark, sf, "orders"), "o_orderpriority")


@S.add(
    "linear_fit",
    f"WITH t AS ({G}) SELECT regr_count(price, qty)::BIGINT AS n, round(regr_slope(price, qty), 6) AS slope, round(regr_intercept(price, qty), 6) AS intercept, "
    "round(min(qty), 6) AS x_min, round(max(qty), 6) AS x_max FROM t",
)
def linear_fit(spark, sf):
    return op.linear_fit(derived(spark, sf, "gauges"), "qty", "price")


@S.add(
    "linear_fit_gaps",
    f"WITH t AS (SELECT * FROM ({G}) WHERE disc IS NOT NULL AND tax IS NOT NULL) SELECT count(*) AS n, round(regr_slope(tax, disc), 6) AS slope, "
    "round(regr_intercept(tax, disc), 6) AS intercept, round(min(disc), 6) AS x_min, round(max(disc), 6) AS x_max FROM t",
)
def linear_fit_gaps(spark, sf):
    return op.linear_fit(derived(spark, sf, "gauges"), "disc", "tax")


@S.add(
    "group_means_nan",
    "SELECT CASE WHEN isfinite(qty_inf) THEN qty_inf END AS qty_inf, round(avg(l_orderkey), 6) AS l_orderkey "
    f"FROM ({derived_sql('readings', ['qty_inf', 'l_orderkey'])}) GROUP BY 1",
)
def group_means_nan(spark, sf):
    """Null, NaN and infinite targets are one group."""
    return op.group_means(derived(spark, sf, "readings", ["qty_inf", "l_orderkey"]), "qty_inf")


QUERIES, SQL = S.queries, S.sql
