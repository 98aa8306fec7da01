"""Queries for the data behind charts."""

from __future__ import annotations

from catalog.base import Section, derived, derived_sql, table
from tableprobe.operators import distribution as op

S = Section()
G = derived_sql("gauges")


def histogram_sql(source: str, c: str, bins: int) -> str:
    return (
        f"WITH t AS (SELECT {c} AS x FROM ({source}) WHERE {c} IS NOT NULL), "
        "b AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM t), "
        f"c AS (SELECT least(floor((x - lo) / ((hi - lo) / {bins})) + 1, {bins})::BIGINT AS bin, count(*) AS n FROM t, b GROUP BY 1), "
        f"s AS (SELECT unnest(range(1, {bins} + 1))::BIGINT AS bin) "
        f"SELECT s.bin, round(lo + (s.bin - 1) * ((hi - lo) / {bins}), 6) AS low, round(lo + s.bin * ((hi - lo) / {bins}), 6) AS high, coalesce(n, 0) AS n "
        "FROM s CROSS JOIN b LEFT JOIN c ON c.bin = s.bin"
    )


@S.add("histogram", histogram_sql("SELECT * FROM lineitem", "l_extendedprice", 30))
def histogram(spark, sf):
    return op.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


@S.add("histogram_peaks", histogram_sql(G, "peak", 40))
def histogram_peaks(spark, sf):
    return op.histogram(derived(spark, sf, "gauges"), "peak", 40)


@S.add("histogram_constant", histogram_sql(G, "const_col", 10))
def histogram_constant(spark, sf):
    return op.histogram(derived(spark, sf, "gauges"), "const_col", 10)


@S.add(
    "histogram_center",
    "SELECT round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem",
)
def histogram_center(spark, sf):
    return op.center(table(spark, sf, "lineitem"), "l_extendedprice")


@S.add(
    "box_stats",
    f"WITH t AS (SELECT peak AS x FROM ({G})), q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM t) "
    "SELECT count(x) AS n, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, "
    "round(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, "
    "count_if(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::BIGINT AS fliers FROM t, q",
)
def box_stats(spark, sf):
    return op.box_stats(derived(spark, sf, "gauges"), "peak")


def grouped_sql(source: str, category: str, value: str) -> str:
    return (
        f"WITH t AS (SELECT {category} AS category, {value}::DOUBLE AS x FROM ({source}) WHERE {category} IS NOT NULL AND {value} IS NOT NULL), "
        "q AS (SELECT category, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM t GROUP BY category) "
        "SELECT category, count(x) AS n, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, "
        "round(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, "
        "count_if(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::BIGINT AS fliers FROM t JOIN q USING (category) GROUP BY category"
    )


@S.add("grouped_box_stats", grouped_sql("SELECT * FROM part", "p_type", "p_retailprice"))
def grouped_box_stats(spark, sf):
    return op.grouped_box_stats(table(spark, sf, "part"), "p_type", "p_retailprice")


@S.add("grouped_box_stats_gaps", grouped_sql(G, "status", "peak"))
def grouped_box_stats_gaps(spark, sf):
    return op.grouped_box_stats(derived(spark, sf, "gauges"), "status", "peak")


@S.add("top_n_values", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 10")
def top_n_values(spark, sf):
    return op.top_n_values(table(spark, sf, "part"), "p_brand")


@S.add(
    "top_n_values_numbers",
    "SELECT CAST(p_size AS STRING) AS value, count(*) AS n FROM part GROUP BY p_size ORDER BY n DESC, value LIMIT 25",
)
def top_n_values_numbers(spark, sf):
    return op.top_n_values(table(spark, sf, "part"), "p_size", 25)


@S.add(
    "scatter_frame",
    f"SELECT disc AS x, tax AS y, returnflag AS color FROM ({G}) WHERE disc IS NOT NULL AND tax IS NOT NULL",
)
def scatter_frame(spark, sf):
    return op.scatter_frame(derived(spark, sf, "gauges"), "disc", "tax", "returnflag")


@S.add(
    "binned_scatter",
    "WITH b AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem) "
    "SELECT least(floor((l_quantity - x0) / ((x1 - x0) / 20)) + 1, 20)::BIGINT AS x_bin, "
    "least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)) + 1, 20)::BIGINT AS y_bin, count(*) AS n FROM lineitem, b GROUP BY 1, 2",
)
def binned_scatter(spark, sf):
    return op.binned_scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 20)


@S.add(
    "top_n_values_nan",
    f"SELECT CAST(qty_inf AS STRING) AS value, count(*) AS n FROM ({derived_sql('readings', ['qty_inf'])}) WHERE isfinite(qty_inf) "
    "GROUP BY qty_inf ORDER BY n DESC, value LIMIT 10",
)
def top_n_values_nan(spark, sf):
    return op.top_n_values(derived(spark, sf, "readings", ["qty_inf"]), "qty_inf")


QUERIES, SQL = S.queries, S.sql
