"""Filter queries."""

from __future__ import annotations

from catalog.base import Section, derived, derived_sql, table, ts_text
from tableprobe.operators import filters as op

S = Section()
G = derived_sql("gauges")
LINE = "l_orderkey, l_linenumber, l_quantity, l_discount"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@S.add("filter_range", f"SELECT {LINE} FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20")
def filter_range(spark, sf):
    return op.filter_range(_lines(spark, sf), "l_quantity", 10, 20)


@S.add("filter_range_open", f"SELECT disc, qty FROM ({G}) WHERE disc >= 0.05")
def filter_range_open(spark, sf):
    return op.filter_range(derived(spark, sf, "gauges", ["disc", "qty"]), "disc", "0.05", "not a number")


@S.add("filter_range_crossed", "SELECT s_suppkey, s_acctbal FROM supplier")
def filter_range_crossed(spark, sf):
    return op.filter_range(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 20, 10)


@S.add("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark, sf):
    return op.filter_in(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"])


@S.add("filter_in_numbers", f"SELECT {LINE} FROM lineitem WHERE CAST(l_linenumber AS STRING) IN ('1', '3', '9')")
def filter_in_numbers(spark, sf):
    return op.filter_in(_lines(spark, sf), "l_linenumber", ["1", "3", "9"])


@S.add("filter_in_none", "SELECT n_nationkey, n_name FROM nation")
def filter_in_none(spark, sf):
    return op.filter_in(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name", [])


def _rule(df):
    return op.range_filter("disc", 0.03, 0.06) & op.in_filter(df, "status", ["O"])


@S.add(
    "filter_summary",
    f"WITH t AS ({G}), k AS (SELECT count(*) AS o, count_if(disc BETWEEN 0.03 AND 0.06 AND status = 'O')::BIGINT AS k FROM t) "
    "SELECT o AS original_rows, k AS kept_rows, o - k AS dropped_rows, round(100.0 * k / o, 6) AS percent_kept, "
    "['disc in [0.03, 0.06]', 'status in 1 values'] AS rules FROM k",
)
def filter_summary(spark, sf):
    df = derived(spark, sf, "gauges")
    return op.filter_summary(df, _rule(df))


@S.add(
    "excluded_rows",
    f"SELECT disc, status, qty FROM ({G}) WHERE NOT coalesce(disc BETWEEN 0.03 AND 0.06 AND status = 'O', false)",
)
def excluded_rows(spark, sf):
    df = derived(spark, sf, "gauges", ["disc", "status", "qty"])
    return op.excluded_rows(df, _rule(df))


@S.add(
    "filter_options",
    "WITH v AS (SELECT 'p_brand' AS \"column\", p_brand AS value FROM part GROUP BY p_brand UNION ALL "
    "SELECT 'p_type', p_type FROM part GROUP BY p_type UNION ALL SELECT 'p_name', p_name FROM part GROUP BY p_name) "
    'SELECT "column", value FROM v WHERE "column" IN (SELECT "column" FROM v GROUP BY "column" HAVING count(*) <= 200)',
)
def filter_options(spark, sf):
    return op.filter_options(table(spark, sf, "part"))[0]


@S.add(
    "filter_option_ranges",
    "SELECT 'p_partkey' AS \"column\", min(p_partkey)::DOUBLE AS low, max(p_partkey)::DOUBLE AS high FROM part UNION ALL "
    "SELECT 'p_size', min(p_size)::DOUBLE, max(p_size)::DOUBLE FROM part UNION ALL "
    "SELECT 'p_retailprice', round(min(p_retailprice), 6), round(max(p_retailprice), 6) FROM part",
)
def filter_option_ranges(spark, sf):
    return op.filter_options(table(spark, sf, "part"))[1]


@S.add(
    "filter_time_range",
    f"SELECT event_id, {ts_text('ts')} AS ts, round(value, 6) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'",
)
def filter_time_range(spark, sf):
    return op.filter_time_range(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", "2024-01-10 00:00:00", "2024-01-12 12:00:00")


@S.add(
    "filter_time_range_text",
    f"WITH t AS ({derived_sql('readings', ['l_orderkey', 'l_linenumber', 'ship_text'])}) "
    "SELECT * FROM t WHERE try_strptime(ship_text, '%Y-%m-%d') >= TIMESTAMP '1995-01-01'",
)
def filter_time_range_text(spark, sf):
    return op.filter_time_range(derived(spark, sf, "readings", ["l_orderkey", "l_linenumber", "ship_text"]), "ship_text", start="1995-01-01")


@S.add("preview", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(spark, sf):
    return op.preview(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


DIRTY = derived_sql("readings", ["l_orderkey", "l_linenumber", "qty_inf"])


def _dirty(spark, sf):
    return derived(spark, sf, "readings", ["l_orderkey", "l_linenumber", "qty_inf"])


@S.add("filter_range_nan", f"SELECT * FROM ({DIRTY}) WHERE isfinite(qty_inf) AND qty_inf >= 20")
def filter_range_nan(spark, sf):
    """NaN and infinity are missing, so an open range leaves them out."""
    return op.filter_range(_dirty(spark, sf), "qty_inf", 20, None)


@S.add(
    "filter_summary_nan",
    f"WITH t AS ({DIRTY}), k AS (SELECT count(*) AS o, count_if(isfinite(qty_inf) AND qty_inf >= 20)::BIGINT AS k FROM t) "
    "SELECT o AS original_rows, k AS kept_rows, o - k AS dropped_rows, round(100.0 * k / o, 6) AS percent_kept, ['qty_inf in [20, ]'] AS rules FROM k",
)
def filter_summary_nan(spark, sf):
    return op.filter_summary(_dirty(spark, sf), op.range_filter("qty_inf", 20, None))


@S.add(
    "filter_options_nan",
    f"SELECT 'qty_inf' AS \"column\", min(qty_inf) AS low, max(qty_inf) AS high FROM ({DIRTY}) WHERE isfinite(qty_inf)",
)
def filter_options_nan(spark, sf):
    return op.filter_options(_dirty(spark, sf).select("qty_inf"))[1]


@S.add("filter_time_range_mixed", f"SELECT event_id, {ts_text('ts')} AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts <= TIMESTAMP '2024-01-10'")
def filter_time_range_mixed(spark, sf):
    """Ends written in different forms are compared as times."""
    return op.filter_time_range(table(spark, sf, "events").select("event_id", "ts"), "ts", "2024-1-9", "2024-01-10")


@S.add("filter_time_range_crossed", f"SELECT event_id, {ts_text('ts')} AS ts FROM events")
def filter_time_range_crossed(spark, sf):
    """As text the first end is the smaller one, as a time it is the later."""
    return op.filter_time_range(table(spark, sf, "events").select("event_id", "ts"), "ts", "2024-10-9", "2024-9-10")


QUERIES, SQL = S.queries, S.sql
