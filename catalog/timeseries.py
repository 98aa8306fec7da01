"""Time series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Section, derived, derived_sql, table, ts_text, union_sql
from tableprobe.functions.frames import report_frame
from tableprobe.operators import detect, timeseries as op

S = Section()
ST = derived_sql("stamps", ["event_id", "ts", "gap_value"])


@S.add("prepare_series", f"SELECT {ts_text('ts')} AS ts, round(gap_value, 6) AS gap_value FROM ({ST}) WHERE gap_value IS NOT NULL")
def prepare_series(spark, sf):
    return op.prepare_series(derived(spark, sf, "stamps"), "ts", "gap_value")


def rolling_sql(aggregate: str, seconds: int) -> str:
    build = {"mean": "avg", "sum": "sum", "count": "count", "std": "stddev_samp"}[aggregate]
    value = f"{build}(gap_value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '{seconds - 1}.999999 seconds' PRECEDING AND CURRENT ROW)"
    value = value if aggregate == "count" else f"round({value}, 6)"
    return (
        f"SELECT event_id, {ts_text('ts')} AS ts, round(gap_value, 6) AS gap_value, {value} AS rolling_{aggregate} "
        f"FROM ({ST}) WHERE gap_value IS NOT NULL"
    )


def _rolling(aggregate: str, seconds: int):
    def build(spark, sf):
        return op.rolling(derived(spark, sf, "stamps", ["event_id", "ts", "gap_value"]), "ts", "gap_value", seconds, aggregate)

    return build


for _aggregate, _seconds in (("mean", 3600), ("sum", 86400), ("count", 900), ("std", 21600)):
    S.add(f"rolling_{_aggregate}", rolling_sql(_aggregate, _seconds))(_rolling(_aggregate, _seconds))


@S.add("rolling_mean_chunked", S.sql["rolling_mean"])
def rolling_mean_chunked(spark, sf):
    """The same over many ranges of keys."""
    df = derived(spark, sf, "stamps", ["event_id", "ts", "gap_value"])
    return op.rolling(df, "ts", "gap_value", 3600, "mean", rows_per_chunk=500)


def resample_sql(source: str, time: str, values: list[str], step: str, aggregate: str) -> str:
    slot = {
        "5min": f"time_bucket(INTERVAL 5 minutes, {time})",
        "15min": f"time_bucket(INTERVAL 15 minutes, {time})",
        "30min": f"time_bucket(INTERVAL 30 minutes, {time})",
        "hour": f"date_trunc('hour', {time})",
        "day": f"date_trunc('day', {time})",
        "month": f"date_trunc('month', {time})",
    }[step]
    every = {"5min": "5 minutes", "15min": "15 minutes", "30min": "30 minutes", "hour": "1 hour", "day": "1 day", "month": "1 month"}[step]
    build = {"mean": "avg", "sum": "sum", "count": "count", "std": "stddev_samp"}[aggregate]
    out = []
    for v in values:
        x = {"sum": f"round(coalesce({v}, 0.0), 6)", "count": f"coalesce({v}, 0)"}.get(aggregate, f"round({v}, 6)")
        out.append(f"{x} AS {v}")
    return (
        f"WITH t AS (SELECT CAST({slot} AS TIMESTAMP) AS slot, {', '.join(values)} FROM ({source}) WHERE {time} IS NOT NULL), "
        f"g AS (SELECT slot, {', '.join(f'{build}({v}) AS {v}' for v in values)} FROM t GROUP BY slot), "
        f"s AS (SELECT unnest(generate_series((SELECT min(slot) FROM t), (SELECT max(slot) FROM t), INTERVAL {every})) AS slot) "
        f"SELECT {ts_text('s.slot')} AS {time}, {', '.join(out)} FROM s LEFT JOIN g ON g.slot = s.slot"
    )


_STAMPS = derived_sql("stamps")


def _resample(values, step, aggregate):
    def build(spark, sf):
        return op.resample(derived(spark, sf, "stamps"), "ts", values, step, aggregate)

    return build


for _name, _values, _step, _aggregate in (
    ("resample_5min_sum", ["value"], "5min", "sum"),
    ("resample_15min_mean", ["value", "gap_value"], "15min", "mean"),
    ("resample_30min_count", ["gap_value"], "30min", "count"),
    ("resample_hour_count", ["value", "gap_value"], "hour", "count"),
):
    S.add(_name, resample_sql(_STAMPS, "ts", _values, _step, _aggregate))(_resample(_values, _step, _aggregate))


@S.add("resample_day_sum", resample_sql("SELECT * FROM orders", "o_orderdate", ["o_totalprice"], "day", "sum"))
def resample_day_sum(spark, sf):
    return op.resample(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], "day", "sum")


@S.add("resample_month_std", resample_sql("SELECT * FROM orders", "o_orderdate", ["o_totalprice"], "month", "std"))
def resample_month_std(spark, sf):
    return op.resample(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], "month", "std")


@S.add("resample_raw", f"SELECT {ts_text('ts')} AS ts, round(gap_value, 6) AS gap_value FROM ({ST})")
def resample_raw(spark, sf):
    return op.resample(derived(spark, sf, "stamps"), "ts", ["gap_value"], None, "mean")


@S.add(
    "scale_groups",
    "WITH m AS (SELECT 'l_quantity' AS series, quantile_cont(abs(l_quantity), 0.5) AS m FROM lineitem UNION ALL "
    "SELECT 'l_extendedprice', quantile_cont(abs(l_extendedprice), 0.5) FROM lineitem UNION ALL SELECT 'l_tax', quantile_cont(abs(l_tax), 0.5) FROM lineitem) "
    "SELECT series, CASE WHEN m <= (SELECT sqrt(min(m) * max(m)) FROM m WHERE m > 0) THEN 1 ELSE 2 END AS axis FROM m",
)
def scale_groups(spark, sf):
    first, second = op.scale_groups(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return report_frame(spark, [(s, 1) for s in first] + [(s, 2) for s in second], "series string, axis int")


def trend_sql(source: str, time: str, value: str) -> str:
    return (
        f"WITH t AS (SELECT {time} AS ts, {value} AS v, row_number() OVER (ORDER BY {time}, {value}) - 1 AS i FROM ({source}) WHERE {time} IS NOT NULL AND {value} IS NOT NULL), "
        "s AS (SELECT count(*) AS n, regr_slope(v, i) AS slope, first(v ORDER BY i) AS \"first\", last(v ORDER BY i) AS \"last\" FROM t) "
        "SELECT n, round(slope, 6) AS slope, CASE WHEN abs(slope) < 1e-12 THEN 'flat' WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction, "
        'round("first", 6) AS "first", round("last", 6) AS "last", round("last" - "first", 6) AS net_change, round(100 * ("last" - "first") / "first", 6) AS pct_change FROM s'
    )


@S.add("trend_direction", trend_sql(ST, "ts", "gap_value"))
def trend_direction(spark, sf):
    return op.trend_direction(derived(spark, sf, "stamps"), "ts", "gap_value")


@S.add("trend_direction_orders", trend_sql("SELECT * FROM orders", "o_orderdate", "o_totalprice"))
def trend_direction_orders(spark, sf):
    return op.trend_direction(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@S.add(
    "peak_trough",
    f"SELECT 'peak' AS kind, {ts_text('o_orderdate')} AS time, round(o_totalprice, 6) AS value FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderdate LIMIT 1) UNION ALL "
    f"SELECT 'trough', {ts_text('o_orderdate')}, round(o_totalprice, 6) FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderdate LIMIT 1)",
)
def peak_trough(spark, sf):
    return op.peak_trough(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@S.add(
    "largest_steps",
    f"WITH d AS (SELECT ts, gap_value - lag(gap_value) OVER (ORDER BY ts, gap_value) AS step FROM ({ST}) WHERE gap_value IS NOT NULL) "
    f"SELECT 'rise' AS kind, {ts_text('ts')} AS time, round(step, 6) AS step FROM (SELECT * FROM d WHERE step > 0 ORDER BY step DESC, ts LIMIT 1) UNION ALL "
    f"SELECT 'fall', {ts_text('ts')}, round(step, 6) FROM (SELECT * FROM d WHERE step < 0 ORDER BY step, ts LIMIT 1)",
)
def largest_steps(spark, sf):
    return op.largest_steps(derived(spark, sf, "stamps"), "ts", "gap_value")


def autocorrelation_sql(source: str, time: str, value: str) -> str:
    return (
        f"WITH t AS (SELECT {value} AS v, row_number() OVER (ORDER BY {time}, {value}) AS i FROM ({source}) WHERE {value} IS NOT NULL), r AS ("
        + union_sql([f"SELECT CAST({k} AS BIGINT) AS lag, corr(a.v, b.v) AS r FROM t a JOIN t b ON a.i = b.i + {k}" for k in op.LAGS])
        + ") "
    )


@S.add("seasonality_lags", autocorrelation_sql(ST, "ts", "gap_value") + "SELECT lag, round(r, 6) AS r FROM r")
def seasonality_lags(spark, sf):
    return op.autocorrelation(derived(spark, sf, "stamps"), "ts", "gap_value")


_WAVE = "SELECT o_orderdate, o_totalprice + 300000 * sin(2 * pi() * date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 700.0) AS wave FROM orders"


@S.add(
    "seasonality",
    autocorrelation_sql(_WAVE, "o_orderdate", "wave") + "SELECT lag, round(r, 6) AS r FROM r WHERE abs(r) >= 0.3 ORDER BY abs(r) DESC, lag LIMIT 1",
)
def seasonality(spark, sf):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    wave = F.col("o_totalprice") + 300000 * F.sin(2 * F.pi() * days / 700.0)
    return op.seasonality(table(spark, sf, "orders").select("o_orderdate", wave.alias("wave")), "o_orderdate", "wave")


@S.add("seasonality_chunked", S.sql["seasonality"])
def seasonality_chunked(spark, sf):
    """The same over many ranges of keys."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    wave = F.col("o_totalprice") + 300000 * F.sin(2 * F.pi() * days / 700.0)
    return op.seasonality(table(spark, sf, "orders").select("o_orderdate", wave.alias("wave")), "o_orderdate", "wave", rows_per_chunk=500)


_TEXT = derived_sql("readings", ["ship_text", "qty_mixed", "flag_text"])


@S.add(
    "datetime_detection_summary",
    f"WITH t AS ({_TEXT}), c AS (SELECT count(CASE WHEN ship_text <> 'n/a' THEN 1 END) AS ok, count(ship_text) AS n FROM t) "
    "SELECT 'l_shipdate' AS \"column\", 'native' AS detected, 100.0::DOUBLE AS confidence, 0::BIGINT AS invalid UNION ALL "
    "SELECT 'ship_text', 'parseable', round(100.0 * ok / n, 6), n - ok FROM c",
)
def datetime_detection_summary(spark, sf):
    texts = derived(spark, sf, "readings", ["ship_text", "qty_mixed", "flag_text"])
    native = texts.withColumn("l_shipdate", F.current_timestamp())
    return detect.datetime_detection_summary(native.select("l_shipdate", "ship_text", "qty_mixed", "flag_text"))


@S.add(
    "detect_datetime_columns",
    f"WITH t AS ({_TEXT}), c AS (SELECT count(CASE WHEN ship_text <> 'n/a' THEN 1 END) AS ok, count(ship_text) AS n FROM t) "
    "SELECT 'ship_text' AS \"column\" FROM c WHERE ok >= 0.7 * n",
)
def detect_datetime_columns(spark, sf):
    names = detect.detect_datetime_columns(derived(spark, sf, "readings", ["ship_text", "qty_mixed", "flag_text"]))
    return report_frame(spark, [(n,) for n in names], "column string")


SPIKE = "CASE WHEN event_id = 10 THEN CAST(1e15 AS DOUBLE) ELSE value END"
OFFSET = "value + CAST(1e9 AS DOUBLE)"


def _range_sql(aggregate: str, value: str, seconds: int, digits: int) -> str:
    """DuckDB's own range frame; the start of the window is open."""
    frame = f"OVER (ORDER BY ts RANGE BETWEEN INTERVAL {seconds * 1_000_000 - 1} MICROSECONDS PRECEDING AND CURRENT ROW)"
    return f"SELECT event_id, round({aggregate}(v) {frame}, {digits}) AS out FROM (SELECT event_id, ts, {value} AS v FROM events) WHERE event_id <> 10"


@S.add("rolling_mean_spike", _range_sql("avg", SPIKE, 3600, 6).replace("WHERE event_id <> 10", "QUALIFY max(abs(v)) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) < 1e15"))
def rolling_mean_spike(spark, sf):
    """One huge value leaves nothing behind in the windows after it."""
    df = table(spark, sf, "events").selectExpr("event_id", "ts", f"{SPIKE} AS v")
    out = op.rolling(df, "ts", "v", 3600, "mean", "out")
    return out.where("out < 1e10").select("event_id", "out")


@S.add("rolling_std_spike", _range_sql("stddev_samp", SPIKE, 3600, 6).replace("WHERE event_id <> 10", "QUALIFY max(abs(v)) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) < 1e15"))
def rolling_std_spike(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "ts", f"{SPIKE} AS v")
    out = op.rolling(df, "ts", "v", 3600, "std", "out")
    return out.where("event_id <> 10 AND (out IS NULL OR out < 1e10)").select("event_id", "out")


@S.add("rolling_std_offset", _range_sql("stddev_samp", OFFSET, 3600, 2).replace(" WHERE event_id <> 10", ""))
def rolling_std_offset(spark, sf):
    """A large common part does not eat the digits of the spread."""
    df = table(spark, sf, "events").selectExpr("event_id", "ts", f"{OFFSET} AS v")
    return op.rolling(df, "ts", "v", 3600, "std", "out").select("event_id", F.round("out", 2).alias("out"))


QUERIES, SQL = S.queries, S.sql
