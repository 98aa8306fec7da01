"""Queries that convert types, read dates and fill gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Section, derived, derived_sql, quote_list, table, ts_text, union_sql
from catalog.typing import clean
from tableprobe.functions.frames import report_frame
from tableprobe.functions.text import DATE_NULL_TOKENS
from tableprobe.operators import dates, detect, prepare as op

S = Section()
DATES = quote_list(DATE_NULL_TOKENS)


@S.add("drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(spark, sf):
    return op.drop_columns(table(spark, sf, "customer"), ["c_name", "c_acctbal", "not there"])


_TYPED = ["l_orderkey", "qty_text", "flag_text", "ship_text", "disc"]
_Q = derived_sql("readings", _TYPED)


def _stamp(c: str) -> str:
    return ts_text(f"try_strptime({c}, '%Y-%m-%d')")


def _convert(name: str, target: str):
    def build(spark, sf):
        return op.convert_type(derived(spark, sf, "readings", _TYPED), name, target)[0]

    return build


_REST = {"l_orderkey": "l_orderkey", "qty_text": "qty_text", "flag_text": "flag_text", "ship_text": "ship_text", "disc": "round(disc, 6)"}


def _convert_sql(name: str, expression: str) -> str:
    return f"WITH t AS ({_Q}) SELECT " + ", ".join(f"{expression if c == name else e} AS {c}" for c, e in _REST.items()) + " FROM t"


for _case, _name, _target, _expression in (
    ("convert_type_int", "qty_text", "int", "try_cast(CASE WHEN regexp_matches(trim(qty_text), '^[0-9]+$') THEN trim(qty_text) END AS BIGINT)"),
    ("convert_type_float", "qty_text", "float", "try_cast(CASE WHEN regexp_matches(trim(qty_text), '^[0-9]+$') THEN trim(qty_text) END AS DOUBLE)"),
    ("convert_type_int_refused", "disc", "int", "round(disc, 6)"),
    ("convert_type_string", "l_orderkey", "string", "CAST(l_orderkey AS STRING)"),
    ("convert_type_category", "flag_text", "category", "flag_text"),
    ("convert_type_datetime", "ship_text", "datetime", _stamp("ship_text")),
    ("convert_type_boolean", "flag_text", "boolean", "lower(trim(flag_text)) = 'yes'"),
):
    S.add(_case, _convert_sql(_name, _expression))(_convert(_name, _target))


@S.add(
    "convert_type_report",
    f"WITH t AS ({_Q}) SELECT count_if(NOT regexp_matches(trim(qty_text), '^[0-9]+$'))::BIGINT AS lost_int, count_if(ship_text = 'n/a')::BIGINT AS lost_datetime, "
    "count_if(disc <> floor(disc)) > 0 AS int_refused FROM t",
)
def convert_type_report(spark, sf):
    df = derived(spark, sf, "readings", _TYPED)
    row = (op.convert_type(df, "qty_text", "int")[1], op.convert_type(df, "ship_text", "datetime")[1], op.convert_type(df, "disc", "int")[2] is not None)
    return report_frame(spark, [row], "lost_int bigint, lost_datetime bigint, int_refused boolean")


_BUILDER = {"YYYY/MM/DD HH-mm-ss": "%Y/%m/%d %H-%M-%S", "DD-MM-YYYY HH.mm.ss": "%d-%m-%Y %H.%M.%S", "YYYY-MM-DDTHH:mm:ss": "%Y-%m-%dT%H:%M:%S", "YYYYMMDDHHmmss": "%Y%m%d%H%M%S"}


@S.add(
    "builder_to_pattern",
    "SELECT event_id, " + ", ".join(f"strftime(ts, '{p}') AS f{i}" for i, p in enumerate(_BUILDER.values())) + " FROM events",
)
def builder_to_pattern(spark, sf):
    # Field letters in the result print without padding, so only touching fields keep two digits.
    wide = {f: dates.builder_to_pattern(f) for f in _BUILDER}
    pads = {"M": "MM", "d": "dd", "H": "HH", "m": "mm", "s": "ss"}

    def padded(pattern: str) -> str:
        out, quoted = "", False
        for i, ch in enumerate(pattern):
            quoted ^= ch == "'"
            single = ch in pads and not quoted and (i == 0 or pattern[i - 1] != ch) and (i + 1 == len(pattern) or pattern[i + 1] != ch)
            out += pads[ch] if single else ch
        return out

    t = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", *[F.date_format(t, padded(p)).alias(f"f{i}") for i, p in enumerate(wide.values())])


_MIXED = (
    "CASE WHEN event_id % 4 = 0 THEN 'n/a' WHEN event_id % 4 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_id % 4 = 2 THEN strftime(ts, '%d-%m-%Y %H:%M:%S') ELSE 'later' END"
)


def _mixed(spark, sf):
    t = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, "n/a")
        .when(k == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(t, "dd-MM-yyyy HH:mm:ss"))
        .otherwise("later")
    )
    return table(spark, sf, "events").select("event_id", text.alias("stamp"))


@S.add(
    "parse_datetime",
    f"SELECT event_id, {ts_text('''try_strptime(stamp, '%d-%m-%Y %H:%M:%S')''')} AS stamp FROM (SELECT event_id, {_MIXED} AS stamp FROM events)",
)
def parse_datetime(spark, sf):
    return dates.parse_datetime(_mixed(spark, sf), "stamp", "DD-MM-YYYY HH:mm:ss")[0]


@S.add(
    "parse_datetime_inferred",
    f"SELECT event_id, {ts_text('''CASE WHEN event_id % 4 IN (1, 2) THEN date_trunc('second', ts) END''')} AS stamp FROM events",
)
def parse_datetime_inferred(spark, sf):
    return dates.parse_datetime(_mixed(spark, sf), "stamp", dayfirst=True)[0]


# Form -> (pattern to write a time in, what is left of it in SQL).
FORMS = (
    ("MM/dd/yy", "date_trunc('day', ts)"),
    ("MM/dd/yyyy h:mm a", "date_trunc('minute', ts)"),
    ("HH:mm", "TIMESTAMP '1970-01-01' + (date_trunc('minute', ts) - date_trunc('day', ts))"),
    ("MMM yyyy", "date_trunc('month', ts)"),
    ("yyyy-MM", "date_trunc('month', ts)"),
    ("EEE, dd MMM yyyy HH:mm:ss", "date_trunc('second', ts)"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS'789'", "ts"),
)


def _written(form: str):
    return F.date_format(F.col("ts").cast("timestamp"), form)


@S.add(
    "parse_datetime_forms",
    f"SELECT event_id, CASE event_id % {len(FORMS) + 1} "
    + " ".join(f"WHEN {k} THEN {ts_text(f'CAST({left} AS TIMESTAMP)')}" for k, (_, left) in enumerate(FORMS))
    + " END AS stamp FROM events",
)
def parse_datetime_forms(spark, sf):
    """Every event's time in one of seven written forms, or a text that is no date."""
    text = F.lit("no 7th of anything")
    for k, (form, _) in enumerate(FORMS):
        text = F.when(F.col("event_id") % (len(FORMS) + 1) == k, _written(form)).otherwise(text)
    return dates.parse_datetime(table(spark, sf, "events").select("event_id", text.alias("stamp")), "stamp")[0]


@S.add(
    "detect_datetime_forms",
    "\nUNION ALL\n".join(
        f"SELECT 'form_{k}' AS \"column\", 'parseable' AS detected, round(100.0 * count(*) FILTER (event_id % 20 <> {k}) / count(*), 6) AS confidence,"
        f" count(*) FILTER (event_id % 20 = {k}) AS invalid FROM events"
        for k in range(len(FORMS))
    ),
)
def detect_datetime_forms(spark, sf):
    """A column in each form, each with other rows that are no dates, beside one of words."""
    events = table(spark, sf, "events")
    columns = [F.when(F.col("event_id") % 20 == k, "soon").otherwise(_written(form)).alias(f"form_{k}") for k, (form, _) in enumerate(FORMS)]
    return detect.datetime_detection_summary(events.select(*columns, F.col("event_type").alias("kind")))


@S.add(
    "parse_datetime_stats",
    "WITH c AS (SELECT count(*) AS total, count_if(event_id % 4 <> 0)::BIGINT AS n, count_if(event_id % 4 = 2)::BIGINT AS ok FROM events) "
    "SELECT total, n AS non_null, ok AS parsed, n - ok AS failed, round(100.0 * ok / n, 6) AS percent FROM c",
)
def parse_datetime_stats(spark, sf):
    return dates.parse_datetime(_mixed(spark, sf), "stamp", "DD-MM-YYYY HH:mm:ss")[1]


@S.add(
    "suggest_formats",
    "WITH t AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE strftime(l_shipdate, '%d/%m/%Y') END AS s FROM lineitem), v AS ("
    + union_sql(
        [
            f"SELECT '{f}' AS format, count(try_strptime(s, '{p}')) AS parsed, count(s) AS non_null FROM t"
            for f, p in (("DD/MM/YYYY", "%d/%m/%Y"), ("MM/DD/YYYY", "%m/%d/%Y"), ("YYYY-MM-DD", "%Y-%m-%d"))
        ]
    )
    + ") SELECT format, parsed, non_null, round(100.0 * parsed / non_null, 6) AS percent FROM v WHERE parsed >= 0.5 * non_null",
)
def suggest_formats(spark, sf):
    text = F.when(F.col("l_orderkey") % 3 != 0, F.date_format(F.col("l_shipdate").cast("timestamp"), "dd/MM/yyyy"))
    return dates.suggest_formats(table(spark, sf, "lineitem").select(text.alias("s")), "s")


_CLOCK = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'bad' ELSE strftime(ts, '%H:%M:%S') END"


def _clocked(spark, sf):
    t = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 5
    clock = F.when(k == 1, "bad").when(k > 1, F.date_format(t, "HH:mm:ss"))
    day = F.when(F.col("event_id") % 7 != 0, F.date_format(t, "yyyy-MM-dd"))
    return table(spark, sf, "events").select("event_id", "ts", day.alias("day"), clock.alias("clock"))


_JOINED = "try_strptime(CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d') || ' ' || coalesce(" + _CLOCK + ", '00:00:00') END, '%Y-%m-%d %H:%M:%S')"


@S.add("combine_date_time", f"SELECT event_id, {ts_text(_JOINED)} AS merged FROM events")
def combine_date_time(spark, sf):
    return dates.combine_date_time(_clocked(spark, sf), "day", "clock", "merged", "YYYY-MM-DD", "HH:mm:ss")[0].select("event_id", "merged")


@S.add(
    "combine_date_time_native",
    f"SELECT event_id, {ts_text('''CASE event_id % 5 WHEN 1 THEN NULL WHEN 0 THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('second', ts) END''')} AS merged FROM events",
)
def combine_date_time_native(spark, sf):
    return dates.combine_date_time(_clocked(spark, sf), "ts", "clock", "merged")[0].select("event_id", "merged")


@S.add(
    "combine_date_time_stats",
    f"WITH c AS (SELECT count(*) AS total, count_if(event_id % 7 <> 0)::BIGINT AS n, count({_JOINED}) AS ok FROM events) "
    "SELECT total, n AS non_null, ok AS parsed, n - ok AS failed, round(100.0 * ok / n, 6) AS percent FROM c",
)
def combine_date_time_stats(spark, sf):
    return dates.combine_date_time(_clocked(spark, sf), "day", "clock", "merged")[1]


_NUM = {
    "excel": "epoch_us(ts) / 86400e6 + 25569",
    "seconds": "epoch_us(ts) / 1e6",
    "millis": "epoch_us(ts) / 1e3",
    "value": "value",
}


def _encoded(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf, "events").select(
        "event_id", (us / 86400e6 + 25569).alias("excel"), (us / 1e6).alias("seconds"), (us / 1e3).alias("millis"), "value"
    )


@S.add(
    "detect_numeric_datetime",
    "SELECT 'excel' AS \"column\", 'excel_serial' AS mode, 100.0::DOUBLE AS excel_serial, 0.0::DOUBLE AS unix_s, 0.0::DOUBLE AS unix_ms FROM (SELECT count(*) FROM events) UNION ALL "
    "SELECT 'seconds', 'unix_s', 0.0, 100.0, 0.0 UNION ALL SELECT 'millis', 'unix_ms', 0.0, 0.0, 100.0 UNION ALL "
    "SELECT 'value', NULL, round(100.0 * count_if(value BETWEEN 10000 AND 80000) / count(*), 6), 0.0, 0.0 FROM events",
)
def detect_numeric_datetime(spark, sf):
    return dates.detect_numeric_datetime(_encoded(spark, sf).drop("event_id")).drop("position")


_SECOND = ts_text("date_trunc('second', ts)")


@S.add(
    "convert_numeric_datetime",
    f"SELECT event_id, {_SECOND} AS t_excel, {_SECOND} AS t_seconds, {_SECOND} AS t_millis FROM events",
)
def convert_numeric_datetime(spark, sf):
    us = F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp"))).cast("double")
    df = table(spark, sf, "events").select("event_id", (us / 86400e6 + 25569).alias("excel"), (us / 1e6).alias("seconds"), (us / 1e3).alias("millis"))
    df, _ = dates.convert_numeric_datetime(df, "excel", "excel_serial", "t_excel")
    df, _ = dates.convert_numeric_datetime(df, "seconds", "unix_s", "t_seconds")
    df, _ = dates.convert_numeric_datetime(df, "millis", "unix_ms", "t_millis")
    # Serial days carry about a microsecond of rounding, so whole seconds are compared.
    near = F.date_trunc("second", F.col("t_excel") + F.expr("INTERVAL 0.5 SECOND"))
    return df.select("event_id", near.alias("t_excel"), "t_seconds", "t_millis")


_STAMPS = derived_sql("stamps")
_KEYS = ["event_id", "ts", "gap_value", "kind"]


def _fill(rules, order_by=()):
    def build(spark, sf):
        return op.fill_missing(derived(spark, sf, "stamps", _KEYS), rules, order_by)

    return build


def _fill_sql(gap: str = "round(gap_value, 6)", kind: str = "kind", where: str = "true") -> str:
    return f"WITH t AS ({_STAMPS}) SELECT event_id, {ts_text('ts')} AS ts, {gap} AS gap_value, {kind} AS kind FROM t WHERE {where}"


_MODE = "(SELECT kind FROM t WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)"
_ORDERED = "OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_REVERSED = "OVER (ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BOTH = ["ts", "event_id"]

for _case, _rules, _order, _sql in (
    ("fill_drop_rows", [("gap_value", "drop_rows", None)], (), _fill_sql(where="gap_value IS NOT NULL")),
    ("fill_mean", [("gap_value", "mean", None)], (), _fill_sql("round(coalesce(gap_value, (SELECT avg(gap_value) FROM t)), 6)")),
    ("fill_median", [("gap_value", "median", None)], (), _fill_sql("round(coalesce(gap_value, (SELECT quantile_cont(gap_value, 0.5) FROM t)), 6)")),
    ("fill_mode", [("kind", "mode", None)], (), _fill_sql(kind=f"coalesce(kind, {_MODE})")),
    ("fill_constant", [("gap_value", "constant", "-1.5"), ("kind", "constant", "none given")], (), _fill_sql("round(coalesce(gap_value, -1.5), 6)", "coalesce(kind, 'none given')")),
    ("fill_ffill", [("gap_value", "ffill", None), ("kind", "ffill", None)], _BOTH, _fill_sql(f"round(last_value(gap_value IGNORE NULLS) {_ORDERED}, 6)", f"last_value(kind IGNORE NULLS) {_ORDERED}")),
    ("fill_bfill", [("gap_value", "bfill", None)], _BOTH, _fill_sql(f"round(last_value(gap_value IGNORE NULLS) {_REVERSED}, 6)")),
    (
        "fill_sequence",
        [("kind", "drop_rows", None), ("gap_value", "mean", None)],
        (),
        _fill_sql("round(coalesce(gap_value, (SELECT avg(gap_value) FROM t WHERE kind IS NOT NULL)), 6)", where="kind IS NOT NULL"),
    ),
):
    S.add(_case, _sql)(_fill(_rules, _order))


@S.add("fill_ffill_chunked", S.sql["fill_ffill"])
def fill_ffill_chunked(spark, sf):
    """The same over many ranges of keys."""
    df = derived(spark, sf, "stamps", _KEYS)
    for column in ("gap_value", "kind"):
        df = op.fill_neighbor(df, column, _BOTH, rows_per_chunk=500)
    return df


_SPEC = ["l_orderkey", "l_linenumber", "qty_text", "ship_text", "flag_text", "disc", "tax"]


@S.add(
    "prepare",
    f"WITH t AS (SELECT l_orderkey, l_linenumber, try_cast(CASE WHEN regexp_matches(trim(qty_text), '^[0-9]+$') THEN trim(qty_text) END AS BIGINT) AS q, ship_text, "
    f"lower(trim(flag_text)) = 'yes' AS flag_text, disc FROM ({derived_sql('readings', _SPEC)})) "
    f"SELECT l_orderkey, l_linenumber, coalesce(q::DOUBLE, (SELECT quantile_cont(q::DOUBLE, 0.5) FROM t WHERE disc IS NOT NULL)) AS qty_text, {_stamp('ship_text')} AS ship_text, flag_text, round(disc, 6) AS disc "
    "FROM t WHERE disc IS NOT NULL",
)
def prepare(spark, sf):
    spec = {
        "drop": ["tax"],
        "text_dates": {"ship_text": "YYYY-MM-DD"},
        "types": {"qty_text": "int", "flag_text": "boolean", "ship_text": "string"},
        "missing": {"qty_text": "median", "disc": "drop_rows"},
    }
    return op.prepare(derived(spark, sf, "readings", _SPEC), spec)[0]


@S.add(
    "failed_values",
    f"SELECT {clean('qty_mixed', DATES)} AS value, count(*) AS n FROM ({derived_sql('readings', ['qty_mixed'])}) GROUP BY 1 ORDER BY n DESC, value LIMIT 20",
)
def failed_values(spark, sf):
    return dates.failed_values(derived(spark, sf, "readings", ["qty_mixed"]), "qty_mixed")[0]


@S.add("failed_values_distinct", f"SELECT count(DISTINCT {clean('qty_mixed', DATES)}) AS distinct_failures FROM ({derived_sql('readings', ['qty_mixed'])})")
def failed_values_distinct(spark, sf):
    return dates.failed_values(derived(spark, sf, "readings", ["qty_mixed"]), "qty_mixed")[1]


@S.add(
    "schema_diff",
    "SELECT 'disc' AS \"column\", 'dropped' AS change, 'double' AS before, CAST(NULL AS STRING) AS after FROM (SELECT count(*) FROM lineitem) UNION ALL "
    "SELECT 'extra', 'added', NULL, 'int' UNION ALL SELECT 'qty_text', 'retyped', 'string', 'bigint'",
)
def schema_diff(spark, sf):
    before = derived(spark, sf, "readings", _TYPED)
    after = op.convert_type(before, "qty_text", "int")[0].drop("disc").withColumn("extra", F.lit(1))
    return report_frame(spark, op.schema_diff(before, after), "column string, change string, before string, after string")


@S.add(
    "fill_mode_nan",
    f"WITH t AS ({derived_sql('readings', ['l_orderkey', 'l_linenumber', 'qty_inf'])}), "
    "best AS (SELECT qty_inf AS v FROM t WHERE isfinite(qty_inf) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(qty_inf) THEN qty_inf ELSE v END AS qty_inf FROM t, best",
)
def fill_mode_nan(spark, sf):
    return op.fill_missing(derived(spark, sf, "readings", ["l_orderkey", "l_linenumber", "qty_inf"]), [("qty_inf", "mode", None)])


QUERIES, SQL = S.queries, S.sql
