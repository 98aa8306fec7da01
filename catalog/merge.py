"""Queries that stack tables or join them on time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Section, derived_sql, table, ts_text
from tableprobe.functions.frames import report_frame
from tableprobe.operators import merge as op

S = Section()


def _parts(spark, sf):
    """Orders by status: one part lacks a column, one has a column of another type."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return {
        "finished": orders.where("o_orderstatus = 'F'"),
        "open": orders.where("o_orderstatus = 'O'").drop("o_orderpriority"),
        "pending": orders.where("o_orderstatus NOT IN ('F', 'O')").withColumn("o_custkey", F.col("o_custkey").cast("string")),
    }


@S.add(
    "compare_schemas",
    "SELECT 'finished' AS \"table\", CAST([] AS VARCHAR[]) AS missing, ['o_orderpriority'] AS not_shared, ['o_custkey'] AS clashing FROM (SELECT count(*) FROM orders) UNION ALL "
    "SELECT 'open', ['o_orderpriority'], CAST([] AS VARCHAR[]), ['o_custkey'] UNION ALL SELECT 'pending', CAST([] AS VARCHAR[]), ['o_orderpriority'], ['o_custkey']",
)
def compare_schemas(spark, sf):
    return op.compare_schemas(spark, _parts(spark, sf))


@S.add(
    "type_survival",
    "WITH k AS (SELECT o_orderkey, o_orderkey + 9007199254740992 AS amount FROM orders) "
    "SELECT 'keys' AS \"table\", 'o_orderkey' AS \"column\", 'bigint' AS type, 'bigint' AS common_type, count(*) AS rows, count(o_orderkey) AS filled, count(o_orderkey) AS survive FROM k "
    "UNION ALL SELECT 'keys', 'amount', 'bigint', 'double', count(*), count(amount), CAST(count_if(CAST(CAST(amount AS DOUBLE) AS BIGINT) = amount) AS BIGINT) FROM k "
    "UNION ALL SELECT 'keys', 'code', 'string', 'string', count(*), count(o_comment), count(o_comment) FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'x' END AS o_comment FROM orders) "
    "UNION ALL SELECT 'prices', 'amount', 'double', 'double', count(*), count(o_totalprice), count(o_totalprice) FROM orders "
    "UNION ALL SELECT 'prices', 'code', 'bigint', 'string', count(*), count(o_custkey), count(o_custkey) FROM orders",
)
def type_survival(spark, sf):
    """Long numbers that doubles do not hold, and numbers next to text."""
    orders = table(spark, sf, "orders")
    key, code = F.col("o_orderkey").cast("long"), F.when(F.col("o_orderkey") % 5 > 0, "x")
    parts = {
        "keys": orders.select(key.alias("o_orderkey"), (key + 9007199254740992).alias("amount"), code.alias("code")),
        "prices": orders.select(F.col("o_totalprice").cast("double").alias("amount"), F.col("o_custkey").cast("long").alias("code")),
    }
    return op.type_survival(spark, parts)


@S.add(
    "align_columns",
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS part, o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, "
    "o_orderstatus, round(o_totalprice, 6) AS o_totalprice, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS o_orderpriority FROM orders",
)
def align_columns(spark, sf):
    """All parts, each under its name."""
    return reduce(DataFrame.unionAll, [df.select(F.lit(n).alias("part"), "*") for n, df in op.align_columns(_parts(spark, sf)).items()])


@S.add(
    "stack_tables",
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS source_file, o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, "
    "o_orderstatus, round(o_totalprice, 6) AS o_totalprice, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS o_orderpriority FROM orders",
)
def stack_tables(spark, sf):
    return op.stack_tables(_parts(spark, sf))


@S.add("stack_tables_single", "SELECT c_custkey, c_mktsegment FROM customer")
def stack_tables_single(spark, sf):
    return op.stack_tables({"only": table(spark, sf, "customer").select("c_custkey", "c_mktsegment")})


def _epochs(spark, sf):
    events = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return {
        "native": events.select("event_id", "ts"),
        "text": events.select("event_id", F.date_format(F.col("ts").cast("timestamp"), "dd/MM/yyyy HH:mm:ss").alias("when")),
        "epoch": events.select("event_id", (micros / 1000).cast("bigint").alias("ms")),
        "none": events.select("event_id", "event_type"),
    }


@S.add(
    "find_time_axis",
    "SELECT 'native' AS \"table\", 'ts' AS axis FROM (SELECT count(ts) FROM events) UNION ALL SELECT 'text', 'when' UNION ALL SELECT 'epoch', 'ms' UNION ALL SELECT 'none', NULL",
)
def find_time_axis(spark, sf):
    return report_frame(spark, [(n, op.find_time_axis(df)) for n, df in _epochs(spark, sf).items()], '`table` string, axis string')


@S.add(
    "choose_merge",
    "SELECT 'all timed' AS case_name, 'time_align' AS merge FROM (SELECT count(ts) FROM events) UNION ALL SELECT 'one untimed', 'stack' UNION ALL SELECT 'single', 'stack'",
)
def choose_merge(spark, sf):
    t = _epochs(spark, sf)
    cases = {"all timed": ["native", "epoch"], "one untimed": ["native", "none"], "single": ["native"]}
    return report_frame(spark, [(n, op.choose_merge({k: t[k] for k in keys})[0]) for n, keys in cases.items()], "case_name string, merge string")


_SIDES = derived_sql("stamps")


@S.add(
    "asof_join",
    f"WITH e AS (SELECT event_id, ts, gap_value, event_type FROM (SELECT s.*, events.event_type FROM ({_SIDES}) s JOIN events USING (event_id))), "
    "l AS (SELECT event_id, ts, gap_value AS reading FROM e WHERE event_type = 'click'), "
    "r AS (SELECT event_id AS lab_id, ts, gap_value AS assay FROM e WHERE event_type = 'purchase') "
    f"SELECT l.event_id, {ts_text('l.ts')} AS ts, round(l.reading, 6) AS reading, r.lab_id, round(r.assay, 6) AS assay FROM l ASOF LEFT JOIN r ON l.ts >= r.ts",
)
def asof_join(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "ts", "CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS v", "event_type")
    left = e.where("event_type = 'click'").select("event_id", "ts", F.col("v").alias("reading"))
    right = e.where("event_type = 'purchase'").select(F.col("event_id").alias("lab_id"), "ts", F.col("v").alias("assay"))
    return op.asof_join(left, right, "ts")


#: Small enough for many ranges of keys at every scale.
CHUNK_ROWS = 500


@S.add("asof_join_chunked", S.sql["asof_join"])
def asof_join_chunked(spark, sf):
    """The same over many ranges of keys."""
    e = table(spark, sf, "events").selectExpr("event_id", "ts", "CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS v", "event_type")
    left = e.where("event_type = 'click'").select("event_id", "ts", F.col("v").alias("reading"))
    right = e.where("event_type = 'purchase'").select(F.col("event_id").alias("lab_id"), "ts", F.col("v").alias("assay"))
    return op.asof_join(left, right, "ts", rows_per_chunk=CHUNK_ROWS)


@S.add(
    "asof_join_by_user",
    "WITH l AS (SELECT * FROM events WHERE event_type = 'view'), r AS (SELECT * FROM events WHERE event_type = 'click') "
    f"SELECT l.user_id, l.event_id, {ts_text('l.ts')} AS ts, r.event_id AS click_id, round(r.value, 6) AS click_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
)
def asof_join_by_user(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'view'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return op.asof_join(left, right, "ts", by=["user_id"])


@S.add(
    "asof_join_all_types",
    "WITH r AS (SELECT user_id, ts + INTERVAL 1 HOUR AS ts, max(event_id) AS earlier_id, arg_max(event_type, event_id) AS earlier_type FROM events GROUP BY ALL) "
    f"SELECT l.user_id, l.event_id, l.event_type, {ts_text('l.ts')} AS ts, r.earlier_id, r.earlier_type FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
)
def asof_join_all_types(spark, sf):
    """For every event, the latest one of the same user that is at least an hour older."""
    e = table(spark, sf, "events")
    right = e.select("user_id", F.expr("ts + INTERVAL 1 HOUR").alias("ts"), F.col("event_id").alias("earlier_id"), F.col("event_type").alias("earlier_type"))
    return op.asof_join(e.select("user_id", "event_id", "event_type", "ts"), right, "ts", by=["user_id"], tie=["earlier_id"])


@S.add(
    "time_align",
    "WITH a AS (SELECT 'views' AS source_file, event_id, ts, value FROM events WHERE event_type = 'view' UNION ALL SELECT 'clicks', event_id, ts, value FROM events WHERE event_type = 'click'), "
    "p AS (SELECT ts, value AS amount, 'purchases' AS src FROM events WHERE event_type = 'purchase') "
    f"SELECT a.source_file, a.event_id, {ts_text('a.ts')} AS ts, round(a.value, 6) AS value, round(p.amount, 6) AS amount, p.src AS source_file__purchases "
    "FROM a ASOF LEFT JOIN p ON a.ts >= p.ts",
)
def time_align(spark, sf):
    e = table(spark, sf, "events")
    when = F.col("ts").cast("timestamp")
    tables = {
        "views": e.where("event_type = 'view'").select("event_id", "ts", "value"),
        "clicks": e.where("event_type = 'click'").select("event_id", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("stamp"), "value"),
        "purchases": e.where("event_type = 'purchase'").select(when.alias("bought"), F.col("value").alias("amount")),
    }
    how, axes = op.choose_merge(tables)
    return op.time_align(tables, axes)


QUERIES, SQL = S.queries, S.sql
