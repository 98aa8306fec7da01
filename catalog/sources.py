"""Queries that go through files: write a table, read it back, load and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Section, table, ts_text
from tableprobe.functions.columns import col
from tableprobe.functions.frames import report_frame
from tableprobe.plans.storage import scratch_path
from tableprobe.sources import readers, writers

S = Section()
ORDERS = f"SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, {ts_text('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders"


def _written(spark, sf, name, write, extension):
    path = f"{scratch_path(spark, name)}.{extension}"
    write(table(spark, sf, name), path)
    return path


@S.add(
    "read_csv",
    "SELECT CAST(s_suppkey AS STRING) AS s_suppkey, s_name, CAST(s_nationkey AS STRING) AS s_nationkey, CAST(s_acctbal AS STRING) AS s_acctbal FROM supplier",
)
def read_csv(spark, sf):
    return readers.read_csv(spark, _written(spark, sf, "supplier", writers.write_csv, "csv"))


@S.add("read_json", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def read_json(spark, sf):
    return readers.read_json(spark, _written(spark, sf, "supplier", writers.write_json, "json"), lines=True)


@S.add("read_parquet", ORDERS)
def read_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/orders.parquet")


@S.add("load_table", ORDERS)
def load_table(spark, sf):
    return readers.load_table(spark, _written(spark, sf, "orders", writers.write_csv, "csv"))[0]


@S.add("write_csv", ORDERS)
def write_csv(spark, sf):
    back = readers.read_csv(spark, _written(spark, sf, "orders", writers.write_csv, "csv"))
    schema = table(spark, sf, "orders").schema
    return back.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@S.add("write_json", ORDERS)
def write_json(spark, sf):
    schema = table(spark, sf, "orders").schema
    return spark.read.schema(schema).json(_written(spark, sf, "orders", writers.write_json, "json"))


@S.add("write_parquet", ORDERS)
def write_parquet(spark, sf):
    return spark.read.parquet(_written(spark, sf, "orders", writers.write_parquet, "parquet"))


@S.add("export_table", "SELECT 'parquet' AS format, count(*) AS rows, CAST(6 AS BIGINT) AS columns FROM orders")
def export_table(spark, sf):
    audit = writers.export_table(table(spark, sf, "orders"), scratch_path(spark, "export"), "Parquet (.parquet)", "my orders")
    return audit.select("format", "rows", "columns")


@S.add(
    "apply_header_overrides",
    "SELECT o_orderkey AS \"order key\", o_custkey AS \"customer\", round(o_totalprice, 6) AS price FROM orders",
)
def apply_header_overrides(spark, sf):
    """A file that starts with two lines of notes before its real header."""
    orders = table(spark, sf, "orders").select(*[col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(("o_orderkey", "o_custkey", "o_totalprice"))])
    notes = report_frame(
        spark, [(1, "Plant export", None, None), (2, "made", "today", None), (3, " order key", "customer ", "price")], "at int, _c0 string, _c1 string, _c2 string"
    )
    ordered = notes.unionByName(orders.withColumn("at", F.lit(9)))
    raw = ordered.withColumn(readers.ORDER, F.struct(F.col("at"), F.col("_c0").alias("key"))).drop("at")
    return readers.apply_header_overrides(raw, 2, True)[0]


@S.add(
    "load_many",
    "SELECT 'customer' AS name, 'ok' AS status, count(*) AS rows FROM customer UNION ALL SELECT 'supplier', 'ok', count(*) FROM supplier UNION ALL SELECT 'missing', 'failed', 0",
)
def load_many(spark, sf):
    folder = scratch_path(spark, "many")
    paths = [f"{folder}/customer.csv", f"{folder}/missing.csv", f"{folder}/supplier.json"]
    writers.write_csv(table(spark, sf, "customer"), paths[0])
    writers.write_json(table(spark, sf, "supplier"), paths[2])
    _, report = readers.load_many(spark, paths, lines=True)
    return report["files"].select(F.split("file", r"\.")[0].alias("name"), "status", "rows")


@S.add(
    "load_many_merged",
    "SELECT 'customer.csv' AS source_file, c_custkey, c_acctbal, CAST(NULL AS BIGINT) AS s_suppkey FROM (SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer) UNION ALL "
    "SELECT 'supplier.json', NULL, NULL, s_suppkey FROM supplier",
)
def load_many_merged(spark, sf):
    folder = scratch_path(spark, "many")
    paths = [f"{folder}/customer.csv", f"{folder}/supplier.json"]
    writers.write_csv(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), paths[0])
    writers.write_json(table(spark, sf, "supplier").select("s_suppkey"), paths[1])
    return readers.load_many(spark, paths, lines=True)[0]


_BAD = "o_orderkey % 25 IN (3, 4)"


def _ragged(spark, sf, path):
    """Orders as CSV lines, some with a field too many and some with one too few."""
    key, customer, priority = (F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderpriority"))
    line = F.when(F.col("o_orderkey") % 25 == 3, F.concat_ws(",", key, customer, priority, F.lit("more"))).when(F.col("o_orderkey") % 25 == 4, F.concat_ws(",", key, customer)).otherwise(F.concat_ws(",", key, customer, priority))
    # one column under a name that is the header of three
    lines = table(spark, sf, "orders").select(line.alias("o_orderkey,o_custkey,o_orderpriority"))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return path


@S.add("load_table_malformed", f"SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE NOT ({_BAD})")
def load_table_malformed(spark, sf):
    return readers.load_table(spark, _ragged(spark, sf, f"{scratch_path(spark, 'ragged')}.csv"))[0]


@S.add(
    "load_table_malformed_lines",
    "SELECT CASE o_orderkey % 25 WHEN 3 THEN concat_ws(',', o_orderkey, o_custkey, o_orderpriority, 'more') ELSE concat_ws(',', o_orderkey, o_custkey) END AS line "
    f"FROM orders WHERE {_BAD}",
)
def load_table_malformed_lines(spark, sf):
    return readers.load_table(spark, _ragged(spark, sf, f"{scratch_path(spark, 'ragged')}.csv"))[1]["malformed"].select("line")


@S.add(
    "load_many_malformed",
    f"SELECT 'orders.csv' AS file, 'ok' AS status, count(*) FILTER (NOT ({_BAD})) AS rows, count(*) FILTER ({_BAD}) AS malformed FROM orders UNION ALL "
    "SELECT 'supplier.jsonl', 'ok', count(*) FILTER (s_suppkey % 7 <> 2), count(*) FILTER (s_suppkey % 7 = 2) FROM supplier UNION ALL "
    "SELECT 'customer.csv', 'ok', count(*), 0 FROM customer",
)
def load_many_malformed(spark, sf):
    folder = scratch_path(spark, "many")
    paths = [f"{folder}/orders.csv", f"{folder}/supplier.jsonl", f"{folder}/customer.csv"]
    _ragged(spark, sf, paths[0])
    record = F.to_json(F.struct("s_suppkey", "s_name"))
    broken = F.when(F.col("s_suppkey") % 7 == 2, F.substring(record, 1, 12)).otherwise(record)
    table(spark, sf, "supplier").select(broken.alias("value")).write.text(paths[1])
    writers.write_csv(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), paths[2])
    _, report = readers.load_many(spark, paths)
    return report["files"].select("file", "status", "rows", "malformed")


def _exported(spark, sf, name, fmt):
    folder = scratch_path(spark, "round-trip")
    file = writers.export_table(table(spark, sf, name), folder, fmt, name).first()["name"]
    return readers.load_table(spark, f"{folder}/{file}")[0]


@S.add(
    "roundtrip_csv_documents",
    "SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS text_md5, lang, source, n_chars FROM documents",
)
def roundtrip_csv_documents(spark, sf):
    """Prose with quotes, commas and line breaks, loaded without options; only blanks at its ends are cleaned away."""
    return _exported(spark, sf, "documents", "csv").select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


EVENTS = f"SELECT event_id, {ts_text('ts')} AS ts, user_id, nullif(event_type, 'error') AS event_type, round(value, 6) AS value, props FROM events"


@S.add("roundtrip_csv_events", EVENTS)
def roundtrip_csv_events(spark, sf):
    return _exported(spark, sf, "events", "csv")


@S.add("roundtrip_json_events", EVENTS)
def roundtrip_json_events(spark, sf):
    """With all microseconds, which the format has on request."""
    path = f"{scratch_path(spark, 'round-trip')}.json"
    writers.write_json(table(spark, sf, "events"), path, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return readers.load_table(spark, path)[0]


@S.add("load_table_jsonl", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def load_table_jsonl(spark, sf):
    """The form that this library writes, under its usual name and without a flag."""
    return _exported(spark, sf, "customer", "json")


@S.add("load_many_jsonl", "SELECT 'customer.json' AS file, 'ok' AS status, count(*) AS rows FROM customer UNION ALL SELECT 'supplier.json', 'ok', count(*) FROM supplier")
def load_many_jsonl(spark, sf):
    folder = scratch_path(spark, "many")
    for name in ("customer", "supplier"):
        writers.write_json(table(spark, sf, name), f"{folder}/{name}.json")
    _, report = readers.load_many(spark, [f"{folder}/customer.json", f"{folder}/supplier.json"])
    return report["files"].select("file", "status", "rows")


QUERIES, SQL = S.queries, S.sql
