"""Shared pieces: reading tables, derived columns, and comparable output.

The given tables are clean, so queries about dirt derive it: each derived column
is one expression that means the same in Spark and in DuckDB, and is used by both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.functions.columns import TIMES, col
from tableprobe.functions.frames import rounded
from tableprobe.session import configure

Query = Callable[[SparkSession, str], DataFrame]


class Section:
    """Collects queries and their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(build: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return comparable(build(configure(spark), sf_dir))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return build

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places and timestamps as text, the same on both sides."""
    out = rounded(df, digits)
    return out.select(
        *[
            F.date_format(col(f.name).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
            if isinstance(f.dataType, TIMES)
            else col(f.name)
            for f in out.schema.fields
        ]
    )


def ts_text(expression: str) -> str:
    """DuckDB text of a timestamp, in the form ``comparable`` gives it."""
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


# name -> (table, {column: expression valid in both engines})
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "readings": (
        "lineitem",
        {
            "l_orderkey": "l_orderkey",
            "l_linenumber": "l_linenumber",
            "qty_text": "CASE WHEN l_linenumber = 7 THEN 'No Data' WHEN l_linenumber = 6 THEN ' - ' "
            "ELSE CAST(CAST(l_quantity AS INT) AS STRING) END",
            "qty_mixed": "CASE WHEN l_orderkey % 5 < 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) "
            "ELSE concat('lot ', l_returnflag) END",
            "price_text": "CASE WHEN l_orderkey % 3 = 0 THEN '1,234.5' WHEN l_orderkey % 11 = 0 THEN '1d' "
            "ELSE CAST(l_extendedprice AS STRING) END",
            "flag_text": "CASE l_linestatus WHEN 'O' THEN 'Yes' ELSE ' no ' END",
            "ship_text": "CASE WHEN l_orderkey % 20 = 0 THEN 'n/a' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
            "disc": "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount END",
            "tax": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END",
            "qty_inf": "CASE WHEN l_linenumber = 1 THEN CAST('Infinity' AS DOUBLE) "
            "WHEN l_linenumber = 2 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END",
            "const_col": "CAST(1.0 AS DOUBLE)",
            "empty_col": "CAST(NULL AS DOUBLE)",
        },
    ),
    "gauges": (
        "lineitem",
        {
            "line": "CAST(l_linenumber AS BIGINT)",
            "price": "l_extendedprice",
            "disc": "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount END",
            "tax": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END",
            "qty": "l_quantity",
            "peak": "CASE WHEN l_quantity > 49 THEN l_quantity * 40 ELSE l_quantity END",
            "const_col": "CAST(1.0 AS DOUBLE)",
            "empty_col": "CAST(NULL AS DOUBLE)",
            "returnflag": "l_returnflag",
            "status": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END",
            "open_line": "l_linestatus = 'O'",
        },
    ),
    "stamps": (
        "events",
        {
            "event_id": "event_id",
            "ts": "ts",
            "value": "value",
            "gap_value": "CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END",
            "kind": "CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_type END",
        },
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    source, exprs = DERIVED[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{exprs[c]} AS {c}" for c in (columns or exprs)])


def derived_sql(name: str, columns: list[str] | None = None) -> str:
    source, exprs = DERIVED[name]
    return "SELECT " + ", ".join(f"{exprs[c]} AS {c}" for c in (columns or exprs)) + f" FROM {source}"


def quote_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
