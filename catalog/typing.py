"""Queries about names, placeholders and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Section, derived, derived_sql, quote_list, table, ts_text, union_sql
from tableprobe.functions.frames import report_frame
from tableprobe.functions.text import NUMERIC_NULL_TOKENS, PLACEHOLDER_TOKENS
from tableprobe.operators import typing as op

S = Section()
TEXTS = ["qty_text", "qty_mixed", "price_text", "flag_text", "ship_text"]
R = derived_sql("readings", TEXTS)
TOKENS = quote_list(PLACEHOLDER_TOKENS)
NULLS = quote_list(NUMERIC_NULL_TOKENS)
NUMBER = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
GROUPED = "'^-?[0-9]{1,3}(,[0-9]{3})+(\\.[0-9]+)?$'"


def clean(c: str, tokens: str = TOKENS) -> str:
    return f"(CASE WHEN lower(trim({c})) IN ({tokens}) THEN NULL ELSE trim({c}) END)"


def number(x: str) -> str:
    plain = f"(CASE WHEN regexp_matches({x}, {GROUPED}) THEN replace({x}, ',', '') ELSE {x} END)"
    return f"(CASE WHEN regexp_matches({plain}, {NUMBER}) THEN try_cast({plain} AS DOUBLE) END)"


@S.add("clean_column_names", 'SELECT s_suppkey AS "supplier id", s_name AS "Value", s_nationkey AS "Value_2", round(s_acctbal, 6) AS unnamed_column FROM supplier')
def clean_column_names(spark, sf):
    raw = table(spark, sf, "supplier").toDF(" supplier\nid", "Value", "Value ", " ")
    return op.clean_column_names(raw)[0]


@S.add(
    "clean_column_names_report",
    "SELECT 'Value ' AS original, 'Value' AS cleaned, count(*) AS rows FROM supplier UNION ALL SELECT ' ', 'unnamed_column', count(*) FROM supplier",
)
def clean_column_names_report(spark, sf):
    raw = table(spark, sf, "supplier").toDF("a", "b", "Value ", " ")
    named, renames, _ = op.clean_column_names(raw)
    pairs = F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("cleaned")) for a, b in renames.items()])
    return named.select(F.explode(pairs).alias("p")).groupBy("p.original", "p.cleaned").agg(F.count(F.lit(1)).alias("rows"))


@S.add("sanitize_tokens", f"WITH t AS ({R}) SELECT " + ", ".join(f"{clean(c)} AS {c}" for c in TEXTS) + " FROM t")
def sanitize_tokens(spark, sf):
    return op.sanitize_tokens(derived(spark, sf, "readings", TEXTS))


@S.add(
    "sanitize_tokens_events",
    f"SELECT event_id, {clean('event_type')} AS event_type FROM events",
)
def sanitize_tokens_events(spark, sf):
    return op.sanitize_tokens(table(spark, sf, "events").select("event_id", "event_type"))


@S.add(
    "sanitize_token_counts",
    f"WITH t AS ({R}), c AS ("
    + union_sql([f"SELECT '{c}' AS \"column\", count_if(lower(trim({c})) IN ({TOKENS}))::BIGINT AS replaced FROM t" for c in TEXTS])
    + ") SELECT * FROM c WHERE replaced > 0",
)
def sanitize_token_counts(spark, sf):
    return op.token_counts(derived(spark, sf, "readings", TEXTS))


@S.add(
    "promote_numeric",
    f"WITH t AS (SELECT {', '.join(f'{clean(c)} AS {c}' for c in TEXTS)} FROM ({R})) "
    f"SELECT CAST({number('qty_text')} AS BIGINT) AS qty_text, qty_mixed, round({number('price_text')}, 6) AS price_text, flag_text, ship_text FROM t",
)
def promote_numeric(spark, sf):
    return op.promote_numeric(op.sanitize_tokens(derived(spark, sf, "readings", TEXTS)))[0]


@S.add(
    "promote_numeric_report",
    f"WITH t AS (SELECT {', '.join(f'{clean(c)} AS {c}' for c in TEXTS)} FROM ({R})), v AS ("
    + union_sql([f"SELECT '{c}' AS \"column\", count({number(c)}) AS valid, count({c}) - count({number(c)}) AS invalid FROM t" for c in TEXTS])
    + ") SELECT \"column\", valid, invalid FROM v WHERE valid >= 0.7 * (valid + invalid)",
)
def promote_numeric_report(spark, sf):
    log = op.promote_numeric(op.sanitize_tokens(derived(spark, sf, "readings", TEXTS)))[1]
    return report_frame(spark, [(r["column"], r["valid"], r["invalid"]) for r in log], "column string, valid bigint, invalid bigint")


SHIP = ["l_orderkey", "l_linenumber", "ship_text", "flag_text"]


@S.add(
    "promote_datetime",
    f"WITH t AS ({derived_sql('readings', SHIP)}) SELECT l_orderkey, l_linenumber, {ts_text('try_strptime(ship_text, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')')} AS ship_text, flag_text FROM t",
)
def promote_datetime(spark, sf):
    return op.promote_datetime(derived(spark, sf, "readings", SHIP))[0]


@S.add(
    "promote_boolean",
    f"WITH t AS ({derived_sql('readings', ['l_orderkey', 'qty_mixed', 'flag_text'])}) "
    "SELECT l_orderkey, qty_mixed, lower(trim(flag_text)) IN ('true', 'yes', 'y', 't') AS flag_text FROM t",
)
def promote_boolean(spark, sf):
    return op.promote_boolean(derived(spark, sf, "readings", ["l_orderkey", "qty_mixed", "flag_text"]))[0]


INF = derived_sql("readings", ["l_orderkey", "l_linenumber", "qty_inf"])


@S.add(
    "replace_infinities",
    f"WITH t AS ({INF}) SELECT l_orderkey, l_linenumber, CASE WHEN isnan(qty_inf) OR isinf(qty_inf) THEN NULL ELSE qty_inf END AS qty_inf FROM t",
)
def replace_infinities(spark, sf):
    return op.replace_infinities(derived(spark, sf, "readings", ["l_orderkey", "l_linenumber", "qty_inf"]))


@S.add("replace_infinities_count", f"WITH t AS ({INF}) SELECT count_if(isinf(qty_inf))::BIGINT AS infinities FROM t")
def replace_infinities_count(spark, sf):
    return op.infinity_count(derived(spark, sf, "readings", ["l_orderkey", "l_linenumber", "qty_inf"]))


def _low(d: str, n: str) -> str:
    return f"{d} >= 1 AND (({n} >= 1000 AND {d} <= 0.5 * {n}) OR {d} <= 50)"


@S.add(
    "tag_categoricals",
    "WITH d AS (SELECT 'text' AS \"column\", count(DISTINCT text) AS \"unique\", count(*) AS n FROM documents UNION ALL "
    "SELECT 'lang', count(DISTINCT lang), count(*) FROM documents UNION ALL SELECT 'source', count(DISTINCT source), count(*) FROM documents) "
    f'SELECT "column", "unique" FROM d WHERE {_low(chr(34) + "unique" + chr(34), "n")}',
)
def tag_categoricals(spark, sf):
    log = op.tag_categoricals(table(spark, sf, "documents"))[1]
    return report_frame(spark, [(r["column"], r["unique"]) for r in log], "column string, unique bigint")


def _json_floats() -> str:
    return "'[' || array_to_string(list_transform(embedding, x -> x), ',') || ']'"


@S.add("stringify_nested", "SELECT vec_id, label, len(embedding)::INT AS n_values FROM embeddings")
def stringify_nested(spark, sf):
    flat, _ = op.stringify_nested(table(spark, sf, "embeddings"))
    return flat.select("vec_id", "label", F.size(F.from_json("embedding", "array<float>")).alias("n_values"))


@S.add("stringify_nested_text", "SELECT o_orderkey, '{\"c\":' || o_custkey || ',\"s\":\"' || o_orderstatus || '\"}' AS item, '[' || o_orderkey || ',' || o_custkey || ']' AS keys FROM orders")
def stringify_nested_text(spark, sf):
    orders = table(spark, sf, "orders")
    nested = orders.select(
        "o_orderkey", F.struct(F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s")).alias("item"), F.array("o_orderkey", "o_custkey").alias("keys")
    )
    return op.stringify_nested(nested)[0]


@S.add(
    "sanitize",
    f"WITH t AS (SELECT {', '.join(f'{clean(c)} AS {c}' for c in TEXTS)}, qty_inf FROM ({derived_sql('readings', TEXTS + ['qty_inf'])})) "
    f"SELECT CAST({number('qty_text')} AS BIGINT) AS qty_text, qty_mixed, round({number('price_text')}, 6) AS price_text, "
    f"lower(flag_text) = 'yes' AS flag_text, {ts_text('try_strptime(ship_text, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')')} AS ship_text, "
    "CASE WHEN isnan(qty_inf) OR isinf(qty_inf) THEN NULL ELSE qty_inf END AS qty_inf FROM t",
)
def sanitize(spark, sf):
    return op.sanitize(derived(spark, sf, "readings", TEXTS + ["qty_inf"]))[0]


@S.add(
    "sanitize_report",
    "SELECT count(*) AS input_rows, CAST(6 AS BIGINT) AS numeric_or_date_or_boolean_or_text, "
    f"CAST(sum({' + '.join(f'CAST(lower(trim({c})) IN ({TOKENS}) AS INT)' for c in TEXTS)}) AS BIGINT) AS tokens_replaced, "
    "count_if(isinf(qty_inf))::BIGINT AS infinities_replaced "
    f"FROM ({derived_sql('readings', TEXTS + ['qty_inf'])})",
)
def sanitize_report(spark, sf):
    _, r = op.sanitize(derived(spark, sf, "readings", TEXTS + ["qty_inf"]))
    return report_frame(
        spark,
        [(r["input_rows"], len(r["detected_types"]), r["tokens_replaced_total"], r["infinities_replaced"])],
        "input_rows bigint, numeric_or_date_or_boolean_or_text bigint, tokens_replaced bigint, infinities_replaced bigint",
    )


KINDS = ["l_orderkey", "qty_text", "qty_mixed", "flag_text", "disc", "empty_col"]


def _kind(c: str) -> str:
    if c in ("l_orderkey", "disc", "empty_col"):
        return "'numeric'"
    return f"CASE WHEN {_low(f'count(DISTINCT {c})', 'count(*)')} THEN 'categorical' ELSE 'string' END"


@S.add(
    "logical_types",
    f"WITH t AS ({derived_sql('readings', KINDS)}) "
    + union_sql([f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'empty' ELSE {_kind(c)} END AS logical_type FROM t" for c in KINDS]),
)
def logical_types(spark, sf):
    return op.logical_types(derived(spark, sf, "readings", KINDS))


@S.add(
    "split_columns",
    "WITH d AS (SELECT 'categorical' AS kind, 'text' AS \"column\", count(DISTINCT text) AS d, count(*) AS n FROM documents UNION ALL "
    "SELECT 'categorical', 'lang', count(DISTINCT lang), count(*) FROM documents UNION ALL SELECT 'categorical', 'source', count(DISTINCT source), count(*) FROM documents) "
    f'SELECT kind, "column" FROM d WHERE {_low("d", "n")} UNION ALL SELECT \'numeric\', \'doc_id\' UNION ALL SELECT \'numeric\', \'n_chars\'',
)
def split_columns(spark, sf):
    groups = op.split_columns(table(spark, sf, "documents"))
    return report_frame(spark, [(k, c) for k, v in groups.items() for c in v], "kind string, column string")


@S.add(
    "numeric_convertibility",
    f"WITH r AS ({R}), v AS ("
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(x) AS non_null, count({number('x')}) AS valid, count(x) - count({number('x')}) AS invalid, "
            f"coalesce((SELECT list(raw ORDER BY raw) FROM (SELECT DISTINCT raw FROM (SELECT {c} AS raw, {clean(c, NULLS)} AS x FROM r) "
            f"WHERE x IS NOT NULL AND {number('x')} IS NULL ORDER BY raw LIMIT 5)), []) AS invalid_examples "
            f"FROM (SELECT {clean(c, NULLS)} AS x FROM r)"
            for c in TEXTS
        ]
    )
    + ') SELECT "column", non_null, valid, invalid, round(100.0 * valid / non_null, 6) AS valid_pct, round(100.0 * invalid / non_null, 6) AS invalid_pct, '
    "valid >= 0.7 * non_null AS convertible, invalid_examples FROM v",
)
def numeric_convertibility(spark, sf):
    return op.numeric_convertibility(derived(spark, sf, "readings", TEXTS))


@S.add(
    "smart_convert",
    f"WITH t AS (SELECT l_orderkey, qty_mixed, {clean('price_text', NULLS)} AS p FROM ({derived_sql('readings', ['l_orderkey', 'qty_mixed', 'price_text'])})) "
    f"SELECT l_orderkey, qty_mixed, round({number('p')}, 6) AS price_text FROM t",
)
def smart_convert(spark, sf):
    return op.smart_convert(derived(spark, sf, "readings", ["l_orderkey", "qty_mixed", "price_text"]))[0]


@S.add(
    "detect_low_unique_numeric",
    "WITH t AS (SELECT doc_id, quality, toxic, quality + toxic AS marks, quality * 3 AS triple FROM labels), v AS ("
    + union_sql(
        [f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x, count(*) AS n FROM t GROUP BY {c}" for c in ("doc_id", "quality", "toxic", "marks", "triple")]
    )
    + '), s AS (SELECT "column", count(*) AS "unique", min(x) AS lo, max(x) AS hi, list(x ORDER BY n DESC, x)[1:6] AS examples FROM v GROUP BY "column"), '
    "b AS (SELECT *, (\"unique\" = 2 AND lo = 0 AND hi = 1) OR (\"unique\" = 2 AND lo = 1 AND hi = 2) OR (\"unique\" = 3 AND lo = -1 AND hi = 1) OR "
    '("unique" = 3 AND lo = 0 AND hi = 2) AS boolean_like FROM s) '
    'SELECT "column", "unique", round("unique" / (SELECT count(*) FROM t), 6) AS unique_ratio, boolean_like, examples FROM b '
    'WHERE "unique" >= 2 AND (boolean_like OR ("unique" <= 10 AND "unique" <= 0.01 * (SELECT count(*) FROM t)))',
)
def detect_low_unique_numeric(spark, sf):
    labels = table(spark, sf, "labels")
    return op.detect_low_unique_numeric(
        labels.select("doc_id", "quality", "toxic", (F.col("quality") + F.col("toxic")).alias("marks"), (F.col("quality") * 3).alias("triple"))
    )


PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}


@S.add(
    "column_types",
    union_sql(
        [f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(DISTINCT {c}) AS \"unique\" FROM part" for c, t in PART.items()]
    ),
)
def column_types(spark, sf):
    return op.column_types(table(spark, sf, "part")).drop("position")


@S.add(
    "prepare_for_ml",
    f"WITH t AS ({derived_sql('readings', ['l_orderkey', 'qty_text', 'disc', 'empty_col'])}) "
    f"SELECT l_orderkey::DOUBLE AS l_orderkey, {number(clean('qty_text'))} AS qty_text, round(disc, 6) AS disc FROM t",
)
def prepare_for_ml(spark, sf):
    return op.prepare_for_ml(derived(spark, sf, "readings", ["l_orderkey", "qty_text", "disc", "empty_col"]))


LONG = "CAST(1234567890000000000 + l_orderkey AS STRING)"


@S.add("promote_numeric_long", f"SELECT {LONG.replace('STRING', 'BIGINT')} AS long_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS short_id FROM lineitem")
def promote_numeric_long(spark, sf):
    """Nineteen digits stay exact."""
    df = table(spark, sf, "lineitem").selectExpr(f"{LONG} AS long_id", "CAST(l_orderkey * 10 + l_linenumber AS STRING) AS short_id")
    return op.promote_numeric(df)[0]


QUERIES, SQL = S.queries, S.sql
