"""Column names, placeholder text and type promotion.

Types are decided by majority vote. All votes of a table come from one aggregate,
after which every change is a single projection, so cleaning a table costs one
scan to look and one scan when the result is used.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from itertools import chain, count
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import (
    NESTED,
    as_number,
    col,
    columns_of,
    is_floating,
    is_integral,
    is_numeric,
    is_text,
    is_time,
    no_nan,
    numeric_columns,
    percent,
    text_columns,
    time_columns,
)
from tableprobe.functions.dates import DATE_HINT, infer_timestamp
from tableprobe.functions.frames import per_column, report_frame
from tableprobe.functions.text import (
    DIGITS,
    FALSE_WORDS,
    NUMERIC_NULL_TOKENS,
    PLACEHOLDER_TOKENS,
    TRUE_WORDS,
    clean_text,
    is_token,
    parse_boolean,
    parse_number,
    strip,
    whole_number,
)
from tableprobe.plans.frequency import distinct_counts, number_counts
from tableprobe.plans.ordered import size_bound
from tableprobe.plans.smallest import smallest_values

NUMERIC_SHARE = 0.70
DATE_SHARE = 0.85
DATE_HINT_SHARE = 0.70
FEW_VALUES = 50
MANY_ROWS = 1000
LOW_RATIO = 0.5
STATUS_CODE_SETS = ((0, 1), (1, 2), (-1, 0, 1), (0, 1, 2))  # fixed values


# --------------------------------------------------------------------- names


def unique_names(names: Sequence[str], start: int = 1) -> list[str]:
    """Names from left to right; one that is taken already gets the smallest number from ``start`` on that makes it free."""
    taken: dict[str, None] = {}
    for name in names:
        forms = chain([name], (f"{name}_{n}" for n in count(start)))
        taken[next(form for form in forms if form not in taken)] = None
    return list(taken)


def clean_names(names: Sequence[str]) -> tuple[list[str], dict[str, str], list[str]]:
    """Normalize names and make them unique; also report renames and numbered repeats."""
    tidy = [" ".join(unicodedata.normalize("NFKC", str(n)).split()) or "unnamed_column" for n in names]
    final = unique_names(tidy, start=2)
    renamed = {str(a): b for a, b in zip(names, tidy) if str(a) != b}
    return final, renamed, [b for a, b in zip(tidy, final) if a != b]


def clean_column_names(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    names, renamed, numbered = clean_names(df.columns)
    return (df if names == df.columns else df.toDF(*names)), renamed, numbered


# -------------------------------------------------------------- projections


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Swap some columns in place, keeping order."""
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns]) if new else df


def sanitize_tokens(
    df: DataFrame, columns: Iterable[str] | None = None, tokens: Iterable[str] = PLACEHOLDER_TOKENS
) -> DataFrame:
    """Trim text and turn placeholder words into null. A projection, also for streams."""
    text = set(text_columns(df))
    return _clean(df, [c for c in (columns or text_columns(df)) if c in text], tuple(tokens))


def _clean(df: DataFrame, names: Sequence[str], tokens: tuple[str, ...]) -> DataFrame:
    """Trim in one projection and compare in the next, so that trimming happens once."""
    trimmed = _replace(df, {c: strip(col(c)) for c in names})
    return _replace(trimmed, {c: F.when(~F.coalesce(F.lower(col(c)).isin(*tokens), F.lit(False)), col(c)) for c in names})


def token_counts(df: DataFrame, tokens: Iterable[str] = PLACEHOLDER_TOKENS) -> DataFrame:
    """(column, replaced) for every text column that holds placeholders."""
    tokens = tuple(tokens)
    names = text_columns(df)
    if not names:
        return report_frame(df.sparkSession, [], "column string, replaced bigint")
    counts = per_column(df, {c: is_token(col(c), tokens) for c in names}, {"replaced": F.count_if("value")})
    return counts.where("replaced > 0").select("column", "replaced")


def replace_infinities(df: DataFrame) -> DataFrame:
    """Infinities and NaN in floating columns become null. A projection, also for streams."""
    return _replace(df, {c: no_nan(col(c)) for c in columns_of(df, is_floating)})


def infinity_count(df: DataFrame) -> DataFrame:
    """One row: how many infinite cells the floating columns hold."""
    hits = [F.count_if(F.abs(col(c)) == F.lit(float("inf"))) for c in columns_of(df, is_floating)]
    total = hits[0] if hits else F.lit(0).cast("bigint")
    for h in hits[1:]:
        total = total + h
    return df.agg(total.alias("infinities"))


def stringify_nested(df: DataFrame) -> tuple[DataFrame, list[dict[str, str]]]:
    """Arrays, maps and structs become JSON text, binary becomes base64 text."""
    new, log = {}, []
    for f in df.schema.fields:
        if isinstance(f.dataType, NESTED):
            new[f.name] = F.to_json(col(f.name))
        elif isinstance(f.dataType, T.BinaryType):
            new[f.name] = F.base64(col(f.name))
        elif not (is_numeric(f.dataType) or is_text(f.dataType) or is_time(f.dataType) or isinstance(f.dataType, (T.BooleanType, T.NullType))):
            new[f.name] = col(f.name).cast("string")
        else:
            continue
        log.append({"column": f.name, "reason": f"{f.dataType.typeName()}_to_text"})
    return _replace(df, new), log


# ------------------------------------------------------------------- voting


def _votes(
    df: DataFrame,
    names: Sequence[str],
    tokens: tuple[str, ...],
    dates: bool = True,
    numeric_threshold: float | None = None,
) -> dict[str, dict[str, int]]:
    """What is needed to decide the type of each text column.

    One pass counts the cheap evidence for all columns. Only columns that mostly look
    like dates, and are not numbers already, are then read again to parse dates.
    """
    if not names:
        return {}
    df = df.select(*[col(n) for n in names])
    text, number = F.col("text"), F.col("number")
    # One bit per known word; the bits set in the end are the different words seen.
    known = F.array_position(F.array(*[F.lit(w) for w in (*TRUE_WORDS, *FALSE_WORDS)]), F.lower(text))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("known").cast("int")))
    steps = _text_steps(tokens) + [{"number": parse_number(text), "known": F.when(F.length(text) <= 5, known)}]
    aggregates = {
        "rows": F.count(F.lit(1)),
        "non_null": F.count(text),
        "tokens": F.count_if("token"),
        "numbers": F.count(number),
        "whole": F.count_if(whole_number(text).isNotNull()),
        "digits": F.count_if(text.rlike(DIGITS)),
        "hints": F.count_if(text.rlike(DATE_HINT)),
        "booleans": F.count_if(F.col("known") > 0),
        "words": F.bit_count(F.call_function("shiftright", F.coalesce(bits, F.lit(0)), F.lit(1))),
        "infinite": F.count_if(F.abs(number) == F.lit(float("inf"))),
    }
    out = {r["column"]: r.asDict() for r in per_column(df, {n: strip(col(n)) for n in names}, aggregates, steps).collect()}
    numeric = {n for n, v in out.items() if numeric_threshold is not None and _is_number(v, numeric_threshold)}
    likely = [n for n, v in out.items() if dates and n not in numeric and _hinted(v)]
    for v in out.values():
        v["dates"] = 0
    if likely:
        parsed = {"dates": F.count(infer_timestamp(text))}
        for r in per_column(df, {n: strip(col(n)) for n in likely}, parsed, _text_steps(tokens)).collect():
            out[r["column"]]["dates"] = r["dates"]
    return out


def _text_steps(tokens: tuple[str, ...]) -> list[dict[str, Column]]:
    """From a trimmed value: whether it is a placeholder, and the text that is left."""
    token = F.coalesce(F.lower("value").isin(*tokens), F.lit(False)) if tokens else F.lit(False)
    return [{"token": token}, {"text": F.when(~F.col("token"), F.col("value"))}]


def _hinted(v: dict[str, int]) -> bool:
    return v["non_null"] > 0 and v["hints"] / v["non_null"] >= DATE_HINT_SHARE


def _is_number(v: dict[str, int], threshold: float) -> bool:
    return v["non_null"] > 0 and v["numbers"] / v["non_null"] >= threshold


def _is_date(v: dict[str, int], threshold: float) -> bool:
    n = v["non_null"]
    return (
        _hinted(v)
        and v["dates"] / n >= threshold
        and v["dates"] / v["rows"] >= threshold
    )


def _is_boolean(v: dict[str, int]) -> bool:
    return v["non_null"] > 0 and v["booleans"] == v["non_null"] and v["words"] >= 2


def _number_column(text: Column, v: dict[str, int]) -> Column:
    """Whole numbers if all are and fit 64 bits; as decimals if they are longer; else doubles."""
    if v["whole"] == v["numbers"]:
        return whole_number(text)
    if v["digits"] == v["numbers"]:
        long = F.when(text.rlike(DIGITS), text.try_cast("decimal(38,0)"))
        return long
    return no_nan(parse_number(text))


def promote_numeric(df: DataFrame, threshold: float = NUMERIC_SHARE) -> tuple[DataFrame, list[dict[str, Any]]]:
    """Text columns whose non-null values are mostly numbers become numbers."""
    votes = _votes(df, text_columns(df), (), dates=False)
    new, log = {}, []
    for name, v in votes.items():
        if _is_number(v, threshold):
            new[name] = _number_column(strip(col(name)), v)
            log.append(_numeric_log(name, v))
    return _replace(df, new), log


def _numeric_log(name: str, v: dict[str, int]) -> dict[str, Any]:
    return {
        "column": name,
        "valid": v["numbers"],
        "invalid": v["non_null"] - v["numbers"],
        "valid_pct": round(v["numbers"] / v["non_null"] * 100, 2),
    }


def promote_datetime(
    df: DataFrame, threshold: float = DATE_SHARE, dayfirst: bool = False
) -> tuple[DataFrame, list[dict[str, Any]]]:
    """Text columns that mostly hold dates become timestamps; every row votes."""
    votes = _votes(df, text_columns(df), ())
    new, log = {}, []
    for name, v in votes.items():
        if _is_date(v, threshold):
            new[name] = infer_timestamp(strip(col(name)), dayfirst)
            log.append({"column": name, "valid_pct": round(v["dates"] / v["rows"] * 100, 2)})
    return _replace(df, new), log


def promote_boolean(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Text columns of yes/no words only, with at least two different words, become booleans."""
    votes = _votes(df, text_columns(df), (), dates=False)
    names = [n for n, v in votes.items() if _is_boolean(v)]
    return _replace(df, {n: parse_boolean(col(n)) for n in names}), names


# ----------------------------------------------------------------- categories


def _low_cardinality(distinct: int, rows: int) -> bool:
    return distinct >= 1 and ((rows >= MANY_ROWS and distinct / rows <= LOW_RATIO) or distinct <= FEW_VALUES)


def text_cardinality(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Distinct values per text column, exact at every size: one shuffle of different values, long ones as digests."""
    names = list(columns if columns is not None else text_columns(df))
    if not names:
        return {}
    return dict.fromkeys(names, 0) | {r["column"]: r["unique"] for r in distinct_counts(df, names).collect()}


def tag_categoricals(df: DataFrame) -> tuple[DataFrame, list[dict[str, Any]]]:
    """Mark text columns with few distinct values as categories, in column metadata."""
    rows = size_bound(df)
    distinct = text_cardinality(df)
    hits = {c: d for c, d in distinct.items() if _low_cardinality(d, rows)}
    return _tag(df, hits), [{"column": c, "unique": d} for c, d in hits.items()]


def _tag(df: DataFrame, names: Iterable[str]) -> DataFrame:
    names = set(names)
    return df.select(
        *[
            col(f.name).alias(f.name, metadata={**(f.metadata or {}), "logical": "categorical"}) if f.name in names else col(f.name)
            for f in df.schema.fields
        ]
    )


def split_columns(df: DataFrame) -> dict[str, list[str]]:
    """Column names by profiling group; text with many distinct values is in none."""
    tagged = [f.name for f in df.schema.fields if (f.metadata or {}).get("logical") == "categorical"]
    open_text = [c for c in text_columns(df) if c not in tagged]
    if open_text:
        rows = size_bound(df)
        tagged += [c for c, d in text_cardinality(df, open_text).items() if _low_cardinality(d, rows)]
    flags = columns_of(df, lambda t: isinstance(t, T.BooleanType))
    categorical = [c for c in df.columns if c in set(tagged) | set(flags)]
    return {"numeric": numeric_columns(df), "categorical": categorical, "datetime": time_columns(df)}


def logical_types(df: DataFrame) -> DataFrame:
    """(column, logical_type): empty, boolean, datetime, numeric, categorical, string or mixed.

    A Spark column has one type, so "mixed" never occurs.
    """
    categorical = set(split_columns(df)["categorical"])

    def kind(f: T.StructField) -> str:
        if isinstance(f.dataType, T.BooleanType):
            return "boolean"
        if is_time(f.dataType):
            return "datetime"
        if is_numeric(f.dataType):
            return "numeric"
        return "categorical" if f.name in categorical else "string"

    filled = per_column(df, {c: col(c).isNotNull() for c in df.columns}, {"filled": F.count_if("value")})
    named = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(kind(f)))])
    return filled.select(
        "column",
        F.when(F.col("filled") == 0, F.lit("empty")).otherwise(named[F.col("column")]).alias("logical_type"),
    )


# ------------------------------------------------------------------- pipeline


def sanitize(
    df: DataFrame,
    tokens: Iterable[str] = PLACEHOLDER_TOKENS,
    numeric_threshold: float = NUMERIC_SHARE,
    date_threshold: float = DATE_SHARE,
    dayfirst: bool = False,
) -> tuple[DataFrame, dict[str, Any]]:
    """Names, placeholders, numbers, dates, booleans, infinities, categories, nested values.

    Returns the cleaned table, which is one projection of the input, and a report.
    """
    tokens = tuple(tokens)
    named, renamed, numbered = clean_column_names(df)
    flat, nested_log = stringify_nested(named)
    report: dict[str, Any] = {
        "input_cols": len(df.columns),
        "output_cols": len(flat.columns),
        "renamed_columns": renamed,
        "numbered_columns": numbered,
        "nested_columns": nested_log,
        "warnings": [],
    }
    nested = {e["column"] for e in nested_log}
    names = [c for c in text_columns(flat) if c not in nested]
    votes = _votes(flat, names, tokens, numeric_threshold=numeric_threshold)
    floats = columns_of(flat, is_floating)
    if votes:
        rows = next(iter(votes.values()))["rows"]
        infinite = flat.agg(*[F.count_if(F.abs(col(c)) == F.lit(float("inf"))).alias(f"i{i}") for i, c in enumerate(floats)]).first() if floats else ()
    else:
        got = flat.agg(
            F.count(F.lit(1)),
            *[F.count_if(F.abs(col(c)) == F.lit(float("inf"))).alias(f"i{i}") for i, c in enumerate(floats)],
        ).first()
        rows, infinite = got[0], got[1:]
    if rows == 0:
        report["warnings"].append("The table has no rows.")
    new: dict[str, Column] = {}
    numbers, dates, booleans, kept_text = [], [], [], []
    for name, v in votes.items():
        text = col(name)
        if _is_number(v, numeric_threshold):
            new[name] = _number_column(text, v)
            numbers.append(_numeric_log(name, v))
        elif _is_date(v, date_threshold):
            new[name] = infer_timestamp(text, dayfirst)
            dates.append({"column": name, "valid_pct": round(v["dates"] / v["rows"] * 100, 2)})
        elif _is_boolean(v):
            new[name] = parse_boolean(text)
            booleans.append(name)
        else:
            kept_text.append(name)
    for c in floats:
        new[c] = no_nan(col(c))
    for f in flat.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            new[f.name] = col(f.name).cast("timestamp")
    clean = _replace(_clean(flat, names, tokens), new)
    distinct = text_cardinality(clean, kept_text)
    categories = {c: d for c, d in distinct.items() if _low_cardinality(d, rows)}
    clean = _tag(clean, categories)
    replaced = {n: v["tokens"] for n, v in votes.items() if v["tokens"]}
    emptied = {n for n, v in votes.items() if v["non_null"] == 0}
    report.update(
        input_rows=rows,
        output_rows=rows,
        tokens_replaced=replaced,
        tokens_replaced_total=sum(replaced.values()),
        numeric_conversions=numbers,
        datetime_conversions=dates,
        boolean_conversions=booleans,
        infinities_replaced=sum(infinite)
        + sum(v["infinite"] for n, v in votes.items() if any(e["column"] == n for e in numbers)),
        categories=[{"column": c, "unique": d} for c, d in categories.items()],
        detected_types=_detected(clean, categories, emptied),
    )
    return clean, report


def _detected(df: DataFrame, categories: dict[str, int], emptied: set[str]) -> dict[str, str]:
    out = {}
    for f in df.schema.fields:
        if f.name in emptied:
            out[f.name] = "empty"
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = "boolean"
        elif is_time(f.dataType):
            out[f.name] = "datetime"
        elif is_numeric(f.dataType):
            out[f.name] = "numeric"
        else:
            out[f.name] = "categorical" if f.name in categories else "string"
    return out


# -------------------------------------------------------------------- reports


def numeric_convertibility(df: DataFrame, threshold: float = NUMERIC_SHARE, examples: int = 5) -> DataFrame:
    """Per text column: how much of it reads as numbers, and what does not.

    Examples are the smallest distinct rejected texts, since rows have no order.
    """
    names = text_columns(df)
    if not names:
        return report_frame(
            df.sparkSession,
            [],
            "column string, non_null bigint, valid bigint, invalid bigint, valid_pct double,"
            " invalid_pct double, convertible boolean, invalid_examples array<string>",
        )
    text = {c: clean_text(col(c), NUMERIC_NULL_TOKENS) for c in names}
    counts = per_column(df, text, {"non_null": F.count("value"), "valid": F.count(parse_number(F.col("value")))})
    ids = {f"c{i}": c for i, c in enumerate(names)}
    labels = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    rejected = (
        df.select(*[F.when(text[c].isNotNull() & parse_number(text[c]).isNull(), col(c)).alias(i) for i, c in ids.items()])
        .unpivot([], list(ids), "column", "value")
        .where("value is not null")
        .withColumn("column", labels[F.col("column")])
    )
    shown = smallest_values(rejected, examples).withColumnRenamed("values", "invalid_examples")
    invalid = F.col("non_null") - F.col("valid")
    return counts.join(shown, "column", "left").select(
        "column",
        "non_null",
        "valid",
        invalid.alias("invalid"),
        percent(F.col("valid"), F.col("non_null")).alias("valid_pct"),
        percent(invalid, F.col("non_null")).alias("invalid_pct"),
        ((F.col("non_null") > 0) & (F.col("valid") >= F.lit(threshold) * F.col("non_null"))).alias("convertible"),
        F.coalesce("invalid_examples", F.array().cast("array<string>")).alias("invalid_examples"),
    )


def smart_convert(df: DataFrame, threshold: float = NUMERIC_SHARE) -> tuple[DataFrame, list[dict[str, Any]], bool]:
    """Apply the conversions found above; also the report and whether values were lost."""
    report = [r.asDict() for r in numeric_convertibility(df, threshold).collect()]
    chosen = [r["column"] for r in report if r["convertible"]]
    out = _replace(df, {c: parse_number(clean_text(col(c), NUMERIC_NULL_TOKENS)) for c in chosen})
    return out, report, any(r["convertible"] and r["invalid"] > 0 for r in report)


def detect_low_unique_numeric(df: DataFrame, max_unique: int = 10, max_ratio: float = 0.01) -> DataFrame:
    """Numeric columns that behave like codes, with their most frequent values."""
    names = numeric_columns(df)
    counts = number_counts(df, names)
    rows = size_bound(df)
    v = F.col("value")
    shape = counts.groupBy("column").agg(
        F.count_distinct(v).alias("unique"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.bool_and(v == F.floor(v)).alias("whole"),
    )
    boolean_like = F.lit(False)
    for codes in STATUS_CODE_SETS:
        # Distinct whole numbers spanning exactly this range are exactly this set.
        same = (F.col("unique") == len(codes)) & (F.col("lo") == min(codes)) & (F.col("hi") == max(codes))
        boolean_like = boolean_like | (same & F.col("whole"))
    few = (F.col("unique") <= max_unique) & (F.col("unique") <= F.lit(max_ratio * rows))
    hits = shape.where(F.col("unique") >= 2).withColumn("boolean_like", boolean_like).where(few | F.col("boolean_like"))
    place = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = (
        counts.withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= 6)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("top"))
    )
    return hits.join(top, "column").select(
        "column",
        "unique",
        (F.col("unique") / F.lit(float(max(rows, 1)))).alias("unique_ratio"),
        "boolean_like",
        F.col("top.value").alias("examples"),
    )


def column_types(df: DataFrame, approx: bool = False) -> DataFrame:
    """(position, column, type, non_null, unique) for every column."""
    flat, _ = stringify_nested(df)
    filled = per_column(flat, {c: _present(flat, c).isNotNull() for c in flat.columns}, {"non_null": F.count_if("value")})
    unique = distinct_counts(flat, flat.columns, approx)
    types = F.create_map(*[x for n, t in df.dtypes for x in (F.lit(n), F.lit(t))])
    # One row per column on both sides.
    return filled.join(F.broadcast(unique), "column", "left").select(
        "position",
        "column",
        types[F.col("column")].alias("type"),
        "non_null",
        F.coalesce("unique", F.lit(0)).alias("unique"),
    )


def _present(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    return as_number(col(name), dtype) if is_floating(dtype) else col(name)


def prepare_for_ml(df: DataFrame) -> DataFrame:
    """Sanitize, leave out columns without any value, whole numbers to double."""
    clean, report = sanitize(df)
    if report["input_rows"] == 0:
        return clean
    got = clean.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(clean.columns)]).first()
    keep = [f for i, f in enumerate(clean.schema.fields) if got[f"n{i}"] > 0]
    return clean.select(
        *[col(f.name).cast("double").alias(f.name) if is_integral(f.dataType) else col(f.name) for f in keep]
    )
