"""Loading files: CSV, JSON and Parquet, one or many."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import col, is_text
from tableprobe.functions.frames import report_frame
from tableprobe.functions.text import strip
from tableprobe.operators.findings import merge_findings, sanitize_findings
from tableprobe.operators.merge import compare_schemas, merge_tables
from tableprobe.operators.typing import sanitize, unique_names

SUPPORTED = ("csv", "json", "jsonl", "parquet", "pq")
ORDER = "__order"


def file_order() -> Column:
    """Where a row stood in its source: file, block, position. Sorts like the input."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )


def _paths(path: str | Sequence[str]) -> str | list[str]:
    return path if isinstance(path, str) else list(path)


def breaks_inside_quotes(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> bool:
    """Whether a record may span lines: a line with an odd number of quotes opens or closes one.

    Looks until it finds one. Files in wide encodings cannot be looked at as lines.
    """
    if encoding.upper().replace("-", "").startswith(("UTF16", "UTF32")):
        return True
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(_paths(path)).where(quotes % 2 == 1).limit(1).count())


#: Column that holds a line which does not fit its file, and what readers may do with such lines.
MALFORMED = "__malformed"
MALFORMED_MODES = ("fail", "mark")


def _marked(df: DataFrame, mode: str) -> DataFrame:
    """The marked lines as an ordinary column: Spark refuses to read them without any other one."""
    if mode != "mark":
        return df
    other = next(c for c in df.columns if c != MALFORMED)
    always = F.length(F.substring(F.coalesce(col(other).cast("string"), F.lit("")), 1, 0)) >= 0
    return df.withColumn(MALFORMED, F.when(always, col(MALFORMED)))


def _check_mode(mode: str) -> None:
    if mode not in MALFORMED_MODES:
        raise ValueError(f"Unknown way to treat malformed lines {mode!r}; use one of: {', '.join(MALFORMED_MODES)}.")


def _widest(spark: SparkSession, path: str | Sequence[str], delimiter: str) -> int:
    """Fields of the line with the most delimiters; quoted ones count too, so it may be too many."""
    line = F.col("value")
    marks = F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))
    return (spark.read.text(_paths(path)).agg(F.max(marks)).first()[0] or 0) // len(delimiter) + 1


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    header: bool = True,
    encoding: str = "UTF-8",
    delimiter: str = ",",
    multiline: bool | None = None,
    with_order: bool = False,
    malformed: str = "fail",
) -> DataFrame:
    """Every column as text; types are decided later by looking at all values.

    ``multiline=None`` looks whether quoted values hold line breaks. Only then are
    files read whole; all others are split across tasks.

    Lines with more or fewer fields than the header are never cut: with ``fail`` reading
    them is an error, with ``mark`` they stand whole in the column ``__malformed``, which is
    null for all others. Without a header the widest line decides; shorter ones end in nulls.
    """
    _check_mode(malformed)
    if multiline is None:
        multiline = breaks_inside_quotes(spark, path, encoding)
    reader = (
        spark.read.option("header", header)
        .option("encoding", encoding)
        .option("sep", delimiter)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
    )
    if header:
        names = reader.csv(_paths(path)).columns
        mode = "FAILFAST" if malformed == "fail" else "PERMISSIVE"
    else:
        names, mode = [f"_c{i}" for i in range(_widest(spark, path, delimiter))], "PERMISSIVE"
    marks = malformed == "mark" and header
    fields = [T.StructField(n, T.StringType()) for n in (*names, *([MALFORMED] if marks else []))]
    # a reader that skips fields it does not need would not notice that some are missing
    reader = reader.schema(T.StructType(fields)).option("mode", mode).option("columnPruning", False).option("columnNameOfCorruptRecord", MALFORMED)
    df = reader.csv(_paths(path))
    if not header:
        df = _without_empty_end(df)
        df = df.withColumn(MALFORMED, F.lit(None).cast("string")) if malformed == "mark" else df
    # A byte-order mark belongs to the file, not to the first name.
    clean = [c.lstrip("\ufeff") for c in df.columns]
    df = df if clean == df.columns else df.toDF(*clean)
    df = _marked(df, malformed) if marks else df
    return df.withColumn(ORDER, file_order()) if with_order else df


def _without_empty_end(df: DataFrame) -> DataFrame:
    """Leave out the last columns as far as they hold nothing."""
    filled = df.agg(*[F.count(col(c)).alias(c) for c in df.columns]).first()
    used = max([i + 1 for i, c in enumerate(df.columns) if filled[c]], default=1)
    return df.select(*[col(c) for c in df.columns[:used]])


def malformed_lines(df: DataFrame) -> DataFrame:
    """(file, line) of all lines that did not fit, from a table read with ``malformed="mark"``."""
    return df.where(col(MALFORMED).isNotNull()).select(F.col("_metadata.file_name").alias("file"), col(MALFORMED).alias("line"))


def whole_rows(df: DataFrame) -> DataFrame:
    """The rows that did fit, without the mark."""
    return df.where(col(MALFORMED).isNull()).drop(MALFORMED)


def json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the files hold one record per line, judged by the first line of each that is not blank.

    A line that is a whole record says so; an array, or a record that goes on, is for
    the whole-file reader. A mixture cannot be read in one go and is an error.
    """
    text = F.btrim("value", F.lit(" \t\r\ufeff"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("line"))
    first = lines.where("line <> ''").withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("line", F.struct("block", "at")).alias("line"))
    whole = ~F.startswith("line", F.lit("[")) & F.try_parse_json("line").isNotNull()
    kinds = [r["whole"] for r in first.select(whole.alias("whole")).distinct().collect()]  # two rows at most
    if len(kinds) > 1:
        raise ValueError(f"{path}: some files hold one record per line and some an array; read them apart.")
    return bool(kinds and kinds[0])


def read_json(
    spark: SparkSession, path: str, lines: bool | None = None, with_order: bool = False, malformed: str = "fail"
) -> DataFrame:
    """One record per line, which splits across tasks, or an array of records; ``lines=None`` looks which it is.

    Broken lines are an error with ``fail``; with ``mark`` they stand in ``__malformed``, as for CSV.
    """
    _check_mode(malformed)
    if lines is None:
        lines = json_lines(spark, path)
    reader = spark.read.option("multiLine", not lines)
    # the columns are those of the records that can be read
    fields = reader.option("mode", "DROPMALFORMED").json(path).schema.fields
    if not fields:
        raise ValueError(f"{path}: no line is a JSON record.")
    if malformed == "mark":
        schema = T.StructType([*fields, T.StructField(MALFORMED, T.StringType())])
        df = _marked(reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).json(path), malformed)
    else:
        df = reader.schema(T.StructType(fields)).option("mode", "FAILFAST").json(path)
    return df.withColumn(ORDER, file_order()) if with_order else df


def read_parquet(spark: SparkSession, path: str, with_order: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn(ORDER, file_order()) if with_order else df


def extension_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_table(spark: SparkSession, path: str, with_order: bool = False, lines: bool | None = None, malformed: str = "fail", **options) -> DataFrame:
    """Read by extension, without cleaning. ``lines`` is for JSON, the other options for CSV."""
    kind = extension_of(path)
    if kind == "csv":
        return read_csv(spark, path, with_order=with_order, malformed=malformed, **options)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, lines=True if kind == "jsonl" else lines, with_order=with_order, malformed=malformed)
    if kind in ("parquet", "pq"):
        return read_parquet(spark, path, with_order=with_order)
    raise ValueError(f"Unsupported file type {kind!r}; use one of: {', '.join(SUPPORTED)}.")


def load_table(spark: SparkSession, path: str, **options) -> tuple[DataFrame, dict[str, Any]]:
    """Read by extension, then clean: (table, report).

    CSV lines with too many or too few fields and broken JSON lines are kept aside:
    ``malformed`` in the report lists them as (file, line), ``malformed_per_file`` counts
    them for every file. Both are DataFrames that cost nothing until they are used.
    """
    if extension_of(path) in ("parquet", "pq"):
        df, report = sanitize(read_table(spark, path, **options))
        none = report_frame(spark, [], "file string, line string")
        return df, {**report, "malformed": none, "malformed_per_file": report_frame(spark, [], "file string, rows bigint, malformed bigint")}
    marked = read_table(spark, path, malformed="mark", **options)
    per_file = marked.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.count(col(MALFORMED)).alias("malformed"))
    df, report = sanitize(whole_rows(marked))
    return df, {**report, "malformed": malformed_lines(marked), "malformed_per_file": per_file}


def header_names(values: Sequence[str | None]) -> list[str]:
    """Column names from a row of values: trimmed, blank ones named by their place, all different."""
    return unique_names([str("" if v is None else v).strip() or f"Unnamed_{place}" for place, v in enumerate(values)])


def apply_header_overrides(
    df: DataFrame, drop_first: int = 0, promote: bool = False, order: str = ORDER
) -> tuple[DataFrame, dict[str, Any]]:
    """Drop leading rows, optionally take names from the next one, then clean again.

    Needs the order column the readers attach on request. Only the few leading rows
    are looked at; the rest is a filter on the order.
    """
    data = [c for c in df.columns if c != order]
    lead = max(0, drop_first)
    names, skip = data, lead
    head = df.orderBy(col(order)).limit(lead + (1 if promote else 0)).collect() if lead or promote else []
    if promote and len(head) > lead:
        names, skip = header_names([head[lead][c] for c in data]), lead + 1
    body = df
    if skip:
        if len(head) < skip or not head:
            body = df.where(F.lit(False))
        else:
            edge = head[skip - 1][order]
            limit = F.struct(*[F.lit(edge[f.name]).cast(f.dataType).alias(f.name) for f in df.schema[order].dataType.fields])
            body = df.where(col(order) > limit)
    body = body.select(*[col(c) for c in data]).toDF(*names)
    if not lead and not promote:
        return body, {}
    blank = [F.when(strip(col(c)) != "", col(c)).alias(c) if is_text(body.schema[c].dataType) else col(c) for c in body.columns] if len(set(names)) == len(names) else None
    return sanitize(body.select(*blank) if blank else body)


def load_many(spark: SparkSession, paths: Sequence[str], **options) -> tuple[DataFrame | None, dict[str, Any]]:
    """Load each file, skip what fails or is empty, merge the rest.

    The report holds ``files`` (one row per path with status, lines that did not fit and
    error), ``malformed`` with these lines, the schema comparison, and the messages. Each file is parsed once here so that a broken
    one is reported under its own name.
    """
    tables: dict[str, DataFrame] = {}
    rows, aside, messages = [], [], []
    for path in paths:
        label = path.rstrip("/").rsplit("/", 1)[-1]
        if label in tables:
            label = path
        try:
            df, report = load_table(spark, path, **options)
            n = report["input_rows"]
            bad = report["malformed"].count()
            if n == 0:
                rows.append((label, "empty", 0, len(df.columns), bad, "The file has no rows that fit its header." if bad else "The file has no rows."))
                continue
            tables[label] = df
            aside.append(report["malformed"].withColumn("source", F.lit(label)))
            rows.append((label, "ok", n, len(df.columns), bad, None))
            messages += [f"{label}: {bad} lines do not fit and were kept aside."] if bad else []
            messages += [f"{label}: {m}" for m in sanitize_findings(report)]
        except Exception as error:  # a broken file must not stop the others
            rows.append((label, "failed", 0, 0, 0, str(error).splitlines()[0][:500]))
    files = report_frame(spark, rows, "file string, status string, rows bigint, cols bigint, malformed bigint, error string")
    kept = reduce(DataFrame.unionByName, aside) if aside else report_frame(spark, [], "file string, line string, source string")
    if not tables:
        return None, {"files": files, "malformed": kept, "messages": messages + ["No file could be loaded."]}
    schemas = compare_schemas(spark, tables)
    merged, merge_report = merge_tables(tables)
    return merged, {"files": files, "malformed": kept, "schemas": schemas, **merge_report, "messages": messages + merge_findings(schemas, merge_report)}
