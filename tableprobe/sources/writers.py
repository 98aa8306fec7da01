"""Writing tables: CSV, JSON lines and Parquet, with an audit row."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tableprobe.functions.columns import col
from tableprobe.functions.frames import report_frame
from tableprobe.operators.typing import stringify_nested

# What users may call each format.
FORMATS = {"CSV (.csv)": "csv", "JSON (.json)": "json", "Parquet (.parquet)": "parquet"}
#: JSON times have milliseconds unless asked otherwise; CSV keeps all six digits.
JSON_TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSS"
CSV_TIMES = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 with a byte-order mark, so spreadsheet programs read it right.

    Every part file carries its own header, hence its own mark. Values are written as
    they are: blanks at their ends, line breaks (quoted) and microseconds stay. Times
    are those of the session zone.
    """
    flat, _ = stringify_nested(df)
    first, *rest = flat.columns
    marked = flat.select(col(first).alias("\ufeff" + first), *[col(c) for c in rest])
    options = {
        "header": True,
        "encoding": "UTF-8",
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "timestampFormat": CSV_TIMES,
        "timestampNTZFormat": CSV_TIMES,
    }
    marked.write.options(**options).csv(path)


def write_json(df: DataFrame, path: str, time_format: str = JSON_TIMES) -> None:
    """One record per line, nulls kept, ISO timestamps. ``time_format`` with six S keeps microseconds."""
    df.write.option("ignoreNullFields", False).option("timestampFormat", time_format).option("timestampNTZFormat", time_format).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "snappy").parquet(path)


def export_name(base: str | None, extension: str, now: datetime | None = None) -> str:
    """Letters, digits, dashes and underscores of ``base``, then the time: ``orders_20260102_030405.csv``."""
    words = re.findall(r"[A-Za-z0-9_-]+", base or "")
    stem = "_".join(words).strip("_")
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    kind = (extension or "csv").lower().removeprefix(".")
    return f"{stem or 'dataset'}_{stamp}.{kind}"


def export_table(df: DataFrame, folder: str, fmt: str = "csv", base: str = "dataset") -> DataFrame:
    """Write in the named format and return an audit row: format, name, bytes, rows, columns.

    Rows are counted while writing, so the table is computed once.
    """
    kind = FORMATS.get(fmt, (fmt or "").lstrip(".").lower())
    writers = {"csv": write_csv, "json": write_json, "parquet": write_parquet}
    if kind not in writers:
        raise ValueError(f"Unsupported export format {fmt!r}; use one of: {', '.join(writers)}.")
    name = export_name(base, kind)
    path = f"{folder.rstrip('/')}/{name}"
    seen = Observation("export")
    writers[kind](df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    size = df.sparkSession.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return report_frame(
        df.sparkSession,
        [(kind, name, int(size), int(seen.get["rows"]), len(df.columns))],
        "format string, name string, bytes bigint, rows bigint, columns bigint",
    )
