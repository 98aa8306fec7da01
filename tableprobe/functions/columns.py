"""Column references and type groups shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType)
TEXT = (T.StringType, T.CharType, T.VarcharType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col(quoted(name))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOATING)


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers only; booleans count as categories."""
    return isinstance(dtype, (*INTEGRAL, *FLOATING, T.DecimalType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEXT)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*TIMES, T.DateType))


def columns_of(df: DataFrame, predicate) -> list[str]:
    return [f.name for f in df.schema.fields if predicate(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, is_numeric)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, is_text)


def time_columns(df: DataFrame) -> list[str]:
    return columns_of(df, is_time)


def present(df: DataFrame, names: Iterable[str] | None) -> list[str]:
    """Keep the names the table really has, in the order given."""
    if names is None:
        return list(df.columns)
    have = set(df.columns)
    return [n for n in names if n in have]


def micros(c: Column, dtype: T.DataType | None = None) -> Column:
    """Microseconds since the epoch for any date or timestamp column."""
    return F.unix_micros(c.cast("timestamp"))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, zero when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def no_nan(c: Column) -> Column:
    """NaN and both infinities become null."""
    d = c.cast("double")
    bad = F.isnan(d) | d.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def as_number(c: Column, dtype: T.DataType) -> Column:
    """The column as a double, with NaN and infinities treated as missing."""
    return no_nan(c.cast("double")) if is_floating(dtype) else c.cast("double")


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN and infinities to null, zone-free timestamps to timestamps; a projection only."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if is_floating(f.dataType):
            c = no_nan(c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        out.append(c.alias(f.name, metadata=f.metadata or None))
    return df.select(*out)
