"""Date patterns and guarded timestamp parsing.

A named format is paired with the shape its text must have. Testing the shape
first keeps the parser away from text it would reject: a rejected parse builds
an exception, which is far dearer than a failed match.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableprobe.functions.dateforms import timestamp_by_shape
from tableprobe.functions.text import DATE_NULL_TOKENS, clean_text

# The format presets offered to users, in builder notation, in order.
FORMAT_PRESETS = (
    "YYYY-MM-DD HH:mm:ss",
    "YYYY-MM-DD HH:mm:ss.ms",
    "DD-MM-YYYY HH:mm:ss",
    "DD-MM-YYYY HH.mm.ss",
    "DD-MM-YYYY HH:mm:ss.ms",
    "DD/MM/YYYY HH:mm:ss",
    "YYYY/MM/DD HH-mm-ss",
    "YYYY/MM/DD HH:mm:ss",
    "MM/DD/YYYY HH:mm:ss",
    "YYYY-MM-DDTHH:mm:ss",
    "YYYY-MM-DD",
    "DD-MM-YYYY",
    "DD/MM/YYYY",
    "MM/DD/YYYY",
    "HH:mm:ss",
    "HH:mm:ss.ms",
    "YYYYMMDDHHmmss",
    "YYYYMMDDHHmm",
    "YYYYMMDD",
)

# What makes text look like a date.
DATE_HINT = r"(?i)([-/:.]|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b|\d{4})"

# Numeric encodings of time as (name, lowest, highest plausible value).
NUMERIC_TIME_RANGES = (
    ("excel_serial", 10_000.0, 80_000.0),
    ("unix_s", 946_684_800.0, 4_102_444_800.0),
    ("unix_ms", 946_684_800_000.0, 4_102_444_800_000.0),
)
EXCEL_EPOCH_MICROS = -2_209_161_600_000_000  # 1899-12-30

# Token -> (field letter, digits when fields touch, shape when apart, shape when touching).
_TOKENS = {
    "YYYY": ("y", 4, r"\d{4}", r"\d{4}"),
    "YY": ("y", 2, r"\d{2}", r"\d{2}"),
    "MM": ("M", 2, r"\d{1,2}", r"\d{2}"),
    "DD": ("d", 2, r"\d{1,2}", r"\d{2}"),
    "HH": ("H", 2, r"\d{1,2}", r"\d{2}"),
    "hh": ("H", 2, r"\d{1,2}", r"\d{2}"),
    "mm": ("m", 2, r"\d{1,2}", r"\d{2}"),
    "ss": ("s", 2, r"\d{1,2}", r"\d{2}"),
    "ms": ("S", 6, r"\d{1,6}", r"\d{1,6}"),
}
_FRACTION = "[SSSSSS][SSSSS][SSSS][SSS][SS][S]"
_SPLIT = re.compile("(" + "|".join(sorted(_TOKENS, key=len, reverse=True)) + ")")


def _pieces(fmt: str) -> list[tuple[str, bool, bool]]:
    """Split a builder format into (text, is_field, touches_another_field)."""
    parts = [p for p in _SPLIT.split(fmt or "") if p]
    fields = [p in _TOKENS for p in parts]
    touching = [
        fields[i] and ((i > 0 and fields[i - 1]) or (i + 1 < len(parts) and fields[i + 1]))
        for i in range(len(parts))
    ]
    return list(zip(parts, fields, touching))


def builder_to_pattern(fmt: str) -> str:
    """Translate a builder format such as ``YYYY-MM-DD HH:mm`` to a Spark pattern."""
    out = []
    for text, is_field, touching in _pieces(fmt):
        if not is_field:
            out.append("".join(f"'{ch}'" if ch.isalpha() or ch in "[]{}#'" else ch for ch in text).replace("'''", "''"))
            continue
        letter, width, _, _ = _TOKENS[text]
        if letter == "S":
            out.append(_FRACTION)
        elif letter == "y" or touching:
            out.append(letter * width)
        else:
            out.append(letter)
    return "".join(out)


def format_shape(fmt: str) -> str:
    """The anchored regular expression every text in this format matches."""
    out = []
    for text, is_field, touching in _pieces(fmt):
        if is_field:
            out.append(_TOKENS[text][3] if touching else _TOKENS[text][2])
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", text))
    return "^" + "".join(out) + "$"


def parse_format(c: Column, fmt: str) -> Column:
    """Text in one builder format to a timestamp; null when it does not fit."""
    return F.when(c.rlike(format_shape(fmt)), F.try_to_timestamp(c, F.lit(builder_to_pattern(fmt))))


# Shapes read without a named format. A time may follow any date.
_TIME = r"([ T]\d{1,2}[:.-]\d{1,2}([:.-]\d{1,2}(\.\d{1,6})?)?)?$"
_YEAR_FIRST = r"^\d{4}([-/.])\d{1,2}\1\d{1,2}" + _TIME
_PLAIN_DATE = r"^\d{4}-\d{2}-\d{2}$"
_YEAR_LAST = r"^\d{1,2}([-/.])\d{1,2}\1\d{4}" + _TIME
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?$"
_CLOCK = r"^\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$"
_MONTH = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_NAMED = rf"{_MONTH}\.? +\d{{1,2}},? +\d{{4}}|\d{{1,2}}[ -]{_MONTH}[ -]\d{{4}}"
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times inside one expression."""
    # element_at keeps its type; get works it out from the whole body again for every row
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def _from_parts(text: Column) -> Column:
    """'year month day [hour minute [second [fraction]]]', any separators, to a timestamp."""

    def build(parts: Column) -> Column:
        def number(i: int) -> Column:
            return F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))

        seconds = F.concat(number(5).cast("string"), F.lit("."), F.coalesce(F.get(parts, F.lit(6)), F.lit("0")))
        return F.try_make_timestamp(number(0), number(1), number(2), number(3), number(4), seconds.try_cast("decimal(8,6)"))

    return let(F.split(text, r"[^0-9]+"), build)


def infer_timestamp(c: Column, dayfirst: bool = False) -> Column:
    """Read text as a timestamp by the first known shape that fits.

    Where the order of day and month is open, month-first is tried before
    day-first unless asked otherwise. A bare time lands on 1970-01-01, so the
    result never depends on the day it runs. Fields are taken apart and checked as
    numbers, which is much cheaper than letting a parser fail on each format.
    """
    month_first, day_first = "$3-$1-$2", "$3-$2-$1"
    first, second = (day_first, month_first) if dayfirst else (month_first, day_first)

    def swapped(t: Column, order: str) -> Column:
        return _from_parts(F.regexp_replace(t, r"^(\d+).(\d+).(\d{4})", order))

    def read(t: Column) -> Column:
        return (
            F.when(t.rlike(_YEAR_FIRST), _from_parts(t))
            .when(t.rlike(_YEAR_LAST), F.coalesce(swapped(t, first), swapped(t, second)))
            .when(t.rlike(_COMPACT) & F.length(t).isin(8, 12, 14), _from_parts(F.regexp_replace(t, _COMPACT, "$1-$2-$3 $4:$5:$6")))
            .when(t.rlike(_CLOCK), _from_parts(F.concat(F.lit("1970-01-01 "), t)))
            .when(t.rlike(_ZONED), t.try_cast("timestamp"))
            .otherwise(F.coalesce(F.when(t.rlike(_NAMED), _named(t)), timestamp_by_shape(t, dayfirst)))
        )

    # A plain date is compiled code, without a step of binding. Other dates hold a digit, which lets most words skip the shapes.
    plain = F.try_make_timestamp(*[F.substring(c, at, size).try_cast("int") for at, size in ((1, 4), (6, 2), (9, 2))], F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    return F.when(c.rlike(_PLAIN_DATE), plain).otherwise(let(c, lambda t: F.when(t.rlike(r"[0-9]"), read(t))))


def _named(t: Column) -> Column:
    """A date with its month in letters, with an optional time behind it."""
    word = F.lower(F.regexp_extract(t, _MONTH, 1))
    place = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), word)
    month = ((place + 2) / 3).cast("int").cast("string")
    day_last = F.regexp_replace(t, rf"^{_MONTH}\.? +(\d{{1,2}}),? +(\d{{4}})", "$3-$2")
    day_ahead = F.regexp_replace(t, rf"^(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}})", "$3-$1")
    head = F.when(t.rlike(r"^\d"), day_ahead).otherwise(day_last)
    valid = head.rlike(r"^\d{4}-\d{1,2}" + _TIME)
    return F.when(
        valid, _from_parts(F.regexp_replace(head, r"^(\d{4})-", F.concat(F.lit("$1-"), month, F.lit("-"))))
    )


def to_timestamp(c: Column, fmt: str | None = None, dayfirst: bool = False) -> Column:
    """Cleaned text to a timestamp by one builder format, or by inference."""
    text = clean_text(c, DATE_NULL_TOKENS)
    return parse_format(text, fmt) if fmt else infer_timestamp(text, dayfirst)


def number_to_timestamp(c: Column, mode: str) -> Column:
    """Spreadsheet serial days, epoch seconds or epoch milliseconds to a timestamp."""
    x = c.cast("double")
    if mode == "excel_serial":
        us = F.round(x * F.lit(86_400e6)) + F.lit(float(EXCEL_EPOCH_MICROS))
    elif mode == "unix_s":
        us = F.round(x * F.lit(1e6))
    elif mode == "unix_ms":
        us = F.round(x * F.lit(1e3))
    else:
        raise ValueError(f"Unknown numeric time encoding: {mode!r}")
    # The range a nanosecond timestamp can hold, so odd values become null.
    inside = us.between(-9_223_372_036_854_775.0, 9_223_372_036_854_775.0)
    return F.when(inside, F.timestamp_micros(us.cast("bigint")))
