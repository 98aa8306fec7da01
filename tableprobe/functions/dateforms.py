"""Date texts by their shape: a key of digit runs, month names and marks, and a rule for each key.

The key of ``Mon, 02 Jan 2024 3:04 PM`` is ``n b y`` for the date and ``n:np`` for the
time: ``n`` one or two digits, ``y`` four, ``b`` a month in letters. A rule says which of the
numbers is year, month and day. One look-up replaces a chain of patterns, and a further
form is a further line in the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names as they stand in dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

_MONTH = rf"\b({'|'.join(MONTHS)})[a-z]*\.?"
_WEEKDAY = rf"^({'|'.join(WEEKDAYS)})[a-z]*\.?,? +"
#: At most thirty runs of letters, digits or marks: a date has no more. Nothing is tried twice.
_DATE_LIKE = r"^(?:[a-z]++|[0-9]++|[-/.:,+ ]++){1,30}+$"
_ZONE = r"(?<=[0-9m.]) ?(z|utc|gmt|[+-][0-9]{2}:?[0-9]{2})$"
_HALF = r" ?([ap])\.?m\.?$"
_CLOCK = r"(?:^|[ t]|, )([0-9]{1,2})(?::([0-9]{1,2})(?::([0-9]{1,2})(?:[.,]([0-9]{1,9}))?)?)?$"

#: Key of the date -> places of year, month and day among its numbers ("b": month in letters, "-": the first).
#: Keys with two readings have the month-first one here and the day-first one below.
RULES = {
    "n/n/n": "201", "n-n-n": "201", "n.n.n": "201",
    "n/n/y": "201", "n-n-y": "201", "n.n.y": "201",
    "y/n/n": "012", "y-n-n": "012", "y.n.n": "012",
    "y-n": "01-", "y/n": "01-", "n/y": "10-", "n-y": "10-",
    "b y": "0b-", "b, y": "0b-", "b-y": "0b-", "b/y": "0b-", "y b": "0b-", "y-b": "0b-",
    "b n y": "1b0", "b n, y": "1b0", "b-n-y": "1b0", "b/n/y": "1b0",
    "n b y": "1b0", "n b, y": "1b0", "n-b-y": "1b0", "n/b/y": "1b0",
    "n b n": "1b0", "n-b-n": "1b0", "n/b/n": "1b0", "b n, n": "1b0",
    "y-b-n": "0b1", "y b n": "0b1", "y/b/n": "0b1",
}
DAY_FIRST = {key: "210" for key in ("n/n/n", "n-n-n", "n.n.n", "n/n/y", "n-n-y", "n.n.y")}
#: Two-digit years from here on lie in the 20th century.
CENTURY = 69


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    # element_at keeps its type; get works it out from the whole body again for every row
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def _lookup(rules: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), key)


def _shape(date: Column) -> Column:
    """Key, numbers and month name of a date text."""
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(date, _MONTH, "b"), "[0-9]{4}", "y"), "[0-9]{1,2}(?:st|nd|rd|th)?", "n")
    numbers = F.transform(F.regexp_extract_all(date, F.lit("([0-9]+)"), F.lit(1)), lambda n: F.struct(n.try_cast("int").alias("value"), F.length(n).alias("length")))
    return F.struct(key.alias("key"), numbers.alias("numbers"), F.regexp_extract(date, _MONTH, 1).alias("month"))


def _date(shape: Column, rules: dict[str, str]) -> Column:
    """(year, month, day) of the shape of a date, null if its key has no rule."""

    def build(rule: Column) -> Column:
        def at(place: int) -> Column:
            return F.get(shape["numbers"], F.substring(rule, place, 1).try_cast("int"))

        def whole(year: Column) -> Column:
            short = F.when(year["value"] < CENTURY, year["value"] + 2000).otherwise(year["value"] + 1900)
            return F.when(year["length"] > 2, year["value"]).otherwise(short)

        named = F.ceil(F.instr(F.lit("".join(MONTHS)), shape["month"]) / 3).cast("int")
        second = F.when(F.substring(rule, 2, 1) == "b", named).otherwise(at(2)["value"])
        day = F.when(F.substring(rule, 3, 1) == "-", F.lit(1)).otherwise(at(3)["value"])
        return F.when(rule.isNotNull(), F.struct(_let(at(1), whole).alias("year"), second.alias("month"), day.alias("day")))

    return _let(_lookup(rules, shape["key"]), build)


def timestamp_by_shape(text: Column, dayfirst: bool = False) -> Column:
    """Read a date, a time or both by the shape of the text; null if no rule knows it.

    Where the order of day and month is open, the other one is tried if the first
    gives no date. A bare time lands on 1970-01-01, a month without a day on its first.
    A time without a zone is taken as it stands; with one it is shifted to UTC.
    Fractions are cut after microseconds.
    """
    first, second = (RULES | DAY_FIRST, RULES) if dayfirst else (RULES, RULES | DAY_FIRST)

    # Whatever is used more than once is bound first: Spark works out every use of an expression anew.
    def read(t: Column) -> Column:
        # only a clock has a zone, so that 11-2024 stays a month
        return _let(F.when(t.contains(":"), F.regexp_extract(t, _ZONE, 1)).otherwise(F.lit("")), lambda zone: unzoned(t, zone))

    def unzoned(t: Column, zone: Column) -> Column:
        bare = F.regexp_replace(F.when(zone == "", t).otherwise(F.regexp_replace(t, _ZONE, "")), _WEEKDAY, "")
        return _let(bare, lambda x: _let(F.regexp_extract(x, _HALF, 1), lambda half: halved(F.when(half == "", x).otherwise(F.regexp_replace(x, _HALF, "")), half, zone)))

    def halved(text: Column, half: Column, zone: Column) -> Column:
        # a clock has a colon, or stands alone before AM or PM
        def parted(t: Column) -> Column:
            return _let(t.rlike(_CLOCK) & (t.contains(":") | (half != "")), lambda clocked: timed(t, half, zone, clocked))

        return _let(text, parted)

    def timed(t: Column, half: Column, zone: Column, clocked: Column) -> Column:
        date = F.btrim(F.when(clocked, F.regexp_replace(t, _CLOCK, "")).otherwise(t))

        def clock(group: int) -> Column:
            return F.when(clocked, F.coalesce(F.regexp_extract(t, _CLOCK, group).try_cast("int"), F.lit(0))).otherwise(F.lit(0))

        micros = F.when(clocked, F.rpad(F.substring(F.regexp_extract(t, _CLOCK, 4), 1, 6), 6, "0").try_cast("int")).otherwise(F.lit(0))
        seconds = clock(3) + micros.cast("decimal(9,0)") / F.lit(1_000_000).cast("decimal(9,0)")
        sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)

        def offset(digits: Column) -> Column:
            return F.when(digits == "", F.lit(0)).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))

        shift = F.when(zone == "", F.lit(0)).otherwise(_let(F.regexp_replace(zone, "[^0-9]", ""), offset))
        parts = F.struct(date.alias("date"), clock(1).alias("hour"), clock(2).alias("minute"), seconds.cast("decimal(8,6)").alias("second"), shift.alias("shift"))
        return _let(parts, lambda p: joined(p, half, zone, clocked))

    def joined(p: Column, half: Column, zone: Column, clocked: Column) -> Column:
        fine = (zone == "") | (clocked & (F.abs(p["shift"]) <= 14 * 60))
        hour = F.when(half == "", p["hour"]).when(p["hour"].between(1, 12), p["hour"] % 12 + F.when(half == "p", 12).otherwise(0))

        def made(day: Column) -> Column:
            return F.try_make_timestamp(day["year"], day["month"], day["day"], hour, p["minute"], p["second"])

        epoch = F.struct(F.lit(1970).alias("year"), F.lit(1).alias("month"), F.lit(1).alias("day"))
        dated = _let(_shape(p["date"]), lambda shape: F.coalesce(_let(_date(shape, first), made), _let(_date(shape, second), made)))
        found = F.when((p["date"] == "") & clocked, made(epoch)).when((half == "") | clocked, dated)
        moved = F.timestamp_micros(F.unix_micros(found) - F.coalesce(p["shift"], F.lit(0)).cast("bigint") * F.lit(60_000_000))
        return F.when(fine, F.when(zone == "", found).otherwise(moved))

    return _let(F.lower(text), lambda t: F.when(t.rlike("[0-9]") & t.rlike(_DATE_LIKE), read(t)))
