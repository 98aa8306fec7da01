"""Text cleaning and guarded number parsing, all as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder texts that mean "no reading" (lower case, trimmed).
PLACEHOLDER_TOKENS = (
    "", "na", "n/a", "n.a", "n.a.", "nan", "null", "none", "nil", "void", "n\\a",
    "-", "--", "---", "?", "??", "???", "—", "–", ".",
    "no data", "nodata", "no sample", "calc off", "calc failed",
    "calc error", "calc trig", "i/o timeout", "scan off", "shutdown",
    "configure", "bad input", "intf shut", "comm fail", "no result",
    "bad", "bad value", "bad data", "bad quality", "error", "err",
    "sensor fail", "sensor failure", "sensor error", "sensor down",
    "disconnected", "disc", "timeout", "time out",
    "comm failure", "communication failure", "communication error",
    "unknown", "unk", "invalid", "inv", "missing",
    "not available", "not applicable",
    "no good", "ng", "off", "out of service", "oos",
    "fail", "failed", "fault", "trip", "tripped", "alarm",
    "overflow", "underflow", "saturated",
    "#n/a", "#name?", "#value!", "#div/0!", "#ref!", "#num!", "#null!",
    "#getting_data", "#spill!", "#calc!",
)

# The shorter list used when testing whether text is numeric.
NUMERIC_NULL_TOKENS = ("", "na", "n/a", "nan", "null", "none", "-", "--", "?")

# The list used when reading dates.
DATE_NULL_TOKENS = ("", "na", "n/a", "nan", "null", "none", "-", "--", "?", "nat")

# yes/no words; the wide sets are for a conversion the user asks for.
TRUE_WORDS = ("true", "yes", "y", "t")
FALSE_WORDS = ("false", "no", "n", "f")
TRUE_WORDS_WIDE = ("true", "yes", "y", "1", "t")
FALSE_WORDS_WIDE = ("false", "no", "n", "0", "f")

# Thousands grouping, and what counts as a number at all.
GROUPED_NUMBER = r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"
PLAIN_NUMBER = r"(?i)^([+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?(inf|infinity))$"

_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim every kind of blank, not only the space character."""
    return F.btrim(c, F.lit(_SPACES))


def is_token(c: Column, tokens: Iterable[str]) -> Column:
    """True where the trimmed, lower-cased text is one of the tokens; false on null."""
    return F.coalesce(F.lower(strip(c)).isin(*tokens), F.lit(False))


def clean_text(c: Column, tokens: Iterable[str] = PLACEHOLDER_TOKENS) -> Column:
    """Trimmed text with placeholder tokens turned into null."""
    return F.when(~is_token(c, tokens), strip(c))


def parse_number(c: Column) -> Column:
    """Text to double; null unless the whole value is a number."""
    bare = F.when(c.contains(",") & c.rlike(GROUPED_NUMBER), F.replace(c, F.lit(","), F.lit(""))).otherwise(c)
    return F.when(bare.rlike(PLAIN_NUMBER), bare.try_cast("double"))


DIGITS = r"^[+-]?\d{1,38}$"


def whole_number(c: Column) -> Column:
    """Text to a 64-bit whole number; null if it has another form or does not fit."""
    return F.when(c.rlike(DIGITS), c.try_cast("bigint"))


def parse_boolean(c: Column, wide: bool = False) -> Column:
    word = F.lower(strip(c))
    yes = TRUE_WORDS_WIDE if wide else TRUE_WORDS
    no = FALSE_WORDS_WIDE if wide else FALSE_WORDS
    return F.when(word.isin(*yes), F.lit(True)).when(word.isin(*no), F.lit(False))


def short_key(c: Column) -> Column:
    """A stand-in that is equal exactly when the text is, but never longer than 64 characters.

    Short text stands for itself; longer text is replaced by its SHA-256 digest, so
    that counting different texts does not move whole documents.
    """
    return F.when(F.length(c) <= 32, c).otherwise(F.sha2(c, 256))
