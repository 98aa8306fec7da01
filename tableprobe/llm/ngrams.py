"""Runs of words as hashed windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTSIDE_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: str | Column) -> Column:
    """Runs of letters, digits and code points beyond ASCII, A-Z in lower case; none for a null text."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), OUTSIDE_WORDS)
    return F.filter(parts, lambda x: x != "")


#: Window starts of a block. A row of a window carries its block's words, never those of the whole document.
BLOCK = 64


def windows(words: Column, hashes: Column, n: int, most: int | None = None) -> Column:
    """``at`` (from 0), ``n`` and ``hash`` of every window of ``n`` words, or of the first ``most``; ``hashes`` are those of the words."""

    def window(i: Column) -> Column:
        return F.struct((i - 1).alias("at"), F.lit(n).alias("n"), F.xxhash64(F.slice(hashes, i, F.lit(n))).alias("hash"))

    last = F.size(words) - (n - 1)
    last = last if most is None else F.least(last, F.lit(most))
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, window)


def find_windows(docs: DataFrame, key: list[str], targets: DataFrame, lengths: list[int]) -> DataFrame:
    """Every place in ``docs`` (``key``, ``words``) where a target's words stand.

    ``targets`` has ``target`` (words), its ``hash`` and whatever is wanted beside
    them; it is broadcast, so the caller has bounded it. Documents are cut into
    blocks of window starts, so the work grows with the length of a document and not
    with its square. Windows meet targets by hash inside the scan stage, and their
    words are compared there too: only true places leave it, with ``at`` and the
    target's columns. A document without words has no places.
    """
    room = BLOCK + max(lengths) - 1
    firsts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(firsts, lambda b: F.struct(b.alias("first"), F.slice("words", b + 1, F.lit(room)).alias("near")))
    blocks = docs.select(*key, F.inline(cut))
    hashed = blocks.withColumn("hashes", F.transform("near", lambda w: F.xxhash64(w)))
    found = F.concat(*[windows(F.col("near"), F.col("hashes"), n, BLOCK) for n in lengths])
    rows = hashed.select(*key, "first", "near", F.inline(found))
    joined = rows.join(F.broadcast(targets), "hash").where(F.slice("near", F.col("at") + 1, F.col("n")) == F.col("target"))
    return joined.withColumn("at", F.col("first") + F.col("at")).drop("first", "near")


def hashed_targets(words: Column) -> Column:
    return F.xxhash64(F.transform(words, lambda w: F.xxhash64(w)))
