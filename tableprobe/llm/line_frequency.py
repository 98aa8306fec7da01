"""Quality rules with the frequency of lines across the documents of a host.

Lines are normalised and hashed; a line that stands in too many documents of its
host is boilerplate. A document is rejected if little is left of it without such
lines, or if it fails the base rules (too short, or mostly repeated phrases).

Versions of one document count once: exact and near copies share most lines, so
their smallest line hash nearly always agrees, and documents of a host are told
apart by it. Otherwise the lines of a popular document would look like boilerplate
and every copy of it, the last one included, would be rejected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.arrow import CHUNK_BYTES, chunks, tidy
from tableprobe.llm.words import Words, covered, mix, not_blank, span_hashes
from tableprobe.plans.storage import materialize

SYMBOLS = b"#*$%&|<>"


def twice(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values in groups: which occur again in their group, and which did so before."""
    keys = mix(values ^ mix(groups.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    often, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    often[order] = same[1:] | same[:-1]
    again[order] = same[:-1]
    return often, again


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    words = Words(texts, not_blank())
    data, ends = words.data, words.texts
    inside = covered_spans(words.start, words.end, len(data))
    totals = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[ends])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    grams, whole = words.grams(words.hashes(), 3)
    at = np.flatnonzero(whole)
    often, _ = twice(words.text[at], grams[at])
    repeats = words.per_text(covered(at[often], 3, len(words.start)))

    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(ends[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    stops = np.append(starts[1:], len(data))
    stops -= data[stops - 1] == 10
    has_word = np.searchsorted(words.start, stops) > np.searchsorted(words.start, starts)
    starts, stops = starts[has_word], stops[has_word]
    text = np.searchsorted(ends, starts, side="right") - 1
    _, again = twice(text, span_hashes(data, starts, stops))
    return {
        "n_words": words.counts,
        "word_chars": totals(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": totals(symbol[data]),
        "n_dup_lines": np.bincount(text[again], minlength=len(texts)),
        "n_repeat_words": repeats,
    }


def covered_spans(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    change = np.zeros(n + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    return np.cumsum(change, dtype=np.int8)[:n] > 0


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


LINE = pa.struct([("line", pa.int64()), ("words", pa.int64())])


def line_key(host: bytes, folded: bytes) -> int:
    """60 bits of the MD5 of a host and a line with A-Z in lower case and blanks folded."""
    return int.from_bytes(hashlib.md5(host + b"\n" + folded).digest()[:8]) >> 4


def _lines(text: str, host: bytes) -> list[dict]:
    words = [line.split() for line in text.encode().lower().split(b"\n")]
    return [{"line": line_key(host, b" ".join(w)), "words": len(w)} for w in words if w]


@tidy
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, size=CHUNK_BYTES // 2):
        values = _measure(batch.column("text"))
        hosts = [h.encode() for h in batch.column("host").to_pylist()]
        lines = [_lines(t or "", h) for t, h in zip(batch.column("text").to_pylist(), hosts)]
        kept = [n for n in batch.schema.names if n != "text"]
        columns = [*[batch.column(n) for n in kept], *[pa.array(values[m].astype(np.int64)) for m in MEASURES], pa.array(lines, pa.list_(LINE))]
        yield pa.RecordBatch.from_arrays(columns, [*kept, *MEASURES, "lines"])


def common_lines(measured: DataFrame, least: int, share: float) -> DataFrame:
    """Lines in more different documents of their host than ``least`` and than ``share`` of all its different ones.

    Copies of one text are one document, on both sides of the share.
    """
    each = measured.select("host", "digest", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.countDistinct("digest").alias("documents"))
    hosts = measured.groupBy("host").agg(F.countDistinct("digest").alias("of"))
    return counts.where(F.col("documents") > least).join(hosts, "host").where(F.col("documents") > share * F.col("of")).select("line")


def quality(
    docs: DataFrame,
    doc_id: str = "doc_id",
    host: str = "source",
    least: int = 20,
    share: float = 0.01,
    left: float = 0.3,
) -> DataFrame:
    """One row per row of ``docs``: its measures, ``n_common_words``, ``base_failed``, ``kept``, and ``common``, the keys of its common lines or null.

    ``kept`` is false for a document that fails the base rules or has less than
    ``left`` of its words outside common lines. A null text has no words (and fails);
    a null host is a host of its own. Repeated rows get equal results. Columns
    other than id, host and text are ignored.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text")
    ).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    fields = ", ".join(f"{m} long" for m in MEASURES)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, digest long, {fields}, lines array<struct<line: long, words: long>>"
    measured = materialize(rows.select("doc_id", "host", "digest", "text").mapInArrow(_measured, schema))
    common = common_lines(measured, least, share)
    found = measured.select("doc_id", "digest", "host", F.explode("lines").alias("x")).select("doc_id", "digest", "host", "x.line", "x.words")
    lost = found.join(common, "line", "left_semi").groupBy("doc_id", "digest", "host").agg(F.sum("words").alias("lost"), F.collect_set("line").alias("common"))
    measured = measured.drop("lines")
    copies = measured.groupBy(*measured.columns).agg(F.count("*").alias("copies"))
    joined = copies.join(
        lost,
        copies["doc_id"].eqNullSafe(lost["doc_id"]) & (copies["digest"] == lost["digest"]) & (copies["host"] == lost["host"]),
        "left",
    ).select(copies["*"], F.expr("coalesce(lost div copies, 0)").alias("n_common_words"), "common")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = joined.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("n_words") - F.col("n_common_words") >= left * F.col("n_words"))
    )
    again = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return out.withColumn("copy", again).select("doc_id", "host", "digest", *MEASURES, "n_common_words", "base_failed", "kept", "common")


def _key(host: Column, line: Column) -> Column:
    """``line_key`` of a line as it stands in a text."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    folded = F.btrim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))
    return F.conv(F.substring(F.md5(F.concat(host, F.lit("\n"), folded)), 1, 15), 16, 10).cast("long")


def good_documents(docs: DataFrame, doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns; common lines are taken out of the text.

    Null texts and texts without words fail the base rules and are gone; repeated rows
    are treated alike, an empty table stays empty.
    """
    kept = quality(docs, doc_id, host).where("kept").groupBy(F.col("doc_id").alias("own_id"), F.col("host").alias("own_host"), F.col("digest").alias("own_digest")).agg(F.first("common").alias("own_common"))
    text, name = docs["text"].cast("string"), F.coalesce(docs[host].cast("string"), F.lit(""))
    same = docs[doc_id].eqNullSafe(kept["own_id"]) & (name == kept["own_host"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == kept["own_digest"])
    left = F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(kept["own_common"], _key(name, line)))
    cleaned = F.when(kept["own_common"].isNull(), docs["text"]).otherwise(F.array_join(left, "\n"))
    return docs.join(kept, same).select(*[cleaned.alias(c) if c == "text" else docs[c] for c in docs.columns])
