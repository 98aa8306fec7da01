"""Benchmark decontamination with a broadcast set of normalised test windows.

Every window of 13 words of the benchmark (a shorter item is one window) is hashed
into a broadcast set. Documents are scanned window by window in the same stage,
hits are verified word by word, and the words inside hits are counted. Only hits
are shuffled, so a passage that a third of all documents hold costs one row each.

The set is broadcast in blocks of proven size: benchmark text is measured first,
and one larger than ``BLOCK_BYTES`` is cut into as many blocks as needed, each
with a scan of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.ngrams import find_windows, hashed_targets, plain_words, windows

WIDTH = 13
#: Benchmark text whose windows are broadcast at once; windows take about ``WIDTH`` times as much.
BLOCK_BYTES = 2_000_000


def benchmark_windows(benchmark: DataFrame, item_id: str, width: int) -> DataFrame:
    """``target`` words, ``n``, ``hash`` and ``items``, one row per different window."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), plain_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.size("words").alias("n"), F.xxhash64(hashes).alias("hash")))
    found = F.when(F.size("words") < width, whole).otherwise(windows(F.col("words"), hashes, width))
    rows = items.select("item", "words", F.inline(found))
    return (
        rows.select("item", F.slice("words", F.col("at") + 1, F.col("n")).alias("target"))
        .groupBy("target")
        .agg(F.collect_set("item").alias("items"))
        .select("target", "items", hashed_targets(F.col("target")).alias("hash"))
    )


def hits(docs: DataFrame, benchmark: DataFrame, key: list[str], item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """Places of benchmark windows: ``key``, ``at``, ``n`` and ``items``. ``docs`` has ``key`` and ``words``."""
    targets = benchmark_windows(benchmark, item_id, width)
    facts = benchmark.select(F.least(F.size(plain_words(F.col("text"))), F.lit(width)).alias("n"), F.octet_length("text").alias("size"))
    shape = facts.where("n > 0").groupBy("n").agg(F.sum("size").alias("size")).collect()  # a row for each length up to the width
    lengths = sorted(r["n"] for r in shape) or [width]
    blocks = 1 + sum(r["size"] for r in shape) // BLOCK_BYTES
    parts = [targets if blocks == 1 else targets.where(F.pmod("hash", F.lit(blocks)) == k) for k in range(blocks)]
    found = [find_windows(docs, key, part, lengths).select(*key, "at", "n", "items") for part in parts]
    return reduce(DataFrame.unionByName, found)


def _with_key(docs: DataFrame, doc_id: str) -> DataFrame:
    """Rows with one id and one text are alike; the digest tells different texts with one id apart."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("digest"), plain_words(F.col("text")).alias("words"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", percent: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``digest``, ``n_words``, ``n_hit``, ``items``, ``contaminated``.

    A word is hit if it lies in any benchmark window; a document is contaminated if at
    least ``percent`` of its words are. Null and empty texts have no words and are
    clean; items without words have no windows; with an empty benchmark all is clean.
    Other columns are ignored.
    """
    rows = _with_key(docs, doc_id)
    places: Column = F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("n") - 1)))
    found = (
        hits(rows, benchmark, ["doc_id", "digest"], item_id)
        .groupBy("doc_id", "digest")
        .agg(F.size(F.array_distinct(places)).cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )
    sizes = rows.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"))
    joined = sizes.join(found, sizes["doc_id"].eqNullSafe(found["doc_id"]) & (sizes["digest"] == found["digest"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        sizes["doc_id"],
        sizes["digest"],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """The clean documents, with all their columns."""
    bad = contamination(docs, benchmark, doc_id, item_id).where("contaminated").select("doc_id", "digest").distinct()
    own = F.xxhash64(F.lit(1), docs["text"])
    return docs.join(bad, docs[doc_id].cast("long").eqNullSafe(bad["doc_id"]) & (own == bad["digest"]), "left_anti")


def drop_hit_words(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Spans instead of documents: ``doc_id``, ``digest`` and the words outside all hits, joined by blanks."""
    rows = _with_key(docs, doc_id)
    found = hits(rows, benchmark, ["doc_id", "digest"], item_id)
    spans = found.groupBy(F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest")).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("n") - 1)))).alias("hit"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), F.coalesce("hit", F.array().cast("array<int>")))
    kept = F.when(F.size("words") == 0, F.array().cast("array<int>")).otherwise(kept)
    return joined.select("doc_id", "digest", F.array_join(F.transform(kept, lambda i: F.get("words", i)), " ").alias("kept"))
