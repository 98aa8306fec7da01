"""Substring dedup with automata of repeated phrases.

A phrase of 13 words is removed where a document with a smaller id has it too.
Passages that may recur are found as described in ``passages.py`` and dealt out in
shards. A shard confirms by hash which of its phrases stand in several documents, compiles
them into an Aho-Corasick automaton over word numbers, each with the smallest
document that holds it, and streams all its passages through the automaton.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.passages import Scheme, remove_repeats
from tableprobe.llm.words import Words, not_blank

WIDTH = 13
GRAM = 6
#: Confirmed phrases in one automaton; a shard with more makes several and streams its passages through each.
PATTERNS = 200_000


def _locate(segments: list[tuple[int, int, int, bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and end word of every phrase to remove."""
    import ahocorasick

    texts: dict[bytes, list[tuple[int, int, int]]] = {}
    for owner, rank, at, text in segments:
        texts.setdefault(text, []).append((rank, owner, at))
    places = list(texts.values())
    low, high = (np.array([f(p)[0] for p in places], np.int64) for f in (min, max))
    words = Words(pa.array(list(texts), pa.binary()), not_blank())
    hashes = words.hashes()
    _, numbers = np.unique(hashes, return_inverse=True)
    grams, inside = words.grams(hashes, width)
    at = np.flatnonzero(inside)
    order = at[np.lexsort((low[words.text[at]], grams[at]))]
    new = np.ones(len(order), bool)
    new[1:] = grams[order][1:] != grams[order][:-1]
    heads = np.flatnonzero(new)
    if not len(heads):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    smallest = low[words.text[order[heads]]]
    largest = np.maximum.reduceat(high[words.text[order]], heads)
    confirmed = np.flatnonzero(smallest < largest)
    wanted = np.unique(words.text[order[(largest > smallest)[np.cumsum(new) - 1]]]).tolist()

    owners, starts = [], []
    for block in np.array_split(confirmed, 1 + len(confirmed) // PATTERNS):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for start, rank in zip(order[heads[block]].tolist(), smallest[block].tolist()):
            automaton.add_word(tuple(numbers[start : start + width].tolist()), rank)
        automaton.make_automaton()
        for n in wanted:
            if len(block):
                for end, rank in automaton.iter(tuple(numbers[words.first[n] : words.first[n + 1]].tolist())):
                    for own, owner, first in places[n]:
                        if rank < own:
                            owners.append(owner)
                            starts.append(first + end - width + 1)
    starts = np.array(starts, np.int64)
    return np.array(owners, np.int64).view(np.uint64), starts, starts + width


def remove_repeated_phrases(docs: DataFrame, doc_id: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, n_spans`` and ``kept``, the words left joined by blanks.

    Words are what stands between ASCII blanks. Repeats within one document stay, and
    so do all rows with one id. A null id counts as the smallest. Null, empty and
    short texts have no phrases. Other columns are ignored.
    """
    scheme = Scheme(words=True, window=width, gram=gram, cut=64)
    done = remove_repeats(docs, doc_id, scheme, partial(_locate, width=width), ordered=True)
    return done.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept"))
