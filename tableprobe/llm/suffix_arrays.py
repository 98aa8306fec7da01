"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a 200-byte string that also starts elsewhere is removed.
Passages that may recur are found and dealt out as described in ``passages.py``.
Each shard of them gets a suffix array (Larsson-Sadakane refinement: ranks of
prefixes are doubled in length, and only groups that are still tied are sorted
again) and Kasai's common prefixes; neighbours with 200 common bytes repeat. A part
larger than a shard is cut into several, and strings that are single in their own
shard are looked up in the arrays of the others by binary search.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.passages import Scheme, remove_repeats

WIDTH = 200
GRAM = 40
SHARD_BYTES = 4_000_000


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order; a suffix that ends is smaller."""
    n = len(data)
    padded = np.zeros(n + 7, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    # seven bytes at once; nine bits each, as the end is a value of its own
    start = np.zeros(n, np.uint64)
    for k in range(7):
        start = (start << np.uint64(9)) | padded[k : n + k]
    order = np.argsort(start, kind="stable")
    new = np.ones(n, bool)
    new[1:] = start[order][1:] != start[order][:-1]
    # the rank of a group is the place of its first suffix in the order
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length = 7
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        suffixes = order[places]
        later = suffixes + length
        second = np.where(later < n, rank[np.minimum(later, n - 1)], -1)
        key = rank[suffixes] * np.int64(n + 1) + (second + 1)
        by = np.argsort(key, kind="stable")
        order[places] = suffixes[by]
        key = key[by]
        fresh = np.ones(len(places), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[places] = fresh
        rank[order[places]] = np.maximum.accumulate(np.where(fresh, places, 0))
        length *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix and the one before it in the array.

    Kasai's argument goes from place to place: if the bytes before two neighbouring
    suffixes agree, the common prefix is the previous place's less one. So only
    places where those bytes differ are compared, eight bytes at a time, and the
    others follow from the nearest such place on their left.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = (at > 0) & (before > 0)
    follows[follows] = data[at[follows] - 1] == data[before[follows] - 1]
    compared = np.flatnonzero(~follows)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = np.zeros(len(compared), np.int64)
    going = np.flatnonzero(before[compared] >= 0)
    while len(going):
        a, b = compared[going] + length[going], before[compared[going]] + length[going]
        differs = eight[np.minimum(a, n)] != eight[np.minimum(b, n)]
        some = differs.any(axis=1)
        length[going] += np.where(some, differs.argmax(axis=1), 8)
        going = going[~some & (np.maximum(a, b) + 8 < n)]
    length = np.minimum(length, n - np.maximum(compared, before[compared]))
    nearest = np.maximum.accumulate(np.where(follows, 0, at))
    slot = np.searchsorted(compared, nearest)
    return length[slot] - (at - nearest)


class Shard:
    """Different texts one after another, with their suffix array; ``repeats`` marks strings that start twice or more."""

    def __init__(self, texts: list[bytes], width: int):
        self.width = width
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.first = np.cumsum(sizes) - sizes
        room = np.repeat(self.first + sizes, sizes) - np.arange(len(self.data))
        order = suffix_array(self.data)
        shared = common_prefixes(self.data, order)[order]
        group = np.cumsum(shared < width) - (shared[0] < width)
        # a string has to lie in one text; the others only stand between
        whole = room[order] >= width
        self.sorted, group = order[whole], group[whole]
        self.head = np.ones(len(group), bool)
        self.head[1:] = group[1:] != group[:-1]
        self.repeats = np.zeros(len(self.data), bool)
        if len(group):
            self.repeats[self.sorted] = np.bincount(group)[group] > 1

    def holds(self, other: Shard, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which strings of another shard stand here too, and where, by binary search."""
        if not len(self.sorted) or not len(places):
            return np.zeros(len(places), bool), np.zeros(len(places), np.int64)
        view, wanted = (np.lib.stride_tricks.sliding_window_view(x.data, self.width) for x in (self, other))
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.sorted), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            for part in np.array_split(open_, 1 + len(open_) // 20_000):
                middle = (low[part] + high[part]) // 2
                mine, theirs = view[self.sorted[middle]], wanted[places[part]]
                differs = mine != theirs
                at = differs.argmax(axis=1)
                rows = np.arange(len(part))
                less = differs[rows, at] & (mine[rows, at] < theirs[rows, at])
                low[part] = np.where(less, middle + 1, low[part])
                high[part] = np.where(less, high[part], middle)
        found = np.minimum(low, len(self.sorted) - 1)
        same = np.zeros(len(places), bool)
        for part in np.array_split(np.arange(len(places)), 1 + len(places) // 20_000):
            same[part] = (view[self.sorted[found[part]]] == wanted[places[part]]).all(axis=1)
        return same & (low < len(self.sorted)), self.sorted[found]


def _repeated(segments: list[tuple[int, int, int, bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and end byte of every repeated string."""
    texts: dict[bytes, list[tuple[int, int]]] = {}
    for owner, _, at, text in segments:
        texts.setdefault(text, []).append((owner, at))
    groups: list[list[bytes]] = [[]]
    size = 0
    for text in texts:
        if size > SHARD_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(text)
        size += len(text)
    shards = [Shard(group, width) for group in groups if group]
    for k, shard in enumerate(shards):
        for other in shards[:k]:
            # one of each different string; where several are equal, all are marked already
            heads = shard.sorted[shard.head]
            same, where = other.holds(shard, heads)
            shard.repeats[heads[same]] = True
            other.repeats[where[same]] = True
    owners, starts, ends = [], [], []
    for shard, group in zip(shards, [g for g in groups if g]):
        for n, text in enumerate(group):
            places = texts[text]
            count = len(text) - width + 1
            base = int(shard.first[n])
            flags = np.ones(count, bool) if len(places) > 1 else shard.repeats[base : base + count]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                for owner, at in places:
                    owners.append(owner)
                    starts.append(at + a)
                    ends.append(at + b + width - 1)
    return np.array(owners, np.int64).view(np.uint64), np.array(starts, np.int64), np.array(ends, np.int64)


def remove_repeated_strings(docs: DataFrame, doc_id: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans`` and ``kept``, the bytes left.

    Texts are compared as UTF-8; strings never cross documents. Rows with one id and
    one text are one document. Null, empty and short texts have no strings. What is
    left need not be valid UTF-8 and is binary. Other columns are ignored.
    """
    scheme = Scheme(words=False, window=width, gram=gram, cut=2048)
    done = remove_repeats(docs, doc_id, scheme, partial(_repeated, width=width), ordered=False)
    return done.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept")
