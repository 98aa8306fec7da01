"""Repeated windows of documents: the part that phrases and byte strings share.

A window is a fixed number of units (words or bytes) of one document. Each window
picks an anchor, the smallest hash among the grams inside it, so equal windows pick
equal anchors and neighbouring windows mostly share one. The work is then:

1. Texts are digested; of exact copies only the first goes on. Anchors held by several
   texts are found (``recurring.py``).
2. Texts are read again; runs of windows with such an anchor become segments.
   Segments that a task saw before are settled there and then; the others are dealt
   out by anchor, so all equal windows of different segments meet in one part.
3. Each part compares its segments (the operators differ here) and says which units
   of which document go.
4. These ranges are joined to the documents.

Grams of very common passages, known from a bounded sample, come last in the order.
A window across the edge of such a passage thus picks a gram of its own text and
does not crowd the passage's part. The sample shifts work only; results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.arrow import chunks, text_bytes, tidy
from tableprobe.llm.recurring import fold, grouped, pack, parts_for, recurring, unpack
from tableprobe.llm.words import FACTOR, Words, mix, not_blank, span_hashes

SAMPLE_DOCS = 2000
HOT_GRAMS = 100_000
#: Bytes of segments a task gathers before it folds and sends them.
HELD_BYTES = 24_000_000
SMALLEST = -(1 << 63)
LAST = np.uint64(1) << np.uint64(63)


@dataclass
class Units:
    """Units of some texts: hash of the gram at each unit, the text of each unit, and their places in the bytes."""

    grams: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    first: np.ndarray


@dataclass
class Scheme:
    """``window`` and ``gram`` are numbers of units; ``cut`` is the most window starts of a segment."""

    words: bool
    window: int
    gram: int
    cut: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @property
    def slice_bytes(self) -> int:
        """Text worked on at once: every unit costs about a hundred bytes, and a byte is a unit."""
        return 1 << 20 if self.words else 1 << 18

    def units(self, column: pa.Array, hashed: bool = True) -> Units:
        none = np.zeros(0, np.uint64)
        if self.words:
            words = Words(column, not_blank())
            grams = words.grams(words.hashes(), self.gram)[0] if hashed else none
            return Units(grams, words.text, words.start, words.end, words.data, words.first)
        data, first = text_bytes(column)
        n = len(data)
        at = np.arange(n)
        short = max(n - self.gram + 1, 0)
        grams = span_hashes(data, at[:short], at[:short] + self.gram) if hashed else none
        return Units(grams, np.repeat(np.arange(len(first) - 1), np.diff(first)), at, at + 1, data, first)

    def anchors(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """The unit where the anchor of the window at each unit stands, and whether the window lies inside one text.

        Ordered by the upper half of the hash; of equal grams the first is taken, so
        equal windows take it at equal places and each anchor has a run of its own.
        """
        span = self.window - self.gram + 1
        n = len(units.text) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        order = (units.grams >> np.uint64(33)) << np.uint64(32)
        if len(self.hot):
            table = np.zeros(1 << 16, bool)
            table[(self.hot >> np.uint64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(table[(units.grams >> np.uint64(48)).astype(np.int64)])
            nearest = np.minimum(np.searchsorted(self.hot, units.grams[maybe]), len(self.hot) - 1)
            common = maybe[self.hot[nearest] == units.grams[maybe]]
            order[common] |= LAST
        inside = units.text[:n] == units.text[self.window - 1 :]
        order |= np.arange(len(order), dtype=np.uint64)
        return (sliding_minimum(order, span)[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64), inside


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each place on, by running minima of blocks from both ends."""
    n = len(values)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) if n + width - 1 <= len(ahead) else np.minimum(back[: len(ahead) - width + 1], ahead[width - 1 :])[:n]


def _owners(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("owner").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _anchor_pairs(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in chunks(batches, size=scheme.slice_bytes):
        units = scheme.units(batch.column("text"))
        places, inside = scheme.anchors(units)
        new = inside.copy()
        new[1:] &= (places[1:] != places[:-1]) | ~inside[:-1]
        at = np.flatnonzero(new)
        yield units.grams[places[at]], _owners(batch)[units.text[at]]


@tidy
def _every_gram(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, size=scheme.slice_bytes):
        units = scheme.units(batch.column("text"))
        grams, _, _ = fold(units.grams, units.text[: len(units.grams)].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["key"])


def common_grams(rows: DataFrame, scheme: Scheme) -> np.ndarray:
    """Grams in 0.2 % of a bounded sample of documents, at most ``HOT_GRAMS``."""
    every = max(1, rows.count() // SAMPLE_DOCS)
    sample = rows.where(F.pmod(F.xxhash64("owner"), F.lit(every)) == 0)
    counts = sample.mapInArrow(partial(_every_gram, scheme=scheme), "key long").groupBy("key").count().where(F.col("count") >= 4)
    top = counts.orderBy(F.desc("count"), "key").limit(HOT_GRAMS).select("key")
    return np.sort(np.array([r["key"] for r in top.collect()], np.int64).view(np.uint64))


def ranges_binary(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return pack(starts.astype(np.uint64), ends.astype(np.uint64))


def _by_owner(owners: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((starts, owners))
    owners, starts, ends = owners[order], starts[order], ends[order]
    cuts = np.flatnonzero(np.diff(owners)) + 1
    for o, s, e in zip(np.split(owners, cuts), np.split(starts, cuts), np.split(ends, cuts)):
        if len(o):
            yield int(o[0].view(np.int64)), ranges_binary(s, e)


SEGMENTS = "kind int, part long, owner long, rank long, at long, packed binary"
COLUMNS = ("kind", "part", "owner", "rank", "at", "packed")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((),) * 6, kinds)], list(COLUMNS))


@tidy
def _segments(batches: Iterator[pa.RecordBatch], scheme: Scheme, parts: int, ordered: bool) -> Iterator[pa.RecordBatch]:
    """Segments to compare (kind 0) and ranges already settled (kind 1).

    ``ordered``: of equal segments those of the smallest rank stay; else none does.
    """
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        keys, owners, ranks, at, count, anchor = (np.concatenate([h[k] for h in held]) for k in range(6))
        texts = [t for h in held for t in h[6]]
        order = np.lexsort((at, owners, ranks, keys))
        place = np.ones(len(order), bool)  # the same row may come twice
        place[1:] = (keys[order][1:] != keys[order][:-1]) | (owners[order][1:] != owners[order][:-1]) | (at[order][1:] != at[order][:-1])
        order = order[place]
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        group = np.cumsum(new) - 1
        lead = order[new][group]
        gone = order[ranks[order] != ranks[lead] if ordered else np.bincount(group)[group] > 1]
        rows = [(1, int(o % parts), o, 0, 0, x) for o, x in _by_owner(owners[gone], at[gone], at[gone] + count[gone] + scheme.window - 1)]
        for n in order[(ranks[order] == ranks[lead]) if ordered else new].tolist():
            rows.append((0, int(anchor[n] % np.uint64(parts)), int(owners[n].view(np.int64)), int(ranks[n]), int(at[n]), texts[n]))
        return _batch(rows)

    # copies are left out here and not by a filter, which would change the join's keys and cost another shuffle of the texts
    for batch in chunks((b.filter(pc.equal(b.column("number"), b.column("rank"))) for b in batches), size=scheme.slice_bytes):
        found = _candidate_runs(batch, scheme)
        if len(found[0]):
            held.append(found)
            size += sum(map(len, found[6])) + 100 * len(found[6])
        if size > HELD_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _candidate_runs(batch: pa.RecordBatch, scheme: Scheme) -> tuple:
    """Segments of a slice: hash of the text, owner, rank, first unit, number of window starts, anchor, and the text."""
    units = scheme.units(batch.column("text"))
    places, inside = scheme.anchors(units)
    n = len(places)
    text = units.text[:n]
    lists = batch.column("keys")
    wanted = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    tag = mix(np.arange(batch.num_rows, dtype=np.uint64) * FACTOR + np.uint64(1))
    edge = np.ones(n, bool)
    edge[1:] = (places[1:] != places[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(edge)
    stop = np.append(begin[1:], n)
    take = inside[begin] if n else np.zeros(0, bool)
    begin, stop = begin[take], stop[take]
    anchors = units.grams[places[begin]]
    tagged = anchors ^ tag[text[begin]]
    good = np.isin(tagged, wanted ^ tag[rows])
    if not scheme.words:
        # strings may repeat within a document: its anchors that come again
        _, back, times = np.unique(tagged, return_inverse=True, return_counts=True)
        good |= times[back] > 1
    begin, stop, anchors = begin[good], stop[good], anchors[good]
    pieces = -(-(stop - begin) // scheme.cut)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + step * scheme.cut
    anchors = np.repeat(anchors, pieces)
    count = np.minimum(np.repeat(stop, pieces) - begin, scheme.cut)
    left, right = units.start[begin], units.end[begin + count + scheme.window - 2] if len(begin) else begin
    raw = units.data.tobytes()
    if scheme.words:
        texts = [b" ".join(raw[a:b].split()) for a, b in zip(left.tolist(), right.tolist())]
    else:
        texts = [raw[a:b] for a, b in zip(left.tolist(), right.tolist())]
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    keys = span_hashes(joined, ends - [len(t) for t in texts], ends) if texts else np.zeros(0, np.uint64)
    keys = mix(keys + anchors) if texts else keys
    ranks = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
    return keys, _owners(batch)[text[begin]], ranks[text[begin]], (begin - units.first[text[begin]]).astype(np.int64), count, anchors, texts


Compare = Callable[[list[tuple[int, int, int, bytes]]], tuple[np.ndarray, np.ndarray, np.ndarray]]


@tidy
def _compare_parts(batches: Iterator[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by kind and part; a part is compared when it is complete."""

    def out(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o for o, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["owner", "ranges"])

    held, now = [], None
    for batch in batches:
        settled = []
        for kind, part, owner, rank, at, packed in zip(*(batch.column(n).to_pylist() for n in COLUMNS)):
            if kind == 1:
                settled.append((owner, packed))
                continue
            if part != now and held:
                yield out([*_by_owner(*compare(held))])
                held = []
            now = part
            held.append((owner, rank, at, packed))
        if settled:
            yield out(settled)
    if held:
        yield out([*_by_owner(*compare(held))])


@tidy
def _cut_out(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """``n_units, n_removed, n_spans`` and what is left of each text."""
    for batch in chunks(batches, size=scheme.slice_bytes):
        units = scheme.units(batch.column("text"), hashed=False)
        raw, first = units.data.tobytes(), units.first
        total, removed, spans, left = [], [], [], []
        whole = batch.column("whole").to_pylist()
        for n, ranges in enumerate(batch.column("ranges").to_pylist()):
            a, b = int(first[n]), int(first[n + 1])
            change = np.zeros(b - a + 1, np.int64)
            for packed in ranges or ():
                starts, ends = unpack(packed, 2)
                np.add.at(change, starts.astype(np.int64), 1)
                np.add.at(change, ends.astype(np.int64), -1)
            gone = np.cumsum(change)[:-1] > 0
            if whole[n] and b - a >= scheme.window:
                gone[:] = True
            total.append(b - a)
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
            if scheme.words:
                keep = np.flatnonzero(~gone) + a
                left.append(b" ".join(raw[s:e] for s, e in zip(units.start[keep].tolist(), units.end[keep].tolist())))
            else:
                left.append(units.data[a:b][~gone].tobytes())
        columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str, scheme: Scheme, compare: Compare, ordered: bool) -> DataFrame:
    """``doc_id, n_units, n_removed, n_spans, kept`` for every row.

    ``ordered``: a window stays in the document with the smallest id; else it goes
    everywhere. A null id counts as the smallest.
    """
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(SMALLEST).cast("long"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("owner"), F.col(doc_id).cast("long").alias("doc_id"), number.alias("number"), text.alias("text"))
    scheme.hot = common_grams(rows, scheme)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_byte = 2 / (scheme.window - scheme.gram + 2) / (6 if scheme.words else 1)
    parts = parts_for(rows, size * per_byte)
    leads = rows.groupBy("owner").agg(F.min("number").alias("rank"), (F.min("number") != F.max("number")).alias("copied"))
    hits = grouped(recurring(rows, partial(_anchor_pairs, scheme=scheme), parts), "keys")
    # both joins below shuffle the same columns by the same key, so Spark shuffles the texts once
    facts = leads.join(hits, "owner", "left").withColumnRenamed("owner", "fact_owner")
    ready = rows.join(facts, rows["owner"] == F.col("fact_owner"), "left").select("owner", "doc_id", "number", "text", "rank", "keys")
    sent = ready.mapInArrow(partial(_segments, scheme=scheme, parts=parts, ordered=ordered), SEGMENTS)
    compared = sent.repartition("part").sortWithinPartitions("kind", "part").mapInArrow(partial(_compare_parts, compare=compare), "owner long, ranges binary")
    gone = compared.groupBy("owner").agg(F.collect_list("ranges").alias("ranges"))
    ends = leads.join(gone, "owner", "left").withColumnRenamed("owner", "fact_owner")
    whole = (F.col("number") != F.col("rank")) if ordered else F.col("copied")
    return (
        rows.join(ends, rows["owner"] == F.col("fact_owner"), "left")
        .select("owner", "doc_id", "number", "text", "ranges", whole.alias("whole"))
        .mapInArrow(partial(_cut_out, scheme=scheme), "doc_id long, n_units long, n_removed long, n_spans long, kept binary")
    )
