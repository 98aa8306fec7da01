"""Which tokens of two tokenizers stand for the same bytes, counted with inverted pair bitmaps.

Where tokens of both end at one byte, the text is cut into groups; every token of the
one is linked with every token of the other in its group. Texts are worked on piece by
piece (``pieces.py``): both tokenizers end a token at each cut, so what a piece gives is
found once and then looked up.

The index is inverted: per block of documents and pair of ids a compressed bitmap of
the documents that hold the pair, and planes with the binary digits of how often beyond
once. Blocks number documents of their own, so the union over blocks is a sum of
popcounts. The scores go back the same way: the postings of a block spread the count of
each pair over its documents.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tableprobe.llm.arrow import chunks, kept
from tableprobe.llm.bpe import Vocabulary
from tableprobe.llm.pieces import PieceTable
from tableprobe.llm.recurring import pack, unpack
from tableprobe.plans.storage import materialize

#: Pieces a worker remembers; bounds its memory, not the result.
PIECES_REMEMBERED = 300_000
#: (pair, document) entries after which a block of documents is closed.
BLOCK_ENTRIES = 1_200_000
#: Documents in a block at most: their numbers take 16 bits.
BLOCK_DOCUMENTS = 60_000
#: Ranges of first ids in which pairs are counted, at most.
MOST_PARTS = 1_000

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
COLUMNS = (*NUMBERS, "n_best", "count_sum", "groups_sha256")


class Bitmaps:
    """One set of numbers below ``width`` per key: 16-bit numbers, or a row of bits where that is shorter."""

    BITS = 0xFFFF

    def __init__(self, sizes: np.ndarray, numbers: np.ndarray, bits: np.ndarray, width: int):
        self.sizes, self.numbers, self.bits, self.width = sizes, numbers, bits, width

    @classmethod
    def of(cls, keys: np.ndarray, numbers: np.ndarray, count: int, width: int) -> Bitmaps:
        """``keys`` (ascending, below ``count``) and the numbers that belong to them."""
        sizes = np.bincount(keys, minlength=count)
        dense = sizes * 16 > width
        row = np.cumsum(dense) - 1
        among = dense[keys]
        bits = np.zeros((int(dense.sum()), -(-width // 8)), np.uint8)
        at, n = row[keys[among]], numbers[among].astype(np.int64)
        np.bitwise_or.at(bits, (at, n >> 3), (128 >> (n & 7)).astype(np.uint8))
        return cls(np.where(dense, cls.BITS, sizes).astype(np.uint16), numbers[~among].astype(np.uint16), bits, width)

    def popcounts(self) -> np.ndarray:
        out = self.sizes.astype(np.int64)
        out[self.sizes == self.BITS] = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and their numbers, in no certain order."""
        dense = np.flatnonzero(self.sizes == self.BITS)
        few = np.where(self.sizes == self.BITS, 0, self.sizes)
        row, number = np.nonzero(np.unpackbits(self.bits, axis=1))
        return np.concatenate((np.repeat(np.arange(len(few)), few), dense[row])), np.concatenate((self.numbers.astype(np.int64), number))

    def to_bytes(self) -> bytes:
        head = struct.pack("<4I", len(self.sizes), len(self.numbers), len(self.bits), self.width)
        return head + self.sizes.tobytes() + self.numbers.tobytes() + self.bits.tobytes()

    @classmethod
    def read(cls, raw: bytes, at: int = 0) -> tuple[Bitmaps, int]:
        """The sets that begin at ``at``, and where they end."""
        keys, few, rows, width = struct.unpack_from("<4I", raw, at)
        stride = -(-width // 8)
        a, b = at + 16, at + 16 + 2 * keys
        c = b + 2 * few
        end = c + rows * stride
        bits = np.frombuffer(raw, np.uint8, rows * stride, c).reshape(rows, stride)
        return cls(np.frombuffer(raw, np.uint16, keys, a), np.frombuffer(raw, np.uint16, few, b), bits, width), end


def piece_bytes(model) -> list[bytes]:
    """Bytes that each id of a piece model stands for."""
    names = [model.id_to_piece(n) for n in range(model.get_piece_size())]
    return [bytes([int(x[3:5], 16)]) if model.is_byte(n) else x.replace("▁", " ").encode() for n, x in enumerate(names)]


def aligned(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the groups, and the group of each token, from the byte ends of both kinds of tokens."""
    ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return ends, np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)


def folded(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (group, id), groups ascending, and how often each occurs."""
    both, times = np.unique(group << 32 | ids, return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, times


def links(a_group: np.ndarray, a_ids: np.ndarray, b_group: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair of ids (one 64-bit number) and number of links, for all that share a group."""
    group, a, a_times = folded(a_group, a_ids)
    other, b, b_times = folded(b_group, b_ids)
    first, stop = np.searchsorted(other, group), np.searchsorted(other, group, side="right")
    sizes = stop - first
    ends = np.cumsum(sizes)
    at = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return np.repeat(group, sizes), np.repeat(a, sizes) << 32 | b[at], np.repeat(a_times, sizes) * b_times[at]


class Aligner(PieceTable):
    """What each piece gives: numbers of tokens and groups, its links, and its groups written out."""

    def __init__(self, byte_file: str, piece_file: str, remember: int = PIECES_REMEMBERED):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(byte_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.model = SentencePieceProcessor(model_file=piece_file)
        self.a_bytes, self.b_bytes = Vocabulary(byte_file).bytes_of, piece_bytes(self.model)
        if any(" " in x.lstrip(b" ").decode("utf-8", "replace") or b"\n" in x[1:] for x in self.b_bytes):
            raise ValueError("a piece model with blanks or line breaks inside its pieces cannot be used piece by piece")
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        super().__init__(self._align, remember)

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Everything is forgotten at once."""
        super()._keep([], ids[:0], ends[:1])
        self.tokens = {n: np.zeros(0, np.int64) for n in (*NUMBERS, "odd")}
        self.texts: list[bytes] = []
        self.keys = self.times = np.zeros(0, np.int64)
        self.key_ends = np.zeros(1, np.int64)

    def _align(self, pieces: list[str]) -> list[tuple]:
        # a text begins with a blank that its first piece may not show
        pieces = [x if x[0] in " \n" else f" {x}" for x in pieces]
        raw = [x.encode() for x in pieces]
        a = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        # the model puts a blank before each text: a piece's own, or one that is taken off again
        b = self.model.encode([x[1:] if x[0] == " " else x for x in pieces], num_threads=1)
        b = [ids if x[0] == " " else ids[1:] for x, ids in zip(pieces, b)]
        odd = np.zeros(len(pieces), bool)
        whole = b"".join(raw)
        if any(b"".join(map(known.__getitem__, chain.from_iterable(found))) != whole for known, found in ((self.a_bytes, a), (self.b_bytes, b))):
            for k, x in enumerate(raw):
                if any(b"".join([known[n] for n in found[k]]) != x for known, found in ((self.a_bytes, a), (self.b_bytes, b))):
                    odd[k], a[k], b[k], raw[k] = True, [], [], b""
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends, a_group, b_group = aligned(np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids]))
        piece = np.searchsorted(np.cumsum([len(x) for x in raw]), ends)
        group, keys, times = links(a_group, a_ids, b_group, b_ids)
        order = np.lexsort((keys, piece[group]))
        owner, keys, times = piece[group][order], keys[order], times[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        counted = np.add.reduceat(times, at) if len(at) else times
        self.keys, self.times = np.concatenate((self.keys, keys[at])), np.concatenate((self.times, counted))
        self.key_ends = np.concatenate((self.key_ends, self.key_ends[-1] + np.cumsum(np.bincount(owner[at], minlength=len(pieces)))))
        groups = np.bincount(piece, minlength=len(pieces))
        found = (np.array([len(x) for x in a]), np.array([len(x) for x in b]), groups, np.bincount(owner, times, len(pieces)).astype(np.int64), odd)
        self.tokens = {n: np.concatenate((self.tokens[n], x)) for n, x in zip((*NUMBERS, "odd"), found)}
        self.texts += self._written(a_ids, a_group, b_ids, b_group, groups)
        return [()] * len(pieces)

    @staticmethod
    def _written(a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, groups: np.ndarray) -> Iterator[bytes]:
        count = int(groups.sum())
        a, b = [*map(str, a_ids.tolist())], [*map(str, b_ids.tolist())]
        a_at, b_at = (np.searchsorted(x, np.arange(count + 1)).tolist() for x in (a_group, b_group))
        each = [f"{a[i]}|{b[k]}" if j - i == 1 == m - k else f"{','.join(a[i:j])}|{','.join(b[k:m])}" for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:])]
        ends = np.cumsum(groups).tolist()
        return (";".join(each[i:j]).encode() for i, j in zip([0, *ends], ends))

    def documents(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers per text, digests of the groups, and (pair, text, links) of all texts."""
        filled = [k for k, x in enumerate(texts) if x]
        numbers, counts = self.numbers([f" {texts[k]}" if texts[k][0] in " \n" else texts[k] for k in filled])
        text = np.repeat(np.array(filled, np.int64), counts)
        fine = np.bincount(text, self.tokens["odd"][numbers], len(texts)) == 0
        text, numbers = text[fine[text]], numbers[fine[text]]
        out = {n: np.bincount(text, self.tokens[n][numbers], len(texts)).astype(np.int64) for n in NUMBERS}
        ends = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        each, known = numbers.tolist(), self.texts
        digests = [hashlib.sha256(b";".join([known[n] for n in each[i:j]])).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:])]
        both, times = np.unique(text * len(known) + numbers, return_counts=True) if len(text) else (text, text)
        text, numbers = (both // len(known), both % len(known)) if len(known) else (both, both)
        sizes = self.key_ends[numbers + 1] - self.key_ends[numbers]
        stops = np.cumsum(sizes)
        at = np.repeat(self.key_ends[numbers] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)
        keys, owner, links = self.keys[at], np.repeat(text, sizes), np.repeat(times, sizes) * self.times[at]
        order = np.lexsort((owner, keys))
        keys, owner, links = keys[order], owner[order], links[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        return out, digests, (keys[at], owner[at], np.add.reduceat(links, at) if len(at) else links)


@kept
def _worker(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


def posting(keys: np.ndarray, slots: np.ndarray, times: np.ndarray, width: int) -> tuple[bytes, bytes, bytes]:
    """Packed pairs (``keys`` ascending), their numbers of documents, and their bitmaps with the planes."""
    pairs, number = np.unique(keys, return_inverse=True)
    holds = Bitmaps.of(number, slots, len(pairs), width)
    planes, more, digit = [holds], times - 1, 0
    while (more >> digit).any():
        on = (more >> digit & 1).astype(bool)
        planes.append(Bitmaps.of(number[on], slots[on], len(pairs), width))
        digit += 1
    return pack(pairs), holds.popcounts().astype(np.uint32).tobytes(), b"".join(x.to_bytes() for x in planes)


def _index(batches: Iterator[pa.RecordBatch], byte_file: str, piece_file: str, parts: int, entries: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0) as they are read, and rows of postings (kind 1) when a block is full."""
    table = _worker(byte_file, piece_file)
    block = TaskContext.get().partitionId() << 32
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = used = 0

    def rows(count: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(count, f.type)) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def close() -> Iterator[pa.RecordBatch]:
        keys, slots, times = (np.concatenate(x) for x in zip(*held))
        part = (keys >> 32) * 40_503 % parts
        order = np.lexsort((slots, keys, part))
        keys, slots, times, part = keys[order], slots[order], times[order], part[order]
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                pairs, cards, bitmaps = posting(keys[i:j], slots[i:j], times[i:j], used)
                yield rows(1, kind=[1], block=[block], part=[int(part[i])], pairs=[pairs], cards=[cards], bitmaps=[bitmaps])

    for whole in chunks(batches):
        for at in range(0, whole.num_rows, BLOCK_DOCUMENTS):
            batch = whole.slice(at, BLOCK_DOCUMENTS)
            if held and (size > entries or used + batch.num_rows > BLOCK_DOCUMENTS):
                yield from close()
                held, size, used, block = [], 0, 0, block + 1
            numbers, digests, (keys, owner, times) = table.documents(batch.column("text").to_pylist())
            held.append((keys, owner + used, times))
            size += len(keys)
            slots = np.arange(used, used + batch.num_rows)
            used += batch.num_rows
            yield rows(batch.num_rows, kind=np.zeros(batch.num_rows, int), block=np.full(batch.num_rows, block), slot=slots, doc=batch.column("doc"), groups_sha256=digests, **numbers)
    if held:
        yield from close()


def _sums(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    out = np.zeros(len(keys), np.uint64)
    np.add.at(out, back, np.concatenate([c for _, c in held]))
    return keys, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by part: numbers of documents per pair, and which are the highest of their first id."""

    def settle(part: int, held: list) -> pa.RecordBatch:
        keys, counts = _sums(held)
        first = keys >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        most = np.repeat(np.maximum.reduceat(counts, starts), np.diff([*starts, len(keys)]))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(keys, counts, (counts == most).astype(np.uint64))], pa.binary())], ["part", "totals"])

    held, size, most, now = [], 0, 2_000_000, None
    for batch in batches:
        for part, pairs, cards in zip(*(batch.column(n).to_pylist() for n in ("part", "pairs", "cards"))):
            if part != now and held:
                yield settle(now, held)
                held, size = [], 0
            now = part
            counts = np.frombuffer(cards, np.uint32).astype(np.uint64)
            held.append((*unpack(pairs, 1), counts))
            size += len(counts)
            if size > most:
                held = [_sums(held)]
                size = len(held[0][0])
                most = max(2_000_000, 2 * size)
    if held:
        yield settle(now, held)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by part, its totals first; each block gets the counts of the pairs it holds."""
    keys = counts = best = None
    for batch in batches:
        for part, block, pairs, totals in zip(*(batch.column(n).to_pylist() for n in ("part", "block", "pairs", "totals"))):
            if totals is not None:
                keys, counts, best = unpack(totals, 3)
                continue
            at = np.searchsorted(keys, unpack(pairs, 1)[0])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([pack(counts[at], best[at])], pa.binary())], ["block", "part", "scores"])


def spread(bitmaps: bytes, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document of a block: links whose pair is the best of its first id, and the counts summed over links."""
    holds, at = Bitmaps.read(bitmaps)
    n_best, total = np.zeros(holds.width), np.zeros(holds.width)
    weight = 1
    plane = holds
    while True:
        key, slot = plane.entries()
        n_best += np.bincount(slot, weight * best[key].astype(np.float64), holds.width)
        total += np.bincount(slot, weight * counts[key].astype(np.float64), holds.width)
        if at >= len(bitmaps):
            return n_best.astype(np.int64), total.astype(np.int64)
        weight = 1 if plane is holds else 2 * weight
        plane, at = Bitmaps.read(bitmaps, at)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by block: the scores of its parts, its postings, its documents."""
    now, scores, sums = None, {}, {}
    for batch in batches:
        blocks, kinds, parts = (batch.column(n).to_pylist() for n in ("block", "kind", "part"))
        given, bitmaps = batch.column("scores"), batch.column("bitmaps")
        documents: dict[int, list[int]] = {}
        for row, (block, kind, part) in enumerate(zip(blocks, kinds, parts)):
            if block != now:
                now, scores = block, {}
                sums = {k: v for k, v in sums.items() if k in documents}
            if kind == 0:
                scores[part] = unpack(given[row].as_py(), 2)
            elif kind == 1:
                counts, best = scores.pop(part)
                n_best, total = spread(bitmaps[row].as_py(), counts, best)
                before = sums.get(block)
                sums[block] = (n_best, total) if before is None else (before[0] + n_best, before[1] + total)
            else:
                documents.setdefault(block, []).append(row)
        for block, rows in documents.items():
            part = batch.take(pa.array(rows))
            slots = part.column("slot").to_numpy()
            n_best, total = sums.get(block, (None, None))
            columns = [np.zeros(len(slots), np.int64) if x is None else x[slots] for x in (n_best, total)]
            yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, columns)], ["row", "n_best", "count_sum"])


def align(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Add what the tokens of a byte-level tokenizer (A) and a piece model (B) have in common.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``: tokens of both, groups, linked pairs of
    tokens; ``n_best``: links whose pair is in as many documents as any pair of the same A
    id; ``count_sum``: documents of the pair, summed over links; ``groups_sha256``.

    Null and empty texts, and texts that one tokenizer does not give back byte by byte,
    have zeros and an empty digest. Every row is a document of its own, repeated ones too.
    Other columns stay, null or not; those named like the new ones are replaced.
    """
    spark = docs.sparkSession
    parts = min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in docs.columns if c != text and c.lower() not in COLUMNS]
    docs = docs.select(F.struct(F.lit(0).alias("-"), *others).alias("doc"), F.col(text).cast("string").alias("text"))
    layout = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("part", T.IntegerType())]
        + [T.StructField("doc", docs.schema["doc"].dataType), *[T.StructField(n, T.LongType()) for n in NUMBERS], T.StructField("groups_sha256", T.StringType())]
        + [T.StructField(n, T.BinaryType()) for n in ("pairs", "cards", "bitmaps")]
    )
    index = partial(_index, byte_file=byte_file, piece_file=piece_file, parts=parts, entries=block_entries, schema=to_arrow_schema(layout))
    stored = materialize(docs.mapInArrow(index, layout))
    postings = stored.where("kind = 1")
    counted = postings.select("part", "pairs", "cards").repartition("part").sortWithinPartitions("part").mapInArrow(_count, "part int, totals binary")
    asked = postings.select("part", "block", "pairs", F.lit(None).cast("binary").alias("totals"))
    totals = counted.select("part", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("pairs"), "totals")
    scores = totals.unionByName(asked).repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_first()).mapInArrow(_answer, "block long, part int, scores binary")
    none = {"kind": "int", "part": "int", "slot": "int", "scores": "binary", "bitmaps": "binary"}
    row = F.struct("doc", *NUMBERS, "groups_sha256").alias("row")
    kind = layout["doc"].dataType, T.StructType([layout[n] for n in ("doc", *NUMBERS, "groups_sha256")])

    def side(df: DataFrame, number: int, *columns) -> DataFrame:
        found = df.select("block", F.lit(number).alias("kind"), *columns)
        missing = {n: F.lit(None).cast(t) for n, t in none.items() if n not in found.columns}
        if "row" not in found.columns:
            missing["row"] = F.lit(None).cast(kind[1])
        return found.withColumns(missing).select("block", *none, "row")

    together = side(scores, 0, "part", "scores").unionByName(side(postings, 1, "part", "bitmaps")).unionByName(side(stored.where("kind = 0"), 2, "slot", row))
    output = T.StructType([T.StructField("row", kind[1]), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    done = together.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_score, output)
    return done.select(*[F.col("row.doc").getField(c).alias(c) for c in others], *[f"row.{n}" for n in NUMBERS], "n_best", "count_sum", "row.groups_sha256")
