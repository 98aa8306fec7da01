"""Which (owner, key) pairs have a key that another owner has too.

Used to find what repeats in a corpus before anything heavy is done: keys are 64-bit
hashes of shingles or anchors, owners are documents. Pairs are packed into binary
runs and dealt out by ranges of the key, so a pair costs about ten bytes of shuffle.

Hot keys never meet in one task. Each task first folds its own pairs: of a key that
it saw with several owners, all pairs are known to recur there and then, and only one
goes on to stand for the key. A key that a third of all documents hold thus costs
one pair for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.arrow import tidy

#: Pairs that a task gathers before it folds and sends them.
FOLD_PAIRS = 1_500_000

Keys = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]


def pack(*columns: np.ndarray) -> bytes:
    """64-bit columns byte plane by byte plane, which compresses well."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), 8).T.tobytes() for c in columns)


def unpack(raw: bytes, count: int) -> list[np.ndarray]:
    planes = np.frombuffer(raw, np.uint8).reshape(count, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]


def fold(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs ordered by key, and which of them have a key with several owners."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new_key = np.ones(len(keys), bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new = new_key.copy()
    new[1:] |= owners[1:] != owners[:-1]
    keys, owners, new_key = keys[new], owners[new], new_key[new]
    group = np.cumsum(new_key) - 1
    return keys, owners, (np.bincount(group)[group] > 1) if len(keys) else np.zeros(0, bool)


def _rows(kind: int, part: np.ndarray, keys: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(part, kind="stable")
    part, keys, owners = part[order], keys[order], owners[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for k, o, p in zip(np.split(keys, cuts), np.split(owners, cuts), part[np.concatenate(([0], cuts))] if len(part) else []):
        yield kind, int(p), pack(k, o)


@tidy
def _send(batches: Iterator[pa.RecordBatch], pairs: Keys, parts: int) -> Iterator[pa.RecordBatch]:
    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, owners, several = fold(np.concatenate([k for k, _ in held]), np.concatenate([o for _, o in held]))
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        known = several & ~first
        rows = [*_rows(0, keys[~known] % np.uint64(parts), keys[~known], owners[~known])]
        # the one that stands for the key still has to learn that it recurs
        known = several
        rows += _rows(1, owners[known] % np.uint64(parts), keys[known], owners[known])
        kinds, part, packed = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(part, pa.int64()), pa.array(packed, pa.binary())], ["kind", "part", "packed"])

    held, size = [], 0
    for keys, owners in pairs(batches):
        held.append((keys, owners))
        size += len(keys)
        if size > FOLD_PAIRS:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


@tidy
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by part; each part is settled when it is complete."""

    def out(keys: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 100_000):
            stop = at + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(owners[at:stop].view(np.int64)), pa.array(keys[at:stop].view(np.int64))], ["owner", "key"])

    def settle(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [unpack(x, 2) for x in held]
        keys, owners, several = fold(np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns]))
        yield from out(keys[several], owners[several])

    held, now = [], None
    for batch in batches:
        for kind, part, packed in zip(*(batch.column(n).to_pylist() for n in ("kind", "part", "packed"))):
            if kind == 1:
                keys, owners = unpack(packed, 2)
                yield from out(keys, owners)
                continue
            if part != now and held:
                yield from settle(held)
                held = []
            now = part
            held.append(packed)
    if held:
        yield from settle(held)


def parts_for(df: DataFrame, pairs: float, each: int = 400_000) -> int:
    """So many parts that each holds about ``each`` pairs, and at least a few for every task."""
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / each)) | 1


def recurring(df: DataFrame, pairs: Keys, parts: int) -> DataFrame:
    """``owner, key`` of every pair whose key has two owners or more.

    ``pairs`` runs in a task over the rows of ``df`` and yields arrays of keys and
    owners (both uint64). Some rows come twice; callers use them as sets.
    """
    sent = df.mapInArrow(partial(_send, pairs=pairs, parts=parts), "kind int, part long, packed binary")
    return sent.repartition("part").sortWithinPartitions("kind", "part").mapInArrow(_meet, "owner long, key long")


def grouped(found: DataFrame, name: str) -> DataFrame:
    """One row per owner with its recurring keys as a set."""
    return found.groupBy("owner").agg(F.collect_set("key").alias(name))
