"""Small helpers for the functions that Spark runs on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

Run = Callable[..., Iterator[pa.RecordBatch]]

#: What a worker keeps between tasks, by the module that it is kept for.
_KEPT: dict[str, list[dict]] = {}


def kept(make: Callable) -> Callable:
    """``functools.cache`` for what tasks of one module share; a worker drops it when a ``tidy`` task of another one begins."""
    made: dict[tuple, object] = {}
    _KEPT.setdefault(make.__module__, []).append(made)

    @wraps(make)
    def inner(*key):
        if key not in made:
            made[key] = make(*key)
        return made[key]

    return inner


def _drop_others(module: str) -> None:
    others = [made for name, all_made in _KEPT.items() if name != module for made in all_made if made]
    for made in others:
        made.clear()
    if others:
        gc.collect()


def tidy(run: Run) -> Run:
    """``run`` drops what other modules' tasks left in its worker, and gives freed memory back when its
    task ends; workers live on, and later stages need the room."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch], *args, **options) -> Iterator[pa.RecordBatch]:
        _drop_others(run.__module__)
        try:
            yield from run(batches, *args, **options)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU C library
            if trim:
                trim(0)

    return inner


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row starts in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about ``size`` bytes of text, so memory follows the slice. A longer text is a slice of its own."""
    for batch in batches:
        _, ends = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[row] + size, side="right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of ``lengths`` values each."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
