"""Centred co-moments of pairs of columns: matrices per batch, merged row by row.

A batch of rows becomes a matrix of values and one of presence, and a few matrix
products give the moments of all pairs at once. A task merges its batches and passes
on one row for each first column, whatever the number of rows; these rows are dealt
out by that column, so that no task merges the whole matrix of a wide table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a batch that are worked on at once.
CELLS = 1_000_000

#: n rows with both, means, squared deviations and the product of deviations.
MOMENTS = ("n", "mx", "my", "sxx", "syy", "sxy")
STATE = "i int, outside bigint, " + ", ".join(f"{m} array<double>" for m in MOMENTS)

State = tuple[np.ndarray, ...]
#: Lowest and highest value that is not outside; None without values.
Fence = tuple[float | None, float | None] | None


def merged(a: State, b: State) -> State:
    """Moments of both parts together; differences of means keep it free of cancellation."""
    n = a[0] + b[0]
    whole = np.maximum(n, 1)
    share, weight = b[0] / whole, a[0] * b[0] / whole
    dx, dy = b[1] - a[1], b[2] - a[2]
    # a side without rows has no mean of its own
    mx = np.where(a[0] == 0, b[1], a[1] + np.where(b[0] == 0, 0.0, dx * share))
    my = np.where(a[0] == 0, b[2], a[2] + np.where(b[0] == 0, 0.0, dy * share))
    both = weight > 0
    dx, dy = np.where(both, dx, 0.0), np.where(both, dy, 0.0)
    return n, mx, my, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight


def batch_moments(x: np.ndarray, firsts: Sequence[int], seconds: Sequence[int]) -> State:
    """Moments of each of ``firsts`` with each of ``seconds`` over the rows of ``x`` (NaN: missing) where both are present."""
    here = ~np.isnan(x)
    # From the first value, then from the mean of what is left: a constant column is zero, not almost zero.
    start = x[here.argmax(axis=0), np.arange(x.shape[1])]
    start = np.where(np.isnan(start), 0.0, start)
    z = np.where(here, x - start, 0.0)
    shift = z.sum(axis=0) / np.maximum(here.sum(axis=0), 1)
    z = np.where(here, z - shift, 0.0)
    centre = start + shift
    m = here.astype(float)
    zl, zr, ml, mr = z[:, firsts], z[:, seconds], m[:, firsts], m[:, seconds]
    n = ml.T @ mr
    rows = np.maximum(n, 1)
    sx, sy = zl.T @ mr, ml.T @ zr
    rawx, rawy = (zl * zl).T @ mr, ml.T @ (zr * zr)
    mx, my = centre[firsts][:, None] + sx / rows, centre[seconds][None, :] + sy / rows
    sxx, syy, sxy = rawx - sx * sx / rows, rawy - sy * sy / rows, zl.T @ zr - sx * sy / rows
    # Where one column hides nearly all spread of the other, the difference holds only rounding.
    doubt = ((rawx > 0) & (sxx <= 1e-9 * rawx)) | ((rawy > 0) & (syy <= 1e-9 * rawy))
    for i, j in zip(*np.nonzero(doubt)):
        both = here[:, firsts[i]] & here[:, seconds[j]]
        a, b = x[both, firsts[i]], x[both, seconds[j]]
        if len(a) == 0:
            continue
        u, v = a - a[0], b - b[0]
        mx[i, j], my[i, j] = a[0] + u.mean(), b[0] + v.mean()
        u, v = u - u.mean(), v - v.mean()
        sxx[i, j], syy[i, j], sxy[i, j] = u @ u, v @ v, u @ v
    return n, mx, my, np.maximum(sxx, 0.0), np.maximum(syy, 0.0), sxy


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(width)]
    return np.column_stack(columns).astype(float) if columns else np.empty((batch.num_rows, 0))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield _matrix(batch.slice(at, step), width)


def _states(found: dict[int, State], outside: dict[int, int]) -> pa.RecordBatch:
    keys = sorted(found)
    lists = [pa.array([found[k][at].tolist() for k in keys], pa.list_(pa.float64())) for at in range(len(MOMENTS))]
    apart = pa.array([outside[k] for k in keys], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), apart, *lists], names=["i", "outside", *MOMENTS])


def moment_states(df: DataFrame, values: Sequence[Column], target: bool = False, fences: Sequence[Fence] | None = None) -> DataFrame:
    """What each task knows of its rows: one row for each column, moments with all later columns (or the last).

    ``outside`` counts its values below or above its fence, in the same pass.
    """
    width = len(values)
    firsts = list(range(width))
    seconds = [width - 1] if target else firsts
    low, high = (np.array([math.nan if f is None or f[side] is None else f[side] for f in fences or [None] * width], float) for side in (0, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: State | None = None
        apart = np.zeros(width, np.int64)
        with np.errstate(all="ignore"):
            for x in _slices(batches, width):
                part = batch_moments(x, firsts, seconds)
                total = part if total is None else merged(total, part)
                apart += ((x < low) | (x > high)).sum(axis=0)
        if total is not None:
            yield _states({i: tuple(m[i, 0 if target else i + 1 :] for m in total) for i in firsts}, dict(enumerate(apart.tolist())))

    return df.select(*[v.cast("double").alias(f"c{k}") for k, v in enumerate(values)]).mapInArrow(measure, STATE)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, State] = {}
    outside: dict[int, int] = {}
    with np.errstate(all="ignore"):
        for batch in batches:
            for at, (i, apart) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                part = tuple(batch.column(c + 2)[at].values.to_numpy(zero_copy_only=False) for c in range(len(MOMENTS)))
                found[i] = merged(found[i], part) if i in found else part
                outside[i] = outside.get(i, 0) + apart
    if found:
        yield _states(found, outside)


def column_states(df: DataFrame, values: Sequence[Column], target: bool = False, fences: Sequence[Fence] | None = None) -> DataFrame:
    """The moments of all rows together, a row for each column; none for an empty table."""
    return moment_states(df, values, target, fences).repartition("i").mapInArrow(_together, STATE)


def correlations_of(states: DataFrame, last: int | None = None) -> DataFrame:
    """(i, j, n, r) from such rows; ``last`` is the place of the target, if there is one."""
    pairs = states.select("i", F.posexplode(F.arrays_zip("n", "sxx", "syy", "sxy")).alias("at", "s"))
    second = F.col("i") + F.col("at") + 1 if last is None else F.lit(last)
    r = F.try_divide(F.col("s.sxy"), F.sqrt("s.sxx") * F.sqrt("s.syy"))
    out = pairs.select("i", second.cast("int").alias("j"), F.col("s.n").cast("bigint").alias("n"), r.alias("r"))
    return out if last is None else out.where(F.col("i") != last)


def pair_correlations(df: DataFrame, values: Sequence[Column], target: bool = False) -> DataFrame:
    """(i, j, n, r) for the places i < j of ``values``, or of each with the last one if that is the ``target``.

    Over the ``n`` rows where both are present; ``r`` is null where one side is constant
    or there are none. An empty table gives no row.
    """
    return correlations_of(column_states(df, values, target), len(values) - 1 if target else None)
