"""Running values over a global order, without putting the order in one task.

A window with no partition sorts the whole table in a single task, and a window
over fixed time slices breaks when one slice holds most of the rows. Here Spark
partitions the rows by range of their full order key; the number of the partition
becomes the chunk, or begins the numbers of its chunks if somebody wants small ones.
It is stored with the row once, and each chunk is one window partition. What a chunk
needs from the chunks before it is one row per chunk (and for the groups that reach over
its two edges), and is broadcast. Range partitioning samples keys to balance chunks; this
never changes results. It is one plan at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.columns import col
from tableprobe.plans.storage import materialize

ROWS_PER_CHUNK = 2_000_000
CHUNK = "__chunk"


def chunk_rows(df: DataFrame, rows_per_chunk: int | None) -> int:
    """Rows one task may order on its own."""
    return _wanted_rows(df, rows_per_chunk) or ROWS_PER_CHUNK


def _wanted_rows(df: DataFrame, rows_per_chunk: int | None) -> int | None:
    """Rows per chunk, if somebody asks for a number."""
    asked = rows_per_chunk or df.sparkSession.conf.get("tableprobe.rowsPerChunk", None)
    return int(asked) if asked else None


def chunk_by_range(df: DataFrame, keys: Sequence[str], rows_per_chunk: int | None = None) -> DataFrame:
    """The rows with the number of their range of keys, stored.

    There are as many ranges as shuffle partitions, fewer where Spark puts small ones
    together. A wanted number of rows per chunk cuts each range further, along its own
    order, so that the number of tasks and of stored files does not grow with the chunks.
    """
    order = [col(k) for k in keys]
    limit = _wanted_rows(df, rows_per_chunk)
    ranged = df.repartitionByRange(*order)
    if limit is None:
        return materialize(ranged.withColumn(CHUNK, F.spark_partition_id()))
    # numbers rise along a sorted partition, and from one partition to the next
    placed = ranged.sortWithinPartitions(*order).withColumn(CHUNK, F.monotonically_increasing_id())
    at = F.lit((1 << 33) - 1)
    return materialize(placed.withColumn(CHUNK, col(CHUNK) - col(CHUNK).bitwiseAND(at) % limit))


def running(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    last: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    descending: bool = False,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Add running values along ``order`` inside each ``by`` group.

    ``sums``      output -> column: sum of all rows up to and including this one
    ``last``      output -> column: newest non-null value, this row included
    ``previous``  output -> column: newest non-null value, this row excluded

    Callers collapse rows with equal keys beforehand, so that a key shared by very
    many rows is one row here. What ``chunk_by_range`` gave for the same keys is not
    dealt out again, so several passes share one stored table. Null keys come first; an empty table stays empty.
    """
    sums, last, previous = dict(sums or {}), dict(last or {}), dict(previous or {})
    chunked = df if CHUNK in df.columns else chunk_by_range(df, [*by, *order], rows_per_chunk)

    inside = _window([*by, CHUNK], order, descending)
    detail = _apply(chunked, inside, sums, last, previous)

    # A chunk passes something on only within a group that reaches over one of its
    # edges, which is its first or its last: two groups per chunk, whatever their number.
    edge_rows = chunked
    if by:
        group = F.struct(*[col(b).alias(f"k{i}") for i, b in enumerate(by)])
        ends = chunked.groupBy(col(CHUNK).alias("__of")).agg(F.min(group).alias("__first"), F.max(group).alias("__last"))
        # One row per chunk.
        edge_rows = chunked.join(F.broadcast(ends), col(CHUNK) == F.col("__of")).where(group.eqNullSafe(F.col("__first")) | group.eqNullSafe(F.col("__last")))
    pick = F.min_by if descending else F.max_by
    rank = F.struct(*[col(o) for o in order])
    held = [F.sum(c).alias(f"__s_{o}") for o, c in sums.items()]
    held += [
        pick(col(c), F.when(col(c).isNotNull(), rank)).alias(f"__l_{o}")
        for o, c in {**last, **previous}.items()
    ]
    summary = edge_rows.groupBy(*by, CHUNK).agg(*held)
    before = Window.partitionBy(*by).orderBy(F.desc(CHUNK) if descending else F.asc(CHUNK))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        summary.select(
            *[col(b).alias(f"__by{i}") for i, b in enumerate(by)],
            col(CHUNK).alias("__at"),
            F.row_number().over(before).alias("__nth"),
            *[F.sum(f"__s_{o}").over(earlier).alias(f"__s_{o}") for o in sums],
            *[F.last(f"__l_{o}", ignorenulls=True).over(earlier).alias(f"__l_{o}") for o in {**last, **previous}],
        )
        .where("__nth > 1")
        .drop("__nth")
    )
    match = col(CHUNK) == col("__at")
    for i, b in enumerate(by):
        match = match & col(b).eqNullSafe(col(f"__by{i}"))
    # Bounded: one row per chunk that continues a group.
    joined = detail.join(F.broadcast(carry), match, "left")
    return joined.select(
        *[col(c) for c in df.columns if c != CHUNK],
        *[(col(o) + F.coalesce(col(f"__s_{o}"), F.lit(0))).alias(o) for o in sums],
        *[F.coalesce(col(o), col(f"__l_{o}")).alias(o) for o in {**last, **previous}],
    )


def _window(by: Sequence[str], order: Sequence[str], descending: bool):
    keys = [col(o).desc() if descending else col(o).asc() for o in order]
    return Window.partitionBy(*[col(b) for b in by]).orderBy(*keys)


def _apply(df, window, sums, last, previous):
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        *[F.sum(col(c)).over(upto).alias(o) for o, c in sums.items()],
        *[F.last(col(c), ignorenulls=True).over(upto).alias(o) for o, c in last.items()],
        *[F.last(col(c), ignorenulls=True).over(before).alias(o) for o, c in previous.items()],
    )


def size_bound(df: DataFrame) -> int:
    """Row count of an input."""
    return df.count()
