"""The few smallest different texts per column, folded in every task before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kept_per_task(values: DataFrame, k: int) -> DataFrame:
    """Of (column, value) what each task passes on: its ``k`` smallest different values of every column."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, list[str]] = {}
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for name in pc.unique(names).to_pylist():
                found = pc.unique(texts.filter(pc.equal(names, name)).drop_null())
                few = found if len(found) <= k else found.take(pc.select_k_unstable(found, k, sort_keys=[("text", "ascending")]))
                least[name] = sorted({*least.get(name, ()), *few.to_pylist()})[:k]
        pairs = [(name, v) for name, texts in least.items() for v in texts]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs)], names=["column", "value"])

    return values.select("column", "value").mapInArrow(fold, "column string, value string")


def smallest_values(values: DataFrame, k: int) -> DataFrame:
    """(column, values): the ``k`` smallest different texts of each column in order; nulls do not count.

    At most ``k`` values per column and task travel, however many there are and however
    often one is repeated.
    """
    if k <= 0:
        return values.select("column", F.array().cast("array<string>").alias("values")).distinct()
    place = Window.partitionBy("column").orderBy("value")
    return (
        kept_per_task(values, k)
        .groupBy("column", "value")
        .agg(F.lit(1).alias("one"))
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= k)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list("value")).alias("values"))
    )
