"""The row-wise operators on a stream.

Batch and stream share the same projections and predicates; these helpers only
wire them to a file source and a file sink. Operators that vote, rank or count
over a whole table are batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tableprobe.operators.typing import replace_infinities, sanitize_tokens


def clean_rows(df: DataFrame) -> DataFrame:
    """Placeholder text and infinities to null."""
    return replace_infinities(sanitize_tokens(df))


def run_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    step: Callable[[DataFrame], DataFrame] = clean_rows,
    fmt: str = "parquet",
):
    """Process every new file once and stop; progress is kept in the checkpoint folder."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = (
        step(stream)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
