"""Connected components of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.plans.storage import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that can be reached, for every end of a link ``a, b``.

    Each round gives a node the smallest label of its neighbours and then the label of
    that label, so the number of rounds grows with the logarithm of the longest path.
    Minima are folded before the shuffle, so a node with many links is no hot spot.
    Every round is written to the shared folder.
    """
    both = materialize(
        links.select("a", "b").where(F.col("a") != F.col("b")).distinct().select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialize(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = step.where(F.col("old") != F.col("label")).limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
