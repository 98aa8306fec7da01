"""Examples of rejected texts: the smallest ones, bounded in every task."""

import random

from pyspark.sql import functions as F

from tableprobe.operators.typing import numeric_convertibility
from tableprobe.plans.smallest import kept_per_task, smallest_values


def test_equals_sorting_everything(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["", "é", "\U0001f600", "Z", "z", "zz", "￿"]) + str(rng.randrange(60))) for _ in range(3_000)]
    rows += [("hot", "same")] * 2_000 + [("none", None)]
    df = spark.createDataFrame(rows, "column string, value string").repartition(7)
    got = {r["column"]: r["values"] for r in smallest_values(df, 4).collect()}
    plain = {c: sorted({v for k, v in rows if k == c and v is not None}, key=lambda v: v.encode())[:4] for c in ("a", "b", "hot")}
    assert got == plain


def test_few_values_leave_a_task(spark):
    df = spark.range(10_000).select(F.lit("c").alias("column"), F.sha2(F.col("id").cast("string"), 256).alias("value")).repartition(6)
    assert kept_per_task(df, 5).count() == 5 * 6
    assert smallest_values(df.where(F.lit(False)), 5).count() == 0


def test_convertibility_examples(spark):
    df = spark.range(200).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("bad "), F.col("id") % 70)).otherwise(F.col("id").cast("string")).alias("x.y"),
        F.lit(None).cast("string").alias("empty"),
    )
    rows = {r["column"]: r for r in numeric_convertibility(df, examples=3).collect()}
    assert rows["x.y"]["invalid_examples"] == ["bad 0", "bad 10", "bad 20"] and rows["x.y"]["invalid"] == 20
    assert rows["empty"]["invalid_examples"] == []
    assert all(r["invalid_examples"] == [] for r in numeric_convertibility(df, examples=0).collect())
