"""The numbers behind charts: histograms, box statistics, top values, point frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import as_number, col, is_floating, no_nan
from tableprobe.plans.frequency import column_quantiles, quantiles_of_counts
from tableprobe.plans.ordered import size_bound


def _number(df: DataFrame, name: str):
    return as_number(col(name), df.schema[name].dataType)


def _bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """1 to ``bins``: the whole widths between ``lo`` and the value, the last bin closed.

    Counted in widths, as the bins' edges are. ``width_bucket`` scales the value first and
    rounds otherwise, which puts values next to an edge into the neighbouring bin.
    """
    return F.least(F.floor(F.try_divide(x - F.lit(lo), F.lit((hi - lo) / bins))), F.lit(bins - 1).cast("bigint")) + 1


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) over equal widths from minimum to maximum, last bin closed.

    Every bin is listed, empty ones with zero.
    """
    if not 5 <= bins <= 100:
        raise ValueError("Use 5 to 100 bins.")
    x = _number(df, column)
    got = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    spark = df.sparkSession
    if got["lo"] is None:
        return spark.range(0).selectExpr("id AS bin", "cast(null as double) AS low", "cast(null as double) AS high", "id AS n")
    lo, hi = float(got["lo"]), float(got["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    number = _bin(x, lo, hi, bins)
    counts = df.where(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Every bin enters once with nothing in it; adding up replaces a join.
    listed = spark.range(1, bins + 1).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("n"))
    return listed.unionByName(counts).groupBy("bin").agg(F.sum("n").alias("n")).select(
        "bin",
        (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("high"),
        "n",
    )


def center(df: DataFrame, column: str) -> DataFrame:
    """One row: mean and median, drawn beside a histogram."""
    median = column_quantiles(df, [column], [0.5])[column][0]
    return df.agg(F.avg(_number(df, column)).alias("mean")).withColumn("median", F.lit(median).cast("double"))


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: quartiles, whiskers at the furthest values within reach, fliers beyond."""
    x = _number(df, column)
    q1, q2, q3 = column_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    lo, hi = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    lower, upper = F.lit(lo).cast("double"), F.lit(hi).cast("double")
    return df.agg(
        F.count(x).alias("n"),
        F.lit(q1).cast("double").alias("q1"),
        F.lit(q2).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(x >= lower, x)).alias("whisker_low"),
        F.max(F.when(x <= upper, x)).alias("whisker_high"),
        F.count_if((x < lower) | (x > upper)).alias("fliers"),
    )


def grouped_box_stats(df: DataFrame, category: str, column: str) -> DataFrame:
    """Box statistics of every category.

    Values are counted per category first: the counts feed both the quartiles and
    the whiskers, and a category with a third of all rows is already folded to its
    distinct values, ranked across tasks when it is still too large for one.
    """
    pairs = df.select(col(category).alias("category"), (_number(df, column) + F.lit(0.0)).alias("value")).dropna()
    counts = pairs.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))
    quartiles = quantiles_of_counts(counts, ["category"], [0.25, 0.5, 0.75], size_bound(df)).select(
        "category", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v, n = F.col("value"), F.col("n")
    near_low, near_high = v >= F.col("q1") - reach, v <= F.col("q3") + reach
    return (
        counts.join(quartiles, "category")
        .groupBy("category", "q1", "median", "q3")
        .agg(
            F.sum(n).alias("n"),
            F.min(F.when(near_low, v)).alias("whisker_low"),
            F.max(F.when(near_high, v)).alias("whisker_high"),
            F.sum(F.when(near_low & near_high, F.lit(0)).otherwise(n)).alias("fliers"),
        )
        .select("category", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "fliers")
    )


def top_n_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(value, n): the most frequent values as text, ties by value."""
    if not 3 <= n <= 30:
        raise ValueError("Ask for 3 to 30 values.")
    value = no_nan(col(column)) if is_floating(df.schema[column].dataType) else col(column)
    counts = df.select(value.cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(n)


def scatter_frame(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """(x, y, color) for the rows where both coordinates are present."""
    out = [_number(df, x).alias("x"), _number(df, y).alias("y")]
    return df.select(*out, *([col(color).alias("color")] if color else [])).dropna(subset=["x", "y"])


def binned_scatter(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """(x_bin, y_bin, n): the same picture as counts on a grid, for tables too large to draw."""
    points = scatter_frame(df, x, y)
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()

    def cell(name, lo, hi):
        if lo is None or lo == hi:
            return F.lit(1).cast("bigint")
        return _bin(F.col(name), float(lo), float(hi), bins)

    return points.groupBy(cell("x", b["x0"], b["x1"]).alias("x_bin"), cell("y", b["y0"], b["y1"]).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
