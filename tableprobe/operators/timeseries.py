"""Series over time: rolling windows, resampling, trend, extremes, steps, seasonality.

Rows with equal (time, value) are folded to one row with a weight before anything
is ordered, and the order is cut into balanced chunks, so neither a burst of rows
nor a value repeated very often ends up in one task. Rows at one time are ordered
by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.columns import as_number, col, is_numeric, is_time
from tableprobe.functions.frames import report_frame
from tableprobe.functions.dates import to_timestamp
from tableprobe.functions.text import parse_number, strip
from tableprobe.plans.frequency import column_quantiles
from tableprobe.plans.ordered import chunk_by_range, running
from tableprobe.plans.storage import materialize

LAGS = (7, 12, 24, 30)  # fixed values
AXIS_RATIO = 10.0

# The resampling steps on offer, in microseconds.
STEPS = {
    "5min": 300_000_000,
    "15min": 900_000_000,
    "30min": 1_800_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}
AGGREGATES = ("mean", "sum", "count", "std")


def _time(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if is_time(dtype):
        return col(name).cast("timestamp")
    return to_timestamp(col(name).cast("string"))


def _value(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if is_numeric(dtype):
        return as_number(col(name), dtype)
    return as_number(parse_number(strip(col(name).cast("string"))), T.DoubleType())


def prepare_series(df: DataFrame, time: str, value: str, ordered: bool = True) -> DataFrame:
    """(time, value) with both present, sorted by time."""
    out = df.select(_time(df, time).alias(time), _value(df, value).alias(value)).dropna()
    return out.orderBy(col(time)) if ordered else out


# --------------------------------------------------------------------- rolling


def rolling(
    df: DataFrame, time: str, value: str, seconds: float, aggregate: str = "mean", output: str | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Add the aggregate of the values in (t - seconds, t] to each row that has a value.

    Time is cut into slots as long as the window. A window is then the end of one slot
    and the beginning of the next: a running total backwards in the one and forwards in
    the other. The cost does not grow with the rows in a window, and no total ever holds
    a value outside the window's two slots, so a large value leaves nothing behind.
    Spreads are measured from each slot's median and merged by means and squared
    distances. Rows at the same time see each other.
    """
    if aggregate not in AGGREGATES:
        raise ValueError(f"Use one of {AGGREGATES}.")
    output = output or f"rolling_{aggregate}"
    width = int(round(seconds * 1_000_000))
    if width <= 0:
        raise ValueError("The window must be longer than zero.")
    t, v = _time(df, time), _value(df, value)
    rows = df.where(t.isNotNull() & v.isNotNull())
    us = F.unix_micros(t)
    values = rows.select(us.alias("t"), v.alias("v")).withColumn("slot", F.expr(f"t div {width} - if(t % {width} < 0, 1, 0)"))
    if aggregate == "std":
        # spreads need a centre for each slot, other aggregates do not
        middles = values.groupBy("slot").agg(F.percentile_approx("v", 0.5, 100).alias("c"))
        d = F.col("v") - F.col("c")
        events = values.join(middles, "slot").groupBy("slot", "t", "c").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"))
        parts = ["n", "s", "q"]
    else:
        events = values.groupBy("slot", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("x"))
        parts = ["n", "x"]
    sums = {f"w{c}": c for c in parts}
    kept = ["c", *parts] if aggregate == "std" else parts
    # a window that ends at t begins after t - width, in the slot before; at that time nothing is added
    zero = [F.lit(None if c == "c" else 0).cast("bigint" if c == "n" else "double").alias(c) for c in kept]
    begins = events.select((F.col("slot") - 1).alias("slot"), (F.col("t") - width).alias("t"), F.lit(1).alias("begin"), *zero)
    marked = events.select("slot", "t", F.lit(0).alias("begin"), *kept).unionByName(begins)
    # stored once, then totalled along both directions
    marked = chunk_by_range(marked, ["slot", "t", "begin"], rows_per_chunk)
    ahead = running(marked, order=["t", "begin"], by=["slot"], sums=sums).where("begin = 0").select("slot", "t", *kept[: len(kept) - len(parts)], *sums)
    back = running(marked, order=["t", "begin"], by=["slot"], sums=sums, descending=True)
    earlier = back.where("begin = 1").select((F.col("slot") + 1).alias("slot"), (F.col("t") + width).alias("t"), *[F.col(f"w{c}").alias(f"e{c}") for c in parts])
    both = ahead.join(earlier, ["slot", "t"])
    n = (F.col("wn") + F.col("en")).cast("double")
    if aggregate == "std":
        both = both.join(marked.where("begin = 0").groupBy((F.col("slot") + 1).alias("slot")).agg(F.max("c").alias("ec")), "slot", "left")

        def spread(n: str, s: str, q: str) -> Column:
            return F.greatest(F.lit(0.0), F.col(q) - F.coalesce(F.try_divide(F.col(s) * F.col(s), F.col(n)), F.lit(0.0)))

        apart = (F.col("c") + F.col("ws") / F.col("wn")) - (F.col("ec") + F.try_divide(F.col("es"), F.col("en")))
        between = F.coalesce(apart * apart * F.col("wn") * F.col("en") / n, F.lit(0.0))
        squares = spread("wn", "ws", "wq") + spread("en", "es", "eq") + between
        result = F.when(n >= 2, F.sqrt(squares / F.greatest(F.lit(1.0), n - 1)))
    elif aggregate == "count":
        result = F.col("wn") + F.col("en")
    else:
        total = F.col("wx") + F.col("ex")
        result = total / n if aggregate == "mean" else total
    lookup = both.select(F.col("t").alias("__t"), result.alias("__out"))
    return rows.join(lookup, us == F.col("__t")).select(*[col(c) for c in df.columns], F.col("__out").alias(output))


# ------------------------------------------------------------------ resampling


def resample(
    df: DataFrame, time: str, values: Sequence[str], step: str | None, aggregate: str | None = "mean"
) -> DataFrame:
    """Aggregate per time step; steps without rows between first and last are listed too.

    mean and std are null there, sum and count zero. Without a step or an aggregate
    the raw rows come back in time order.
    """
    t = _time(df, time)
    work = df.select(t.alias(time), *[_value(df, v).alias(v) for v in values]).where(col(time).isNotNull())
    if not step or not aggregate:
        return work.orderBy(col(time))
    if aggregate not in AGGREGATES:
        raise ValueError(f"Use one of {AGGREGATES}.")
    if step == "month":
        slot = F.year(col(time)).cast("bigint") * 12 + F.month(col(time)) - 1
        start = F.make_timestamp(
            F.floor(F.col("slot") / 12).cast("int"), (F.pmod(F.col("slot"), F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
        )
    elif step in STEPS:
        us = F.unix_micros(col(time))
        slot = ((us - F.pmod(us, F.lit(STEPS[step]))) / F.lit(STEPS[step])).cast("bigint")
        start = F.timestamp_micros(F.col("slot") * F.lit(STEPS[step]))
    else:
        raise ValueError(f"Unknown step {step!r}.")
    build = {"mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp}[aggregate]
    filled = work.groupBy(slot.alias("slot")).agg(*[build(col(v)).alias(v) for v in values])
    edge = work.agg(F.min(slot).alias("lo"), F.max(slot).alias("hi")).first()
    spark = df.sparkSession
    # The steps come from a distributed range, so a wide span is not built in one task.
    spine = spark.range(0) if edge["lo"] is None else spark.range(edge["lo"], edge["hi"] + 1)
    spine = spine.withColumnRenamed("id", "slot")
    empty = {"sum": F.lit(0.0), "count": F.lit(0)}.get(aggregate)
    out = [F.coalesce(col(v), empty).alias(v) if empty is not None else col(v) for v in values]
    return spine.join(filled, "slot", "left").select(start.alias(time), *out)


def scale_groups(df: DataFrame, values: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split series for two axes when their typical sizes differ more than tenfold."""
    sizes = df.select(*[F.abs(_value(df, v)).alias(v) for v in values])
    medians = {c: q[0] for c, q in column_quantiles(sizes, list(values), [0.5]).items() if q[0]}
    if len(medians) < 2 or max(medians.values()) / min(medians.values()) <= AXIS_RATIO:
        return list(values), []
    cut = (max(medians.values()) * min(medians.values())) ** 0.5
    first = [v for v in values if medians.get(v, cut) <= cut]
    second = [v for v in values if v not in first]
    return (first, second) if first and second else (list(values), [])


# ----------------------------------------------------------------------- trend


def _runs(df: DataFrame, time: str, value: str) -> DataFrame:
    """(t, v, c): distinct points with how often each occurs."""
    points = df.select(F.unix_micros(_time(df, time)).alias("t"), (_value(df, value) + F.lit(0.0)).alias("v")).dropna()
    return points.groupBy("t", "v").agg(F.count(F.lit(1)).alias("c"))


def trend_direction(df: DataFrame, time: str, value: str, rows_per_chunk: int | None = None) -> DataFrame:
    """One row: n, slope per row, direction, first and last value, net and percent change.

    The row number of a repeated point runs over its copies; their sum has a closed
    form, so copies are never expanded. Slope and direction need three rows.
    """
    placed = running(
        _runs(df, time, value), order=["t", "v"], sums={"upto": "c"}, rows_per_chunk=rows_per_chunk
    )
    c = F.col("c").cast("double")
    before = (F.col("upto") - F.col("c")).cast("double")
    totals = placed.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.sum(c * F.col("v")).alias("s"),
        F.sum(F.col("v") * (c * before + c * (c - 1) / 2)).alias("xs"),
        F.min_by("v", F.struct("t", "v")).alias("first"),
        F.max_by("v", F.struct("t", "v")).alias("last"),
    )
    n = F.col("n").cast("double")
    slope = F.try_divide((F.col("xs") - (n - 1) / 2 * F.col("s")) * 12, n * (n * n - 1))
    direction = F.when(F.abs("slope") < 1e-12, "flat").when(F.col("slope") > 0, "up").otherwise("down")
    net = F.col("last") - F.col("first")
    return totals.withColumn("slope", F.when(F.col("n") >= 3, slope)).select(
        "n",
        "slope",
        F.when(F.col("slope").isNotNull(), direction).alias("direction"),
        "first",
        "last",
        net.alias("net_change"),
        F.try_divide(net * 100, F.col("first")).alias("pct_change"),
    )


def peak_trough(df: DataFrame, time: str, value: str) -> DataFrame:
    """(kind, time, value): the largest and smallest value, each at its first occurrence."""
    points = prepare_series(df, time, value, ordered=False).select(F.unix_micros(col(time)).alias("t"), col(value).alias("v"))
    got = points.agg(
        F.max_by(F.struct("t", "v"), F.struct(F.col("v"), -F.col("t"))).alias("peak"),
        F.min_by(F.struct("t", "v"), F.struct(F.col("v"), F.col("t"))).alias("trough"),
    )
    rows = [F.struct(F.lit(k).alias("kind"), F.timestamp_micros(F.col(k)["t"]).alias("time"), F.col(k)["v"].alias("value")) for k in ("peak", "trough")]
    return got.select(F.inline(F.array(*rows))).where("value is not null")


def largest_steps(df: DataFrame, time: str, value: str, rows_per_chunk: int | None = None) -> DataFrame:
    """(kind, time, step): the biggest rise and fall between consecutive rows."""
    stepped = running(
        _runs(df, time, value), order=["t", "v"], previous={"prev": "v"}, rows_per_chunk=rows_per_chunk
    ).select("t", (F.col("v") - F.col("prev")).alias("step"))
    got = stepped.where("step is not null").agg(
        F.max_by(F.struct("t", "step"), F.struct(F.col("step"), -F.col("t"))).alias("rise"),
        F.min_by(F.struct("t", "step"), F.struct(F.col("step"), F.col("t"))).alias("fall"),
    )
    rows = [F.struct(F.lit(k).alias("kind"), F.timestamp_micros(F.col(k)["t"]).alias("time"), F.col(k)["step"].alias("step")) for k in ("rise", "fall")]
    return got.select(F.inline(F.array(*rows))).where("(kind = 'rise' AND step > 0) OR (kind = 'fall' AND step < 0)")


def autocorrelation(
    df: DataFrame, time: str, value: str, lags: Sequence[int] = LAGS, rows_per_chunk: int | None = None
) -> DataFrame:
    """(lag, r): correlation of the series with itself some rows earlier.

    Pairs inside one repeated point are counted in closed form. All other pairs
    start in the first ``max(lags)`` copies of a point and reach back into the last
    ones of earlier points, so an equi-join on row numbers over at most that many
    copies per point finds them all.
    """
    reach = max(lags)
    # Read four times below: the ordered runs are computed once.
    runs = materialize(running(_runs(df, time, value), order=["t", "v"], sums={"upto": "c"}, rows_per_chunk=rows_per_chunk).select("upto", "c", "v"))
    shape = runs.agg(F.sum("c").alias("n"), F.try_divide(F.sum(F.col("c") * F.col("v")), F.sum("c")).alias("m")).first()
    n, middle = shape["n"] or 0, shape["m"] or 0.0
    usable = [k for k in lags if k < n - 1]
    if not usable:
        return report_frame(df.sparkSession, [], "lag bigint, r double")
    runs = runs.select((F.col("upto") - F.col("c")).alias("start"), "c", (F.col("v") - F.lit(middle)).alias("x"))
    width = F.least(F.col("c"), F.lit(reach).cast("bigint"))
    heads = runs.select("start", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), width - 1)).alias("j"))
    heads = heads.select("j", F.col("x").alias("a"), (F.col("start") + F.col("j")).alias("i"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in usable])).alias("lag"))
    heads = heads.where("j < lag").select("lag", "a", (F.col("i") - F.col("lag")).alias("at"))
    last = F.col("start") + F.col("c")
    tails = runs.select(F.col("x").alias("b"), F.explode(F.sequence(last - width, last - 1)).alias("at"))
    one = F.lit(1.0)
    crossing = heads.join(tails, "at").select("lag", one.alias("w"), "a", "b")
    inside = runs.select("c", "x", F.explode(F.array(*[F.lit(k).cast("bigint") for k in usable])).alias("lag")).where("c > lag")
    pairs = crossing.unionByName(
        inside.select("lag", (F.col("c") - F.col("lag")).cast("double").alias("w"), F.col("x").alias("a"), F.col("x").alias("b"))
    )
    w, a, b = F.col("w"), F.col("a"), F.col("b")
    sums = pairs.groupBy("lag").agg(
        F.sum(w).alias("n"),
        F.sum(w * a).alias("sa"),
        F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"),
        F.sum(w * b * b).alias("sbb"),
        F.sum(w * a * b).alias("sab"),
    )
    va = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")
    vb = F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    r = F.try_divide(cov, F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0))))
    return sums.select("lag", r.alias("r"))


def seasonality(df: DataFrame, time: str, value: str, rows_per_chunk: int | None = None) -> DataFrame:
    """The lag with the strongest autocorrelation, if it reaches 0.3 either way."""
    return (
        autocorrelation(df, time, value, rows_per_chunk=rows_per_chunk)
        .where("r is not null")
        .orderBy(F.abs("r").desc(), "lag")
        .limit(1)
        .where(F.abs("r") >= 0.3)
    )
