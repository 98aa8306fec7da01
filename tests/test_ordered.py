"""Running values in chunks against plain pandas, with hot keys and several chunk sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprobe.operators.merge import asof_join
from tableprobe.operators.prepare import fill_neighbor
from tableprobe.operators.timeseries import autocorrelation, largest_steps, rolling, seasonality, trend_direction
from tableprobe.operators.profile import numeric_statistics
from tableprobe.plans.frequency import column_quantiles, quantiles_of_counts
from tableprobe.plans.ordered import CHUNK, chunk_by_range, running

CHUNKS = [7, 40, 10_000]


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema=None) if pdf.isna().any().any() else spark.createDataFrame(pdf)


@pytest.mark.parametrize("limit", CHUNKS)
@pytest.mark.parametrize("descending", [False, True])
def test_running_by_group_with_a_hot_group(spark, limit, descending):
    rng = np.random.default_rng(3)
    groups = np.where(rng.random(300) < 0.6, "hot", rng.choice(list("abcdef"), 300))
    pdf = pd.DataFrame({"g": groups, "t": rng.permutation(300), "v": rng.integers(0, 9, 300)})
    pdf["w"] = np.where(rng.random(300) < 0.7, np.nan, pdf["v"])
    df = spark.createDataFrame(pdf).select("g", "t", "v", F.when(~F.isnan("w"), F.col("w")).alias("w"))
    got = (
        running(df, ["t"], ["g"], sums={"s": "v"}, last={"l": "w"}, previous={"p": "v"}, descending=descending, rows_per_chunk=limit)
        .toPandas()
        .sort_values("t")
        .reset_index(drop=True)
    )
    want = pdf.sort_values("t", ascending=not descending)
    want["s"] = want.groupby("g")["v"].cumsum()
    want["l"] = want.groupby("g")["w"].ffill()
    want["p"] = want.groupby("g")["v"].shift(1)
    want = want.sort_values("t").reset_index(drop=True)
    assert (got["s"] == want["s"]).all()
    pd.testing.assert_series_equal(got["l"], want["l"])
    pd.testing.assert_series_equal(got["p"].astype(float), want["p"].astype(float))


def test_running_with_null_groups_and_no_groups(spark):
    rows = [(None if i % 3 else "x", i, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, t int, v int")
    by_group = running(df, ["t"], ["g"], sums={"s": "v"}, rows_per_chunk=5).groupBy("g").agg(F.max("s").alias("m")).collect()
    assert {r["g"]: r["m"] for r in by_group} == {None: 40, "x": 20}
    assert running(df, ["t"], sums={"s": "v"}, rows_per_chunk=5).agg(F.max("s")).first()[0] == 60


@pytest.mark.parametrize("limit", CHUNKS)
def test_quantiles_match_pandas(spark, limit):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(200, 3.25), rng.normal(0, 10, 301).round(3)])  # one value is very common
    df = spark.createDataFrame(pd.DataFrame({"a": values, "b": values * -2}))
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    df.sparkSession.conf.set("tableprobe.rowsPerChunk", str(limit))
    try:
        got = column_quantiles(df, ["a", "b"], probabilities)
    finally:
        df.sparkSession.conf.unset("tableprobe.rowsPerChunk")
    for c, sign in (("a", 1), ("b", -2)):
        assert np.allclose(got[c], np.quantile(values * sign, probabilities))


@pytest.mark.parametrize("limit", [5, 10_000])
def test_grouped_quantiles_with_a_hot_group(spark, limit):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": np.where(rng.random(400) < 0.5, "hot", rng.choice(list("abc"), 400)), "value": rng.normal(size=400).round(2)})
    counts = spark.createDataFrame(pdf).groupBy("g", "value").agg(F.count(F.lit(1)).alias("n"))
    got = {r["g"]: r for r in quantiles_of_counts(counts, ["g"], [0.25, 0.75], at_most=400, rows_per_chunk=limit).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g]["n"] == len(part) and got[g]["distinct"] == part["value"].nunique()
        assert np.allclose(got[g]["q"], part["value"].quantile([0.25, 0.75]))


def test_numeric_statistics_do_not_depend_on_chunks(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": np.arange(500) % 37 * 1.5, "b": np.arange(500)}))
    plain = numeric_statistics(df).orderBy("column").toPandas()
    spark.conf.set("tableprobe.rowsPerChunk", "20")
    try:
        chunked = numeric_statistics(df).orderBy("column").toPandas()
    finally:
        spark.conf.unset("tableprobe.rowsPerChunk")
    pd.testing.assert_frame_equal(plain, chunked)


@pytest.mark.parametrize("limit", CHUNKS)
def test_asof_join_matches_pandas(spark, limit):
    rng = np.random.default_rng(8)
    base = pd.Timestamp("2024-01-01")
    # A third of the left rows share one time.
    seconds = np.sort(np.where(rng.random(240) < 0.33, 5000, rng.integers(100, 20000, 240)))
    left = pd.DataFrame({"t": base + pd.to_timedelta(seconds, "s"), "id": np.arange(240)})
    right = pd.DataFrame({"t": base + pd.to_timedelta(np.sort(rng.choice(np.arange(1000, 20000), 60, replace=False)), "s")})
    right["lab"] = np.where(rng.random(60) < 0.3, None, rng.integers(0, 99, 60).astype(object))
    want = pd.merge_asof(left, right.assign(row=np.arange(60)), on="t").sort_values("id")
    r = spark.createDataFrame([(t.to_pydatetime(), None if v is None else int(v), i) for i, (t, v) in enumerate(zip(right["t"], right["lab"]))], "t timestamp, lab int, row int")
    got = asof_join(spark.createDataFrame(left), r, "t", rows_per_chunk=limit).orderBy("id").collect()
    assert len(got) == 240
    for g, (_, w) in zip(got, want.iterrows()):
        assert (g["row"] is None) == pd.isna(w["row"]) and (g["row"] is None or g["row"] == w["row"])
        assert g["lab"] == (None if pd.isna(w["lab"]) else w["lab"])


def test_asof_join_by_key_and_name_clash(spark):
    left = spark.createDataFrame([(1, 10, "l1"), (1, 20, "l2"), (2, 15, "l3"), (2, None, "gone")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 10, "r1"), (1, 19, "r2"), (2, 16, "r3"), (1, 10, "r0")], "k int, t int, v string")
    for limit in (1, 100):
        got = asof_join(left, right, "t", by=["k"], suffix="__lab", rows_per_chunk=limit).orderBy("v").collect()
        assert [(r["v"], r["v__lab"]) for r in got] == [("l1", "r1"), ("l2", "r2"), ("l3", None)]


@pytest.mark.parametrize("limit", CHUNKS)
@pytest.mark.parametrize("backward", [False, True])
def test_neighbor_fill_matches_pandas(spark, limit, backward):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"t": rng.permutation(250), "v": np.where(rng.random(250) < 0.6, np.nan, rng.integers(0, 50, 250))})
    got = fill_neighbor(spark.createDataFrame(pdf), "v", ["t"], backward=backward, rows_per_chunk=limit).orderBy("t").toPandas()
    want = pdf.sort_values("t")["v"]
    want = (want.bfill() if backward else want.ffill()).reset_index(drop=True)
    pd.testing.assert_series_equal(got["v"], want, check_dtype=False)


def test_neighbor_fill_with_one_key_for_most_rows(spark):
    rows = [(5, None)] * 300 + [(1, 7.0), (9, None), (6, 2.0)]
    got = fill_neighbor(spark.createDataFrame(rows, "t int, v double"), "v", ["t"], rows_per_chunk=2)
    assert {(r["t"], r["v"]): r["n"] for r in got.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        (5, 7.0): 300,
        (1, 7.0): 1,
        (9, 2.0): 1,
        (6, 2.0): 1,
    }


@pytest.mark.parametrize("limit", CHUNKS)
@pytest.mark.parametrize("aggregate", ["mean", "sum", "count", "std"])
def test_rolling_matches_pandas(spark, limit, aggregate):
    rng = np.random.default_rng(10)
    minutes = np.sort(rng.choice(np.arange(3000), 200, replace=False))
    pdf = pd.DataFrame({"t": pd.Timestamp("2024-03-01") + pd.to_timedelta(minutes, "min"), "v": rng.normal(1000, 5, 200)})
    want = getattr(pdf.set_index("t")["v"].rolling("45min"), aggregate)().to_numpy()
    got = rolling(spark.createDataFrame(pdf), "t", "v", 45 * 60, aggregate, "out", rows_per_chunk=limit).orderBy("t").toPandas()["out"]
    assert np.allclose(got.astype(float), want, atol=1e-8, equal_nan=True)


def test_rolling_counts_rows_at_the_same_time_together(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("2024-01-01 00:00:10", 2.0), ("2024-01-01 00:00:10", 3.0), ("bad", 4.0)], "t string, v double")
    got = rolling(df, "t", "v", 30, "sum").orderBy("v").collect()
    assert [r["rolling_sum"] for r in got] == [1.0, 6.0, 6.0]


def series_with_copies(spark):
    rng = np.random.default_rng(11)
    t = np.sort(np.where(rng.random(400) < 0.4, 77, rng.integers(0, 300, 400)))
    v = np.where(t == 77, 5.0, (np.sin(t / 4) * 10).round(2))
    pdf = pd.DataFrame({"t": pd.Timestamp("2024-01-01") + pd.to_timedelta(t, "h"), "v": v}).sort_values(["t", "v"]).reset_index(drop=True)
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=1))


@pytest.mark.parametrize("limit", CHUNKS)
def test_trend_and_seasonality_with_many_copies_of_one_row(spark, limit):
    pdf, df = series_with_copies(spark)
    trend = trend_direction(df, "t", "v", rows_per_chunk=limit).first()
    assert trend["n"] == 400
    assert np.isclose(trend["slope"], np.polyfit(np.arange(400), pdf["v"], 1)[0])
    assert trend["first"] == pdf["v"].iloc[0] and trend["last"] == pdf["v"].iloc[-1]
    lags = {r["lag"]: r["r"] for r in autocorrelation(df, "t", "v", rows_per_chunk=limit).collect()}
    for k in (7, 12, 24, 30):
        assert np.isclose(lags[k], pdf["v"].autocorr(k)), k
    best = max(lags, key=lambda k: abs(lags[k]))
    assert [r["lag"] for r in seasonality(df, "t", "v", rows_per_chunk=limit).collect()] == ([best] if abs(lags[best]) >= 0.3 else [])
    steps = {r["kind"]: r["step"] for r in largest_steps(df, "t", "v", rows_per_chunk=limit).collect()}
    diffs = pdf["v"].diff()
    assert np.isclose(steps["rise"], diffs.max()) and np.isclose(steps["fall"], diffs.min())


def test_short_series(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "t string, v double")
    assert trend_direction(df, "t", "v").first()["slope"] is None
    assert autocorrelation(df, "t", "v").count() == 0
    empty = df.where("false")
    assert trend_direction(empty, "t", "v").first()["n"] == 0
    assert rolling(empty, "t", "v", 60).count() == 0


def test_small_chunks_do_not_make_more_tasks(spark):
    """One file is one task that wrote it; chunks follow the order and hold at most the wanted rows."""
    rows = spark.range(0, 6000, 1, 7).selectExpr("pmod(id * 7919, 6000) AS k")
    chunked = chunk_by_range(rows, ["k"], 5)
    assert chunked.select(F.input_file_name()).distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = chunked.groupBy(CHUNK).agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy(CHUNK).collect()
    assert len(got) >= 1200 and max(r["n"] for r in got) == 5
    assert all(a["high"] < b["low"] for a, b in zip(got, got[1:]))


def test_running_values_over_several_ranges_of_small_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keeps small ranges apart
    try:
        placed = running(spark.range(0, 1000, 1, 7), ["id"], sums={"s": "id"}, previous={"p": "id"}, rows_per_chunk=9).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["s"] == r["id"] * (r["id"] + 1) // 2 and r["p"] == (r["id"] - 1 if r["id"] else None) for r in placed)
    assert len(placed) == 1000
