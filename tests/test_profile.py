"""Profiles, relations, distributions and findings on edge cases, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprobe.functions.frames import rounded
from tableprobe.operators import distribution, filters, findings, profile, relate, timeseries, typing


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1.0, None, 2.0, "a", True), (float("nan"), None, 2.0, "b", False), (float("inf"), None, 2.0, None, True), (4.0, None, 2.0, "a", None)]
    return spark.createDataFrame(rows, "x double, gone double, same double, s string, f boolean")


def test_moments_by_size(spark):
    for n in (0, 1, 2, 3, 4, 9):
        v = [float(i * i) for i in range(n)]
        got = profile.numeric_statistics(spark.createDataFrame([(x,) for x in v], "v double")).first()
        s = pd.Series(v, dtype=float)
        assert got["count"] == n and got["unique"] == n
        for name, want in {"mean": s.mean(), "std": s.std(), "median": s.median(), "skew": s.skew(), "kurtosis": s.kurt()}.items():
            assert (got[name] is None) if pd.isna(want) else np.isclose(got[name], want), (n, name)


def test_nan_and_infinity_are_missing(odd):
    stats = {r["column"]: r for r in profile.numeric_statistics(odd).collect()}
    assert stats["x"]["count"] == 2 and stats["x"]["missing_pct"] == 50.0 and stats["gone"]["count"] == 0
    assert stats["same"]["std"] == 0.0 and stats["same"]["skew"] is None
    assert [r["column"] for r in profile.missing_summary(odd).collect()] == ["gone", "x", "s", "f", "same"]
    assert profile.overview(odd).first()["missing_cells"] == 8
    bounds = {r["column"]: r for r in profile.outliers_zscore(odd).collect()}
    assert bounds["same"]["lower"] is None and bounds["same"]["outliers"] == 0 and bounds["gone"]["upper"] is None
    assert profile.outliers_iqr(odd).where("column = 'gone'").first()["lower"] is None


def test_column_health_statuses(spark):
    df = spark.createDataFrame([(i, 1, None if i < 6 else i, None if i < 2 else i, i % 3) for i in range(10)], "key int, one int, half int, some int, ok int")
    got = {r["column"]: r["status"] for r in profile.column_health(df).collect()}
    assert got == {"half": "High missing", "some": "Some missing", "key": "Unique key", "one": "Constant", "ok": "OK"}


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x"), (2, "y")], "a int, b string")
    assert profile.duplicate_summary(df).first().asDict() == {"rows": 5, "duplicates": 2, "duplicate_pct": 40.0}
    assert profile.quality_status(df).first()["duplicate_status"] == "bad"


def test_empty_table_is_safe(spark):
    df = spark.createDataFrame([], "a double, b string, t timestamp")
    assert profile.overview(df).first()["rows"] == 0
    assert [r["missing_pct"] for r in profile.missing_summary(df).collect()] == [0.0, 0.0, 0.0]
    assert profile.duplicate_summary(df).first()["duplicates"] == 0
    assert profile.time_coverage(df).count() == 0
    assert profile.outliers_iqr(df).first()["outliers"] == 0
    assert profile.categorical_statistics(df, ["b"]).count() == 0
    assert distribution.histogram(df, "a").count() == 0
    assert distribution.box_stats(df, "a").first()["n"] == 0
    assert timeseries.resample(df, "t", ["a"], "day").count() == 0
    assert findings.findings(df).where("rule = 'duplicates'").count() == 1


def test_ties_go_to_the_smallest_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    assert [(r["value"], r["rank"]) for r in profile.top_values(df, ["s"], 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    detail = {r["metric"]: r["text"] or r["number"] for r in profile.column_detail(df, "s").collect()}
    assert detail["mode"] == "a" and detail["examples"] == "a, b, c" and detail["top_frequency"] == 2.0


def test_booleans_are_described_like_text(odd):
    detail = {r["metric"]: r["text"] or r["number"] for r in profile.column_detail(odd, "f").collect()}
    assert detail["mode"] == "true" and detail["unique"] == 2.0


def test_correlation_uses_complete_pairs(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(80, 3)), columns=list("abc")).mask(rng.random((80, 3)) < 0.2)
    pdf["k"] = 1.0
    got = {(r["a"], r["b"]): r["r"] for r in relate.correlation_matrix(spark.createDataFrame(pdf)).collect()}
    want = pdf.corr()
    for (a, b), r in got.items():
        assert (r is None) if pd.isna(want.loc[a, b]) else np.isclose(r, want.loc[a, b])
    assert relate.correlation_matrix(spark.range(3)).count() == 0
    assert relate.target_correlations(spark.createDataFrame(pdf), "a").collect()[-1]["feature"] == "k"


def test_group_means_keep_the_null_group(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 3.0), (None, 8.0), ("y", 5.0)], "g string, v double")
    assert {r["g"]: r["v"] for r in relate.group_means(df, "g").collect()} == {"x": 1.0, "y": 4.0, None: 8.0}
    score = relate.feature_importance(df, "g").first()
    assert np.isclose(score["score"], np.std([1.0, 4.0]) / 4.25) and score["strength"] == "Strong"


def test_histogram_counts_every_value_once(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 9, 10, 10]] + [(None,)], "v double")
    rows = distribution.histogram(df, "v", 10).orderBy("bin").collect()
    assert [r["n"] for r in rows] == np.histogram([0, 0, 1, 9, 10, 10], 10)[0].tolist()
    with pytest.raises(ValueError):
        distribution.histogram(df, "v", 4)


def test_grouped_boxes_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"g": np.where(rng.random(300) < 0.5, "hot", "b"), "v": rng.normal(size=300).round(3)}))
    plain = distribution.grouped_box_stats(df, "g", "v").orderBy("category").toPandas()
    spark.conf.set("tableprobe.rowsPerChunk", "11")
    try:
        pd.testing.assert_frame_equal(plain, distribution.grouped_box_stats(df, "g", "v").orderBy("category").toPandas())
    finally:
        spark.conf.unset("tableprobe.rowsPerChunk")


def test_kept_and_excluded_rows_make_the_whole(odd):
    rule = filters.range_filter("x", 0, 3) & filters.in_filter(odd, "s", ["a"])
    assert rule.apply(odd).count() + filters.excluded_rows(odd, rule).count() == odd.count()
    crossed = filters.range_filter("x", 3, 1)
    assert not crossed.active and crossed.messages and crossed.apply(odd).count() == 4
    assert filters.range_filter("x", "abc", None).messages


def test_resample_lists_empty_steps(spark):
    df = spark.createDataFrame([("2024-01-31 10:00:00", 1.0), ("2024-01-31 11:00:00", None), ("2024-04-02 00:00:00", 4.0)], "t string, v double")
    for how, want in {"mean": [1.0, None, None, 4.0], "sum": [1.0, 0.0, 0.0, 4.0], "count": [1, 0, 0, 1], "std": [None] * 4}.items():
        assert [r["v"] for r in timeseries.resample(df, "t", ["v"], "month", how).orderBy("t").collect()] == want
    assert timeseries.resample(df, "t", ["v"], None).count() == 3
    before = spark.createDataFrame([("1969-12-31 23:58:00", 1.0), ("1970-01-01 00:07:00", 2.0)], "t string, v double")
    assert timeseries.resample(before, "t", ["v"], "5min", "count").count() == 3


def test_scale_groups(spark):
    df = spark.createDataFrame([(1.0, 500.0, None, 2.0)], "a double, b double, c double, d double")
    assert timeseries.scale_groups(df, ["a", "b", "c", "d"]) == (["a", "c", "d"], ["b"])
    assert timeseries.scale_groups(df, ["a", "d"]) == (["a", "d"], [])


def test_target_findings_name_missing_targets(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9)], "a double, b double")
    with pytest.raises(ValueError, match="zz"):
        findings.target_findings(df, "zz")
    row = findings.target_findings(df, "a").first()
    assert (row["rule"], row["subject"], row["value"] > 0.99) == ("correlation", "b", True) and "very strong" in row["text"]


def test_rounded_is_for_display(spark):
    assert rounded(spark.createDataFrame([(1.239, 2)], "a double, b int")).first()["a"] == 1.24


def test_split_columns_uses_cardinality(spark):
    df = spark.range(2000).select(F.col("id"), F.col("id").cast("string").alias("many"), (F.col("id") % 900).cast("string").alias("half"), F.lit(True).alias("f"))
    assert typing.split_columns(df) == {"numeric": ["id"], "categorical": ["half", "f"], "datetime": []}


def test_approximate_profile_is_close(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"))
    exact = {r["column"]: r for r in profile.numeric_statistics(df).collect()}
    close = {r["column"]: r for r in profile.numeric_statistics(df, approx=True).collect()}
    for c in "ab":
        assert abs(close[c]["unique"] / exact[c]["unique"] - 1) < 0.05 and abs(close[c]["median"] - exact[c]["median"]) <= 1
    assert {r["column"]: r["status"] for r in profile.column_health(df, approx=True).collect()} == {"a": "OK", "b": "OK"}
    assert abs(typing.column_types(df, approx=True).where("column = 'a'").first()["unique"] / 5000 - 1) < 0.05


def test_identical_rows_are_told_apart_by_place_and_null(spark):
    rows = [("a", None, 1.0), (None, "a", 1.0), ("a", None, 1.0), ("", "a", 0.0), ("", "a", -0.0), ("x" * 99, "a", None), ("x" * 99, "a", float("nan"))]
    df = spark.createDataFrame(rows, "a string, b string, c double")
    assert profile.duplicate_summary(df).first()["duplicates"] == 3
    stamps = spark.sql("SELECT timestamp_micros(v) AS t, 'x' AS s FROM VALUES (1), (2), (1) AS d(v)")
    assert profile.duplicate_summary(stamps).first()["duplicates"] == 1
    assert typing.column_types(df).where("column = 'a'").first()["unique"] == 3
