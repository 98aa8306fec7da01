"""Quantiles by brackets: against numpy, with several turns, ties, infinities aside, empty columns; and the plan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprobe.functions.columns import as_number, col
from tableprobe.operators.profile import outliers_iqr
from tableprobe.plans import selection
from tableprobe.plans.frequency import column_quantiles

POINTS = [0.0, 0.25, 0.5, 0.501, 0.9, 1.0]


def table(spark, seed=1, rows=20_000):
    rng = np.random.default_rng(seed)
    data = {
        "normal": rng.normal(size=rows),
        "mostly_one": np.where(rng.random(rows) < 0.7, 3.0, rng.normal(size=rows)),
        "few": rng.integers(0, 3, rows) * 1.0,
        "wide": rng.normal(size=rows) * 10.0 ** rng.integers(-300, 300, rows),
        "ordered": np.arange(rows) * 1.0,
        "constant": np.full(rows, -2.5),
    }
    return spark.createDataFrame(pd.DataFrame(data)).repartition(5), data


@pytest.mark.parametrize("accuracy, most_inside, sampled", [(2_000, 400_000, 2_000), (2_000, 400_000, 1_000), (100, 300, 1_000), (20, 500, 10**9)])
def test_several_turns_give_the_same(spark, monkeypatch, accuracy, most_inside, sampled):
    df, data = table(spark)
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    monkeypatch.setattr(selection, "SAMPLED", sampled)
    got = selection.selected_quantiles(df, {c: col(c) for c in data}, POINTS, most_inside)
    for c, values in data.items():
        assert np.allclose(got[c], np.quantile(values, POINTS), rtol=1e-12, atol=0), c


def test_a_sketch_that_is_wrong_is_noticed(spark, monkeypatch):
    df, data = table(spark, rows=4_000)
    real, calls = selection._sketched, []

    def wrong(stacked, width, wanted, inside):
        calls.append(inside)
        out = real(stacked, width, wanted, inside)
        if inside is None:
            out = {k: (n, [[None if x is None else x + 0.5 for x in ends] for ends in near]) for k, (n, near) in out.items()}
        return out

    monkeypatch.setattr(selection, "_sketched", wrong)
    got = selection.selected_quantiles(df, {c: col(c) for c in data}, [0.25, 0.75])
    for c, values in data.items():
        assert np.allclose(got[c], np.quantile(values, [0.25, 0.75]), rtol=1e-12, atol=0), c
    assert any(x is not None for x in calls)


def test_gaps_odd_numbers_and_empty_columns(spark):
    rows = [(float("nan"), 1, None, None), (float("inf"), 2**53 + 2, 0.0, None), (1.5, None, -0.0, None), (2.5, 2, 4.0, None), (float("-inf"), 7, None, None)]
    df = spark.createDataFrame(rows, "a double, b long, c double, d double")
    got = column_quantiles(df, ["a", "b", "c", "d"], [0.25, 0.5])
    assert got == {"a": [1.75, 2.0], "b": [1.75, 4.5], "c": [0.0, 0.0], "d": [None, None]}
    assert column_quantiles(df.limit(0), ["a", "d"], [0.5]) == {"a": [None], "d": [None]}
    assert column_quantiles(df, [], [0.5]) == {}


def test_one_row(spark):
    df = spark.createDataFrame([(4.0,)], "a double")
    assert column_quantiles(df, ["a"], [0.0, 0.3, 1.0]) == {"a": [4.0, 4.0, 4.0]}


def test_only_values_inside_brackets_travel(spark):
    """The shuffle holds a row per zone and task beside the values in brackets."""
    df, data = table(spark, rows=50_000)
    values = [as_number(col("normal"), df.schema["normal"].dataType)]
    stacked = selection._stacked(df, values)
    low, high = np.quantile(data["normal"], [0.249, 0.251])
    found = selection._counted(stacked, [[(float(low), float(high))]])
    kept, counts = found[0]
    assert counts.sum() == 50_000 and np.isnan(kept).sum() == 2 and len(kept) < 130
    assert outliers_iqr(df, ["normal"]).first()["outliers"] > 0


def test_the_driver_sees_few_values(spark, monkeypatch):
    df, data = table(spark)
    seen = []
    real = selection._counted

    def watched(stacked, brackets):
        out = real(stacked, brackets)
        seen.append(sum(len(v) for v, _ in out.values()))
        return out

    monkeypatch.setattr(selection, "_counted", watched)
    selection.selected_quantiles(df, {"normal": col("normal"), "x": F.col("ordered") * 2}, [0.25, 0.75], 100)
    assert seen and max(seen) <= 420
