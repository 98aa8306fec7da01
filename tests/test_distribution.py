"""Bins of values that lie on edges, against the SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from catalog.base import comparable
from catalog.distribution import SQL, histogram_sql
from tableprobe.operators import distribution


@pytest.mark.parametrize("step, bins, lo", [(0.1, 30, 0.0), (0.07, 30, 0.0), (0.01, 25, 901.23)])
def test_values_on_edges(spark, step, bins, lo):
    pdf = pd.DataFrame({"v": [round(lo + step * k, 2) for k in range(bins + 1) for _ in range(k + 1)]})
    got = comparable(distribution.histogram(spark.createDataFrame(pdf), "v", bins)).orderBy("bin").collect()
    con = duckdb.connect()
    con.register("t", pdf)
    want = con.execute(histogram_sql("SELECT * FROM t", "v", bins) + " ORDER BY s.bin").fetchall()
    assert [tuple(r) for r in got] == want


def test_points_on_edges_of_a_grid(spark):
    pdf = pd.DataFrame({"l_quantity": [round(0.1 * k, 1) for k in range(21)], "l_extendedprice": [round(0.07 * k, 2) for k in range(21)]})
    got = distribution.binned_scatter(spark.createDataFrame(pdf), "l_quantity", "l_extendedprice", 20).collect()
    con = duckdb.connect()
    con.register("lineitem", pdf)
    assert sorted(tuple(r) for r in got) == sorted(con.execute(SQL["binned_scatter"]).fetchall())


def test_bins_too_narrow_for_a_double(spark):
    pdf = pd.DataFrame({"v": np.array([0.0, 5e-324, 5e-324])})
    rows = distribution.histogram(spark.createDataFrame(pdf), "v", 10).collect()
    assert len(rows) == 10 and sum(r["n"] for r in rows) == 3
