"""Correlations from matrices against NumPy, pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprobe.operators import relate
from tableprobe.plans import comoments
from tests.conftest import plan


def plain(x, y):
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[both], y[both]
    if len(x) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def sample(rows=900):
    rng = np.random.default_rng(5)
    a = rng.normal(size=rows)
    columns = {
        "a": a,
        "b": a * 2 + rng.normal(size=rows),
        "far": 1e9 + a,
        "gaps": np.where(rng.random(rows) < 0.4, np.nan, a - 3),
        "constant": np.full(rows, 0.1),
        "empty": np.full(rows, np.nan),
        "once": np.where(np.arange(rows) == 7, 5.0, np.nan),
        # constant wherever "shy" is present, with the spread elsewhere
        "partly": np.where(np.arange(rows) % 3 == 0, 0.3, 1e6 * a),
        "shy": np.where(np.arange(rows) % 3 == 0, a, np.nan),
        "spike": np.where(np.arange(rows) == 0, 1e8, a),
    }
    return columns


def frame(spark, columns, parts):
    names = list(columns)
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts)


@pytest.mark.parametrize("cells", [comoments.CELLS, 70])
def test_matrix_equals_numpy(spark, monkeypatch, cells):
    monkeypatch.setattr(comoments, "CELLS", cells)
    columns = sample()
    got = {(r["a"], r["b"]): r["r"] for r in relate.correlation_matrix(frame(spark, columns, 5)).collect()}
    names = list(columns)
    assert set(got) == {(x, y) for k, x in enumerate(names) for y in names[k + 1 :]}
    for (x, y), r in got.items():
        want = plain(columns[x], columns[y])
        assert (r is None) == (want is None), (x, y, r, want)
        assert want is None or r == pytest.approx(want, abs=1e-7), (x, y)


def test_small_batches_merge_to_the_same_moments():
    columns = sample(300)
    x = np.column_stack(list(columns.values()))
    places = list(range(x.shape[1]))
    whole = comoments.batch_moments(x, places, places)
    total = None
    for at in range(0, 300, 13):
        part = comoments.batch_moments(x[at : at + 13], places, places)
        total = part if total is None else comoments.merged(total, part)
    for name, a, b in zip(comoments.MOMENTS, whole, total):
        present = whole[0] > 0
        assert np.allclose(a[present], b[present], rtol=1e-6, atol=1e-6), name
    constant = list(columns).index("constant")
    assert not total[3][constant].any() and not total[4][:, constant].any()


def test_target_mode_and_empty_tables(spark):
    columns = sample()
    df = frame(spark, columns, 3)
    rows = relate.target_correlations(df, "b").collect()
    assert {r["feature"] for r in rows} == set(columns) - {"b"}
    for r in rows:
        want = plain(columns[r["feature"]], columns["b"])
        assert r["r"] == (None if want is None else pytest.approx(want, abs=1e-7))
    none = relate.correlation_matrix(df.where(F.lit(False)))
    assert none.count() == 45 and none.where("r is not null").count() == 0


def test_two_hundred_columns_take_one_pass(spark):
    df = spark.range(500).select(*[F.rand(k).alias(f"c{k}") for k in range(200)])
    out = relate.correlation_matrix(df)
    text = plan(out)
    tree = text.split("\n\n")[0]
    assert tree.count("Range") == 1 and tree.count("MapInArrow") == 2 and tree.count("Generate") == 1
    assert tree.index("Generate") < tree.index("MapInArrow")  # pairs are listed after all has been merged
    assert out.count() == 199 * 100


def test_one_row_per_column_and_task_travels(spark):
    df = spark.range(20_000).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c")).repartition(4)
    values = [F.col(c) for c in df.columns]
    assert comoments.moment_states(df, values).count() == 3 * 4
    pairs = comoments.pair_correlations(df, values).collect()
    assert len(pairs) == 3 and all(r["n"] == 20_000 for r in pairs)
