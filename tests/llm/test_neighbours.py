"""Neighbour search: recall against all products, exact scores, ties, unusable vectors."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tableprobe.llm import neighbours
from tableprobe.llm.queries import QUERIES

TINY = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute(ids, vectors, queries, k):
    """Best rows of every query, ties to the smaller id."""
    out = {}
    for q in queries:
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, expected):
    return sum(len({n for n, _ in got[q]} & {n for n, _ in x}) for q, x in expected.items()) / sum(map(len, expected.values()))


def test_query(spark):
    rows = pq.read_table(f"{TINY}/embeddings.parquet").to_pylist()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = found(QUERIES["op13_pruned_graph"](spark, TINY))
    expected = brute(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    assert got.keys() == expected.keys() and recall(got, expected) >= 0.98
    exact = {q: dict(zip(ids.tolist(), (vectors @ vectors[k]).tolist())) for k, q in enumerate(ids.tolist()) if q in expected}
    for q, rows in got.items():
        assert len(rows) == 20 and rows == sorted(rows, key=lambda x: (-x[1], x[0]))
        assert all(abs(exact[q][n] - s) < 1e-12 for n, s in rows)


@pytest.mark.parametrize("shard_vectors", [400, 100_000])
def test_recall_of_lengths_clusters_and_near_copies(spark, shard_vectors):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 24))
    vectors = middle[rng.integers(0, 12, 2500)] + 0.3 * rng.normal(size=(2500, 24))
    vectors *= rng.uniform(0.2, 3, (2500, 1))
    vectors[:800] = vectors[0] + 1e-3 * rng.normal(size=(800, 24))
    df = spark.createDataFrame([(n, x) for n, x in enumerate(vectors.tolist())], SCHEMA).repartition(4)
    got = found(neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=10, shard_vectors=shard_vectors))
    assert recall(got, brute(np.arange(2500), vectors, range(0, 2500, 20), 10)) >= 0.95


def test_ties_repeats_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(n, [1.0, 0.0]) for n in range(1, 900)]  # a vector that most rows hold
    rows += [(0, [2.0, 1.0]), (0, [2.0, 1.0]), (2000, [-0.0, 3.0]), (2001, [0.0, 3.0]), (2002, [1.0, 1.0]), (2002, [0.5, 0.5])]
    rows += [(3000, None), (3020, []), (3040, [0.0, 0.0]), (3060, [nan, 1.0]), (3080, [inf, 1.0]), (None, [9.0, 9.0]), (3100, [1.0, 0.0, 0.0]), (3101, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame([*rows, (3120, [None, 1.0])], SCHEMA).repartition(7)
    queries = df.where("vec_id in (0, 2000, 3000, 3020, 3040, 3060, 3080, 3100, 3120) or vec_id is null")
    got = found(neighbours.nearest(df, queries, k=4))
    assert got == {
        0: [(2000, 3.0), (2001, 3.0), (2002, 3.0), (1, 2.0)],
        2000: [(2001, 9.0), (0, 3.0), (2002, 3.0), (1, 0.0)],
        3100: [(3101, 2.0)],
    }
    assert neighbours.nearest(df.limit(0), queries, k=4).count() == 0
    assert neighbours.nearest(df, df.limit(0), k=4).count() == 0
    extra = df.selectExpr("*", "1 as shard", "'x' as score", "2 as id", "3 as vector")
    assert found(neighbours.nearest(extra, extra.where("vec_id = 0"), k=4)) == {0: got[0]}


def test_pruning_keeps_other_directions():
    points = np.array([[1, 0, 0], [0.999, 0.045, 0], [0.998, 0.06, 0], [0.9, 0, 0.436]], np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    ids = np.array([[1, 2, 3]])
    near = (points[ids[0]] @ points[0])[None]
    assert neighbours.robust_prune(points, ids, near, 3, 1.2).tolist() == [[1, 3, -1]]
