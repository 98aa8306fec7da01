"""Largest inner products by a robust-pruned directed graph per shard.

Vectors get one more component so that all have one length; then the largest inner
product is the nearest point, and a graph of near points can be walked towards it. Points
are added in batches: a greedy search from the middle of the shard proposes neighbours,
and pruning keeps a neighbour only if no kept one is much nearer to it (``alpha``), so
that edges point in different directions. A query walks the graph of each shard with a
beam; what it meets is scored in double precision on the vectors as they were given.

Equal vectors are one point that carries its smallest ids: no result needs more of them
than it has rows, so a vector that a third of all rows hold is a small point as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.plans.storage import materialize

#: Vectors in a shard, about: bounds the memory of a task (vectors, edges and search state).
SHARD_VECTORS = 16_000
#: Edges kept per point, and how many a point may gather before it is pruned again.
EDGES, GATHERED = 32, 48
#: Points that a search keeps while a graph is built, and while it is queried.
BUILD_BEAM, QUERY_BEAM = 64, 160
#: How much nearer a kept neighbour must be to make another one superfluous.
ALPHA = 1.2
#: Points looked at in one turn of a beam; points added and queries walked at a time.
STEP, BATCH = 4, 256


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, targets: np.ndarray, beam: int, keep_path: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Points near each target, best first, and their inner products; -1 fills up.

    ``keep_path`` returns all points that were expanded instead of the beam alone.
    """
    count = len(targets)
    ids = np.full((count, beam), -1, np.int64)
    near = np.full((count, beam), -np.inf, np.float32)
    ids[:, 0], near[:, 0] = start, targets @ points[start]
    done = ids < 0
    met = np.zeros((count, len(points)), bool)
    met[:, start] = True
    path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.arange(count)
    while len(live):
        # the first open places of each beam
        at = np.argsort(done[live], axis=1, kind="stable")[:, :STEP]
        rows = live[:, None]
        open_ = ~done[rows, at]
        row, place = np.nonzero(open_)
        row, place = live[row], at[row, place]
        if keep_path:
            path.append((row, ids[row, place], near[row, place]))
        done[row, place] = True
        wide = np.where(open_[:, :, None], edges[np.where(open_, ids[rows, at], 0)], -1).reshape(len(live), -1)
        wide.sort(axis=1)
        fresh = wide >= 0
        fresh[:, 1:] &= wide[:, 1:] != wide[:, :-1]
        fresh &= ~met[rows, np.maximum(wide, 0)]
        r, c = np.nonzero(fresh)
        new = wide[r, c]
        met[live[r], new] = True
        product = np.full(wide.shape, -np.inf, np.float32)
        product[r, c] = np.einsum("ij,ij->i", points[new], targets[live[r]])
        every = np.concatenate((near[live], product), axis=1)
        names = np.concatenate((ids[live], np.where(fresh, wide, -1)), axis=1)
        state = np.concatenate((done[live], ~fresh), axis=1)
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(every, best, 1), axis=1, kind="stable"), 1)
        near[live], ids[live], done[live] = (np.take_along_axis(x, best, 1) for x in (every, names, state))
        live = live[~done[live].all(axis=1)]
    if not keep_path:
        return ids, near
    row, name, product = (np.concatenate(x) for x in zip(*path))
    return _rectangle(row, name, product, count)


def _rectangle(row: np.ndarray, name: np.ndarray, product: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries as one row each, best first, filled up with -1."""
    order = np.lexsort((-product, row))
    row, name, product = row[order], name[order], product[order]
    sizes = np.bincount(row, minlength=count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids = np.full((count, max(1, sizes.max(initial=0))), -1, np.int64)
    near = np.full(ids.shape, -np.inf, np.float32)
    ids[row, place], near[row, place] = name, product
    return ids, near


def robust_prune(points: np.ndarray, ids: np.ndarray, near: np.ndarray, edges: int, alpha: float) -> np.ndarray:
    """The neighbours to keep of candidates that come best first; -1 fills up."""
    kept = np.full((len(ids), edges), -1, np.int64)
    alive = ids >= 0
    between = points[np.maximum(ids, 0)]
    between = np.maximum(0, 2 - 2 * (between @ between.transpose(0, 2, 1)))
    distance = np.maximum(0, 2 - 2 * near)
    rows = np.arange(len(ids))
    for k in range(edges):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        kept[some, k] = ids[rows[some], pick[some]]
        alive &= ~(alpha * alpha * between[rows, pick] <= distance)
        alive[rows, pick] = False
    return kept


def build_graph(points: np.ndarray, edges: int = EDGES, gathered: int = GATHERED, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = BATCH) -> tuple[np.ndarray, int]:
    """Edges of every point (-1 fills up), and the point in the middle, where searches start."""
    count = len(points)
    graph = np.full((count, gathered), -1, np.int32)
    degree = np.zeros(count, np.int64)
    start = int(np.argmax(points @ points.mean(axis=0)))
    order = np.random.default_rng(count).permutation(count)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        new = order[at : at + size]
        at, size = at + len(new), min(2 * size, batch)
        ids, near = beam_search(points, graph, start, points[new], beam, keep_path=True)
        kept = robust_prune(points, ids, near, edges, alpha)
        graph[new, :edges] = kept
        degree[new] = (kept >= 0).sum(axis=1)
        # and back: a point that has gathered too many is pruned again
        r, c = np.nonzero(kept >= 0)
        to, source = kept[r, c], new[r]
        by = np.argsort(to, kind="stable")
        to, source = to[by], source[by]
        nodes, first, more = np.unique(to, return_index=True, return_counts=True)
        fits = degree[nodes] + more <= gathered
        inside = np.repeat(fits, more)
        place = np.arange(len(to)) - np.repeat(first, more) + degree[to]
        graph[to[inside], place[inside]] = source[inside]
        degree[nodes[fits]] += more[fits]
        for some in np.array_split(np.flatnonzero(~fits), max(1, int((~fits).sum()) // batch)):
            if not len(some):
                continue
            row = np.concatenate([np.repeat(np.arange(len(some)), gathered), np.repeat(np.arange(len(some)), more[some])])
            name = np.concatenate([graph[nodes[some]].ravel(), source[np.concatenate([np.arange(f, f + m) for f, m in zip(first[some], more[some])])]])
            row, name = row[name >= 0], name[name >= 0]
            product = np.einsum("ij,ij->i", points[name], points[nodes[some][row]])
            kept = robust_prune(points, *_rectangle(row, name, product, len(some)), edges, alpha)
            graph[nodes[some]] = -1
            graph[nodes[some], :edges] = kept
            degree[nodes[some]] = (kept >= 0).sum(axis=1)
    return reachable(points, graph, start, beam, batch), start


def reachable(points: np.ndarray, graph: np.ndarray, start: int, beam: int, batch: int) -> np.ndarray:
    """The graph with an edge to every point that pruning has cut off, from a near point that can be reached."""
    while True:
        seen = np.zeros(len(points), bool)
        front = np.array([start])
        while len(front):
            seen[front] = True
            front = np.unique(graph[front])
            front = front[front >= 0]
            front = front[~seen[front]]
        lost = np.flatnonzero(~seen)[:batch]
        if not len(lost):
            return graph
        hosts, _ = beam_search(points, graph, start, points[lost], beam)
        free = (graph < 0).sum(axis=1)
        for point, near in zip(lost.tolist(), hosts.tolist()):
            host = next((h for h in near if h >= 0 and free[h] > 0), None)
            if host is None:
                graph = np.concatenate((graph, np.full((len(graph), 4), -1, graph.dtype)), axis=1)
                free += 4
                host = near[0]
            graph[host, np.flatnonzero(graph[host] < 0)[0]] = point
            free[host] -= 1


def _usable(vector: str) -> Column:
    """Vectors without nulls, NaN and infinities that are not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _fold(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Equal vectors of a batch become one row with their smallest ids."""
    for batch in batches:
        held: dict[bytes, list[int]] = {}
        rows = batch.column("vector")
        ends = rows.offsets.to_numpy()
        # adding zero gives both zeros one form
        raw = (rows.values.to_numpy(zero_copy_only=False) + 0.0).tobytes()
        for name, i, j in zip(batch.column("id").to_pylist(), ends.tolist(), ends[1:].tolist()):
            held.setdefault(raw[8 * i : 8 * j], []).append(name)
        ids = [sorted({*x})[:keep] for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["vector", "ids"])


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Scaled below length one, with a component that makes up for the rest."""
    scaled = vectors / longest
    rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
    return np.concatenate((scaled, rest[:, None]), axis=1).astype(np.float32)


def _build(batches: Iterator[pa.RecordBatch], keep: int, longest: float, settings: dict) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by shard: the graph of each shard, and one for each length of vectors in it."""

    def settle(shard: int, held: dict[bytes, list[int]]) -> Iterator[pa.RecordBatch]:
        for size in sorted({len(x) for x in held}):
            names = sorted(x for x in held if len(x) == size)
            vectors = np.frombuffer(b"".join(names)).reshape(len(names), -1)
            graph, start = build_graph(_lifted(vectors, longest), **settings)
            counts = np.array([len(held[x]) for x in names], np.int32)
            ids = np.array([n for x in names for n in held[x]], np.int64)
            columns = [pa.array([shard], pa.int32()), pa.array([size // 8], pa.int32()), pa.array([start], pa.int32())]
            columns += [pa.array([x], pa.binary()) for x in (vectors.tobytes(), graph.tobytes(), counts.tobytes(), ids.tobytes())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "size", "start", "vectors", "graph", "counts", "ids"])

    held, now = {}, None
    for batch in batches:
        for shard, vector, ids in zip(*(batch.column(n).to_pylist() for n in ("shard", "vector", "ids"))):
            if shard != now and held:
                yield from settle(now, held)
                held = {}
            now = shard
            known = held.get(vector)
            held[vector] = ids if known is None else sorted({*known, *ids})[:keep]
    if held:
        yield from settle(now, held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in blocks: packed ids and vectors of one length."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            ids, vectors = part.column("id").to_numpy(), part.column("vector").to_pylist()
            sizes = np.array([len(x) for x in vectors])
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                raw = np.array([vectors[k] for k in of], np.float64)
                columns = [pa.array([int(size)], pa.int32()), pa.array([raw.tobytes()], pa.binary()), pa.array([ids[of].astype(np.int64).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["size", "vectors", "ids"])


def _search(batches: Iterator[pa.RecordBatch], k: int, beam: int, longest: float) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by shard and length of vectors, its graph first: the best of the shard for every query."""
    names = ("shard", "size", "start", "vectors", "graph", "counts", "ids")
    now = None
    for batch in batches:
        for row in range(batch.num_rows):
            shard, size, start, vectors, graph, counts, ids = (batch.column(n)[row].as_py() for n in names)
            vectors = np.frombuffer(vectors).reshape(-1, size)
            ids = np.frombuffer(ids, np.int64)
            if graph is not None:
                now, exact, points, first = (shard, size), vectors, _lifted(vectors, longest), start
                edges = np.frombuffer(graph, np.int32).reshape(len(vectors), -1)
                ends = np.concatenate(([0], np.cumsum(np.frombuffer(counts, np.int32))))
                owners = ids
                continue
            if now != (shard, size):
                continue  # no vector of this length in the shard
            targets = np.concatenate((vectors / longest, np.zeros((len(vectors), 1))), axis=1).astype(np.float32)
            found, _ = beam_search(points, edges, first, targets, min(beam, len(points)))
            r, c = np.nonzero(found >= 0)
            node = found[r, c]
            score = np.einsum("ij,ij->i", exact[node], vectors[r])
            sizes = ends[node + 1] - ends[node]
            stops = np.cumsum(sizes)
            name = owners[np.repeat(ends[node] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
            r, score = np.repeat(r, sizes), np.repeat(score, sizes)
            other = name != ids[r]
            r, score, name = r[other], score[other], name[other]
            order = np.lexsort((-score, name, r))
            r, score, name = r[order], score[order], name[order]
            once = np.ones(len(r), bool)
            once[1:] = (r[1:] != r[:-1]) | (name[1:] != name[:-1])
            r, score, name = r[once], score[once], name[once]
            order = np.lexsort((name, -score, r))
            r, score, name = r[order], score[order], name[order]
            counted = np.bincount(r, minlength=len(vectors))
            place = np.arange(len(r)) - np.repeat(np.cumsum(counted) - counted, counted)
            top = place < k
            yield pa.RecordBatch.from_arrays([pa.array(ids[r[top]]), pa.array(name[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard_vectors: int = SHARD_VECTORS, beam: int = QUERY_BEAM, **settings) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product with each query: ``query_id, rank, vec_id, score``.

    A row is no neighbour of a query with its own id. Ties go to the smaller id; all
    candidates are returned if they are fewer. Rows without an id, and vectors that are null,
    empty, all zero or hold null or non-finite components take no part; vectors are
    compared with those of their length. Rows with one id and one vector are one; an id with
    several vectors has its largest product. The search is approximate, scores are exact;
    ``settings`` go to ``build_graph``.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        numbers = F.col(vector).cast("array<double>")
        return df.select(F.col(vec_id).cast("long").alias("id"), numbers.alias("vector")).where(F.col("id").isNotNull() & _usable("vector"))

    rows = usable(vectors)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    count, longest = rows.agg(F.count("*"), F.max(length)).first()
    shards = max(1, round(count / shard_vectors))
    longest = float(longest or 1.0)
    folded = rows.mapInArrow(partial(_fold, keep=k + 1), "vector binary, ids array<long>")
    dealt = folded.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    shape = "shard int, size int, start int, vectors binary, graph binary, counts binary, ids binary"
    built = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(partial(_build, keep=k + 1, longest=longest, settings=settings), shape)
    index = materialize(built)
    asked = usable(queries).distinct().mapInArrow(_blocks, "size int, vectors binary, ids binary")
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    missing = {n: F.lit(None).cast(t) for n, t in (("start", "int"), ("graph", "binary"), ("counts", "binary"))}
    together = index.unionByName(everywhere.withColumns(missing))
    together = together.repartition("shard").sortWithinPartitions("shard", "size", F.col("start").asc_nulls_last())
    found = together.mapInArrow(partial(_search, k=k, beam=beam, longest=longest), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
