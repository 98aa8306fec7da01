"""Jaccard join of documents on their word n-grams, with signature trees.

Two documents link when their sets of shingles have a Jaccard similarity of 0.8 or
more. Linked documents must share one of the first shingles of their sets in any
fixed order, as many as the similarity leaves room for; that prefix decides which
documents meet. Where documents meet, they are put into a tree whose nodes hold the
OR of the token bitmaps below and the range of set sizes. Two trees are walked
together, and a pair of nodes is left out as soon as their sizes or common bits show
that no pair below can overlap enough.

Steps, each a Spark job whose result is stored:

1. Sets are digested; equal sets become one entity, so copies cost nothing further.
2. Entities with one smallest shingle are compared in blocks and linked at once.
   This joins most versions of a document, so later steps see few classes.
3. Prefix shingles held by two entities or more are found (``recurring.py``). Very
   common shingles, known from a bounded sample, come last in the order; the sample
   shifts work only, every result is exact.
4. Entities of different classes that share a prefix shingle meet in trees. Hot
   shingles are split: the largest class is dealt out over several blocks, entities
   of other classes go to each of them.
5. A group of these passes on a spanning forest of its candidates and one pair for each set
   that has any. These tell which classes may be connected at all: their clusters, in which
   every link that is missing lies. A cluster is joined on the sets themselves, so pairs
   that fail are neither stored nor tried again. Clusters of more than a block are linked
   block by block first, which leaves fewer classes; the last turn joins all their blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.arrow import chunks, tidy
from tableprobe.llm.components import components
from tableprobe.llm.recurring import parts_for, recurring
from tableprobe.llm.words import Words, mix, not_blank
from tableprobe.plans.storage import materialize

WIDTH = 5
PERCENT = 80
BLOCK = 2048
LEAF = 16
LEAST_BITS = 64
TURNS = 3
#: Shingles of the sets that are held together, unless one set has more.
BLOCK_ITEMS = 4_000_000
SAMPLE_DOCS = 4000
HOT_TOKENS = 50_000
#: Rows of a few numbers that may be broadcast; counted before, more are joined by shuffle.
BROADCAST_ROWS = 200_000


# --- sets -----------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text, ascending, one text after another, and where each text's begin."""
    words = Words(texts, not_blank())
    hashes = words.hashes(lower=True)
    grams, whole = words.grams(hashes, width)
    at = np.flatnonzero(whole)
    values, owner = grams[at], words.text[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole_text = np.array([_sequence(hashes[words.first[n] : words.first[n + 1]]) for n in short], np.uint64)
        values, owner = np.concatenate([values, whole_text]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(words.counts) + 1))


def _sequence(hashes: np.ndarray) -> np.uint64:
    total = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for x in hashes:
            total = total * np.uint64(0x9E3779B97F4A7C15) + x
    return mix(np.array([total]))[0]


def _per_set(reduce: np.ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ufunc over each set; zero for empty ones."""
    out = np.zeros(len(first) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        out[filled] = reduce.reduceat(values, first[filled])
    return out


def entities(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A digest of each set."""
    return mix(_per_set(np.add, mix(values ^ np.uint64(0x5851F42D4C957F2D)), first) + np.diff(first).astype(np.uint64))


def bitmap(values: np.ndarray) -> bytes:
    """One bit for each shingle, in a power of two of at least as many bits."""
    bits = LEAST_BITS
    while bits < len(values):
        bits *= 2
    flags = np.zeros(bits, bool)
    flags[(values & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


@tidy
def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        values, first = shingle_sets(batch.column("text"), width)
        sizes = np.diff(first)
        smallest = _per_set(np.minimum, mix(values ^ np.uint64(0x2545F4914F6CDD1D)), first)
        maps = [bitmap(values[a:b]) if b > a else None for a, b in zip(first[:-1], first[1:])]
        empty = sizes == 0
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("digest"),
                pa.array(entities(values, first).view(np.int64), mask=empty),
                pa.array(sizes.astype(np.int64)),
                pa.array(smallest.view(np.int64), mask=empty),
                pa.array(maps, pa.binary()),
            ],
            ["doc_id", "digest", "entity", "n", "smallest", "bitmap"],
        )


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in chunks(batches):
        values, first = shingle_sets(batch.column("text"), width)
        sizes = np.diff(first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((values, np.isin(values, hot), owner)) if len(hot) else np.arange(len(values))
        place = np.arange(len(values)) - first[owner]
        take = place < prefix_size(sizes, percent)[owner]
        yield values[order][take], entities(values, first)[owner[take]]


@tidy
def _all_shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        values, _ = shingle_sets(batch.column("text"), width)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["key"])


def common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles in 0.1 % of a bounded sample, at most ``HOT_TOKENS``; they only come last in the order."""
    every = max(1, rows.count() // SAMPLE_DOCS)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = sample.mapInArrow(partial(_all_shingles, width=width), "key long").groupBy("key").count().where(F.col("count") >= 4)
    top = counts.orderBy(F.desc("count"), "key").limit(HOT_TOKENS).select("key")
    return np.sort(np.array([r["key"] for r in top.collect()], np.int64).view(np.uint64))


# --- trees ----------------------------------------------------------------------------------------


def _halve(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded to ``width`` bytes."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap of sets of ``a`` and ``b`` shingles that links them."""
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Sets in order of size; leaves of up to ``LEAF``, nodes of two below. A node has the OR of its bitmaps and its range of sizes."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[bytes], percent: int):
        self.percent = percent
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.maps = [np.frombuffer(bitmaps[n], np.uint8) for n in self.order]
        # a leaf holds bitmaps of one width: folded to a much smaller one, they would rule out nothing
        widths = np.array([len(m) for m in self.maps])
        edges = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(sizes)]
        level = [self._leaf(a, min(a + LEAF, stop)) for start, stop in zip(edges, edges[1:]) for a in range(start, stop, LEAF)]
        while len(level) > 1:
            level = [self._join(level[n], level[n + 1]) if n + 1 < len(level) else level[n] for n in range(0, len(level), 2)]
        self.root = level[0]

    def _or(self, maps: list[np.ndarray]) -> np.ndarray:
        width = min(len(m) for m in maps)
        out = np.zeros(width, np.uint8)
        for m in maps:
            out |= _halve(m[None], width)[0]
        return out

    def _leaf(self, a: int, b: int) -> tuple:
        maps = self.maps[a:b]
        rows = np.stack(maps)
        return int(self.sizes[a]), int(self.sizes[b - 1]), self._or(maps), self._spare(self.sizes[a:b], rows), (a, b, rows), None

    def _spare(self, sizes: np.ndarray, rows: np.ndarray) -> dict[int, int]:
        """For each width down to the smallest: how many more shingles than bits a set has at most, folded to that width."""
        spare = {}
        while True:
            spare[rows.shape[1]] = int((sizes - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)).max())
            if rows.shape[1] <= LEAST_BITS // 8:
                return spare
            rows = _halve(rows, rows.shape[1] // 2)

    def _join(self, x: tuple, y: tuple) -> tuple:
        return x[0], y[1], self._or([x[2], y[2]]), {w: max(n, y[3][w]) for w, n in x[3].items() if w in y[3]}, None, (x, y)

    def _far(self, x: tuple, y: tuple) -> bool:
        """No set below ``x`` can link with one below ``y``."""
        low, high = (x, y) if x[0] <= y[0] else (y, x)
        if 100 * low[1] < self.percent * high[0]:
            return True
        width = min(len(x[2]), len(y[2]))
        common = int(np.bitwise_count(_halve(x[2][None], width)[0] & _halve(y[2][None], width)[0]).sum())
        # several shingles of a set may have one bit: at this width it has at most ``spare`` more shingles than bits
        return common + min(x[3][width], y[3][width]) < needed(x[0], y[0], self.percent)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of places (in the given rows) of pairs that may link, leaf pair by leaf pair."""
        stack = [(self.root, self.root)]
        while stack:
            x, y = stack.pop()
            if x is not y and self._far(x, y):
                continue
            if x[5] is None and y[5] is None:
                yield from self._leaf_pairs(x[4], y[4])
            elif x is y:
                p, q = x[5]
                stack += [(p, q), (q, q), (p, p)]
            elif y[5] is None or (x[5] is not None and x[1] - x[0] > y[1] - y[0]):
                stack += [(x[5][0], y), (x[5][1], y)]
            else:
                stack += [(x, y[5][0]), (x, y[5][1])]

    def _leaf_pairs(self, x: tuple, y: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = min(x[2].shape[1], y[2].shape[1])
        u, v = _halve(x[2], width), _halve(y[2], width)
        common = np.bitwise_count(u[:, None] & v[None]).sum(axis=2, dtype=np.int64)
        bits_u, bits_v = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (u, v))
        a, b = self.sizes[x[0] : x[1]], self.sizes[y[0] : y[1]]
        # bits of the one that the other lacks stand for at least one shingle each
        most = np.minimum(a[:, None] - (bits_u[:, None] - common), b[None] - (bits_v[None] - common))
        fits = most >= needed(a[:, None], b[None], self.percent)
        if x[0] == y[0]:
            fits = np.triu(fits, 1)
        i, j = np.nonzero(fits)
        if len(i):
            best = np.argsort(-common[i, j], kind="stable")
            yield self.order[x[0] + i[best]], self.order[y[0] + j[best]]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets link."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


# --- grouped work ---------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], block: int | None = None) -> Iterator[list[dict]]:
    """Rows that stand together with equal ``by``, in blocks of ``block`` rows if one is given."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (any(held[0][k] != row[k] for k in by) or (block and len(held) >= block)):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


@tidy
def _link_blocks(batches: Iterator[pa.RecordBatch], percent: int, by: list[str], block: int | None = None) -> Iterator[pa.RecordBatch]:
    """Links that connect all linked sets of a group; pairs in one class already (``label``, if there is one) are not compared."""
    for rows in _groups(batches, by, block):
        rows = list({r["entity"]: r for r in rows}.values())
        sets = [np.frombuffer(r["items"], np.uint64) for r in rows]
        tree = SignatureTree(np.array([len(s) for s in sets]), [bitmap(s) for s in sets], percent)
        _, label = np.unique([r.get("label", r["entity"]) for r in rows], return_inverse=True)
        out = []
        for i, j in tree.candidates():
            while len(i):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                if len(i):
                    if linked(sets[i[0]], sets[j[0]], percent):
                        out.append((rows[i[0]]["entity"], rows[j[0]]["entity"]))
                        label[label == label[j[0]]] = label[i[0]]
                    i, j = i[1:], j[1:]
        if out:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


@tidy
def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different classes that may link: as many as connect all that could be, and one at least of each set that has any.

    A group of n sets thus gives fewer than 2 n pairs.
    """
    for rows in _groups(batches, ["key", "salt"]):
        rows = list({r["entity"]: r for r in rows}.values())
        _, first = np.unique([r["label"] for r in rows], return_inverse=True)
        entity = np.array([r["entity"] for r in rows])
        tree = SignatureTree(np.array([r["n"] for r in rows]), [r["bitmap"] for r in rows], percent)
        label, alone = first.copy(), np.ones(len(rows), bool)
        one, two = [], []
        for i, j in tree.candidates():
            apart = first[i] != first[j]
            i, j = i[apart], j[apart]
            while len(i):
                new = (label[i] != label[j]) | alone[i] | alone[j]
                i, j = i[new], j[new]
                if len(i):
                    one.append(i[0])
                    two.append(j[0])
                    alone[i[0]] = alone[j[0]] = False
                    label[label == label[j[0]]] = label[i[0]]
                    i, j = i[1:], j[1:]
        if one:
            x, y = entity[one], entity[two]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in chunks(batches):
        # of rows with one id and one text, which are read alike, a task needs one
        batch = batch.take(pa.array([n for n, x in enumerate(batch.column("entity").to_pylist()) if not (x in seen or seen.add(x))], pa.int64()))
        values, first = shingle_sets(batch.column("text"), width)
        items = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(items, pa.binary())], [*kept, "items"])


def _sets_of(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Sets of the wanted rows (``own_id``, ``own_digest`` and more columns, which are returned), read from the text of one document each."""
    wanted = materialize(wanted)
    few = wanted.count() <= BROADCAST_ROWS
    same = rows["doc_id"].eqNullSafe(wanted["own_id"]) & (rows["digest"] == wanted["own_digest"])
    more = [(n, t) for n, t in wanted.dtypes if n not in ("own_id", "own_digest")]
    joined = rows.join(F.broadcast(wanted) if few else wanted, same).select(*[n for n, _ in more], "text")
    schema = ", ".join(f"{n} {t}" for n, t in more) + ", items binary"
    return joined.mapInArrow(partial(_sets, width=width), schema)


def _between_classes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with the classes of their ends, ``x, y``."""
    return pairs.join(labels.select(F.col("entity").alias("a"), F.col("label").alias("x")), "a").join(
        labels.select(F.col("entity").alias("b"), F.col("label").alias("y")), "b"
    )


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after more links between classes' members."""
    merged = components(_between_classes(links, labels).select(F.col("x").alias("a"), F.col("y").alias("b")))
    joined = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("into")), "label", "left")
    return materialize(joined.select("entity", F.coalesce("into", "label").alias("label")))


def _meet(hits: DataFrame, about: DataFrame, labels: DataFrame) -> DataFrame:
    """Entities of shared prefix shingles that stand in several classes, ready for trees: ``key, salt, entity, label, n, bitmap``."""
    known = materialize(hits.join(labels, "entity"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "entity")).alias(f"mark{k}") for k in (0, 1)]
    classes = known.groupBy("key", "label").agg(F.count("*").alias("rows"), *marks)
    again = [F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in (0, 1)]
    keys = classes.groupBy("key").agg(F.count("*").alias("classes"), F.sum("rows").alias("rows"), F.max_by("label", "rows").alias("largest"), *again)
    # a passage has many shingles that the same entities share: one of these is enough
    keys = keys.where(F.col("classes") > 1).groupBy("rows", "mark0", "mark1").agg(F.min_by(F.struct("key", "largest"), "key").alias("x"))
    keys = keys.select("x.key", "x.largest", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    rows = known.join(keys, "key").join(about.select("entity", "n", "bitmap"), "entity")
    own = F.array(F.pmod("entity", "blocks").cast("int"))
    salts: Column = F.when(F.col("label") == F.col("largest"), own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = rows.select("key", F.explode(salts).alias("salt"), "entity", "label", "n", "bitmap")
    return spread.repartition("key", "salt").sortWithinPartitions("key", "salt")


def _clusters(about: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the pairs, ``entity, label, own_id, own_digest, cluster, blocks``; sets of different clusters cannot link."""
    ends = materialize(_between_classes(pairs, labels))
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    both = F.array(F.struct(F.col("a").alias("entity"), F.col("x").alias("label")), F.struct(F.col("b").alias("entity"), F.col("y").alias("label")))
    sets = ends.select(F.explode(both).alias("e")).select("e.*").distinct().join(about.select("entity", "n", "own_id", "own_digest"), "entity")
    sets = materialize(sets.join(joined, "label"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int")
    return materialize(sets.join(sets.groupBy("cluster").agg(blocks.alias("blocks")), "cluster").drop("n"))


def _check(rows: DataFrame, clusters: DataFrame, width: int, percent: int, turn: int) -> DataFrame:
    """Links that connect all linked sets of a cluster; before the last turn, those of a block if it has several.

    In the last turn any two blocks of a cluster meet.
    """
    block = F.pmod(F.xxhash64(F.lit(turn), "entity"), "blocks").cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("low"), F.greatest(x, "block").alias("high")))
    # sets of one block meet wherever it meets another
    pairs = F.when(F.col("blocks") > 1, F.filter(others, lambda x: x["low"] != x["high"])).otherwise(others)
    salts = pairs if turn == TURNS else F.array(F.struct(F.col("block").alias("low"), F.col("block").alias("high")))
    sets = _sets_of(rows, clusters.select("own_id", "own_digest", "entity", "label", "cluster", "blocks", block.alias("block")), width)
    by = ["cluster", "low", "high"]
    spread = sets.select("cluster", F.explode(salts).alias("salt"), "entity", "label", "items").select("cluster", "salt.*", "entity", "label", "items")
    ready = spread.repartition(*by).sortWithinPartitions(*by)
    return ready.mapInArrow(partial(_link_blocks, percent=percent, by=by), "a long, b long")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Words are what stands between ASCII blanks, A-Z in lower case. A text with fewer
    than ``width`` words is one shingle; null texts and texts without words have none
    and are components of their own. ``component_id`` is the smallest id that can be
    reached by links. Rows with one id are one document each way: they get the
    component of their own text. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # an id may be null or stand beside several texts, so rows are told apart by the digest of the text as well
    told = rows.withColumn("digest", F.xxhash64("text"))
    described = told.mapInArrow(partial(_describe, width=width), "doc_id long, digest long, entity long, n long, smallest long, bitmap binary")
    every = materialize(described)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    about = materialize(
        every.where("entity is not null")
        .groupBy("entity")
        .agg(F.min(own).alias("own"), F.first("n").alias("n"), F.first("smallest").alias("smallest"), F.first("bitmap").alias("bitmap"))
        .select("entity", F.col("own.doc_id").alias("own_id"), F.col("own.digest").alias("own_digest"), "n", "smallest", "bitmap")
    )

    firsts = about.groupBy("smallest").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    salt = F.pmod("entity", F.ceil(F.col("rows") / BLOCK)).alias("salt")
    wanted = about.join(firsts, "smallest").select("own_id", "own_digest", "entity", "smallest", salt)
    blocks = _sets_of(told, wanted, width).repartition("smallest", "salt").sortWithinPartitions("smallest", "salt")
    links = materialize(blocks.mapInArrow(partial(_link_blocks, percent=percent, by=["smallest", "salt"], block=BLOCK), "a long, b long"))
    labels = _relabel(about.select("entity", F.col("entity").alias("label")), links)

    hot = common_shingles(rows, width)
    total = about.agg(F.sum("n")).first()[0] or 0
    prefixes = partial(_prefixes, width=width, percent=percent, hot=hot)
    found = recurring(rows, prefixes, parts_for(docs, total * (100 - percent) / 100))
    hits = materialize(found.select(F.col("owner").alias("entity"), "key").repartition("entity").distinct())
    for turn in range(TURNS + 1):
        pairs = materialize(_meet(hits, about, labels).mapInArrow(partial(_candidates, percent=percent), "a long, b long").distinct())
        clusters = _clusters(about, labels, pairs)
        links = materialize(_check(told, clusters, width, percent, turn))
        labels = _relabel(labels, links)
        large = clusters.where(F.col("blocks") > 1).select("entity")
        if turn == TURNS or not large.limit(1).count():
            break
        hits = materialize(hits.join(large, "entity", "left_semi"))

    smallest = labels.join(about.select("entity", "own_id"), "entity").groupBy("label").agg(F.min("own_id").alias("component_id"))
    classes = labels.join(smallest, "label").select("entity", "component_id")
    return every.join(classes, "entity", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents of a component other than its first; of repeated ids all rows of the first stay."""
    classes = similar_documents(docs, doc_id, width, percent).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("dropped")).distinct()
    return docs.join(classes, docs[doc_id].cast("long") == classes["dropped"], "left_anti")
