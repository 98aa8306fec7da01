"""Frequent phrases by multikey quicksort of suffix pointers, scored by their weakest cut.

1. One pass counts words and leading pairs of words. Tasks fold what they have read
   before it is dealt out by hash.
2. The pairs that occur often enough go into a bitmap of fixed size. A second pass
   follows every pointer to a word as far as pairs in the bitmap reach; what does not
   begin with such a pair is abandoned there and then. False hits only cost work.
3. Pointers are dealt out by their leading pair and sorted in each part by three-way
   quicksort, word by word; sizes of equal partitions are counts, and partitions below
   the limit are left alone. The pointers of a very common pair are dealt out again by
   all their words; its partitions are then summed over the parts.

Words are compared by 64-bit hashes of language and word. The first pass holds each
hash against its word, so two words with one hash are an error, not a wrong count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.llm.arrow import chunks
from tableprobe.llm.recurring import pack, unpack
from tableprobe.llm.words import FACTOR, Words, mix
from tableprobe.plans.storage import materialize

LONGEST = 5
LEAST = 100
#: Pointers or pairs that a task gathers before it folds and sends them.
FOLD = 1_000_000
#: Bits of the filter for pairs (8 MB) and cells of the table of very common pairs (1 MB).
FILTER_BITS = 1 << 26
SPLIT_CELLS = 1 << 20
#: Pointers with one leading pair that are sorted in one part; more are dealt out again.
SPLIT_AT = 1_000_000
SPLIT_BY = 16

SEPARATORS = b".,;:!?" + bytes(range(0x0A, 0x0E))


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, and bytes that end a piece."""
    ends = np.zeros(256, bool)
    ends[list(SEPARATORS)] = True
    inside = ~ends
    inside[[0x20, 0x09]] = False
    return inside, ends


class Symbols:
    """Words of a batch as hashes of language and word, and which are followed by a word of their piece."""

    def __init__(self, batch: pa.RecordBatch):
        inside, ends = _classes()
        self.words = Words(batch.column("text"), inside)
        names = batch.column("lang").to_pylist()
        self.langs = sorted({*names})
        language = np.array([self.langs.index(x) for x in names], np.int64)
        self.lang = language[self.words.text]
        seeds = Words(pa.array(self.langs, pa.string()), np.ones(256, bool))
        seed = np.zeros(len(self.langs), np.uint64)
        seed[seeds.text] = seeds.hashes()
        self.hashes = mix(self.words.hashes(lower=True) + mix(seed + FACTOR)[self.lang])
        # zero stands for "no word" in pointers
        self.hashes[self.hashes == 0] = 1
        closed = np.concatenate(([0], np.cumsum(ends[self.words.data])))
        same = self.words.text[1:] == self.words.text[:-1]
        self.joined = np.concatenate((same & (closed[self.words.start[1:]] == closed[self.words.end[:-1]]), [False])) if len(self.hashes) else np.zeros(0, bool)

    def pairs(self) -> np.ndarray:
        """Hash of each word with the next one, where they are joined."""
        at = np.flatnonzero(self.joined)
        return mix(self.hashes[at] * FACTOR + self.hashes[at + 1])

    def bytes_of(self, at: np.ndarray) -> list[bytes]:
        raw, start, end = self.words.data.tobytes(), self.words.start, self.words.end
        return [raw[i:j].lower() for i, j in zip(start[at].tolist(), end[at].tolist())]


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(part[rows[0]]), rows


COUNTED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("lang", pa.string()), ("packed", pa.binary()), ("words", pa.binary())])


def _occurrences(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Words (kind 0) with their counts and bytes, and hashes of pairs (kind 1) with their counts."""

    def sum_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([c for _, c in held])).astype(np.uint64)

    def send(pairs: list, words: dict) -> pa.RecordBatch:
        rows = []
        if pairs:
            keys, counts = sum_up(pairs)
            rows += [(1, p, None, pack(keys[at], counts[at]), None) for p, at in _by_part((keys % np.uint64(parts)).astype(np.int64))]
        for lang, known in words.items():
            keys = np.fromiter(known, np.uint64, len(known))
            counts = np.fromiter((n for n, _ in known.values()), np.uint64, len(known))
            texts = [x for _, x in known.values()]
            rows += [(0, p, lang, pack(keys[at], counts[at]), b"\n".join([texts[k] for k in at])) for p, at in _by_part((keys % np.uint64(parts)).astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * 5, COUNTED)], schema=COUNTED)

    pairs, words, size = [], {}, 0
    for batch in chunks(batches):
        found = Symbols(batch)
        keys, counts = np.unique(found.pairs(), return_counts=True)
        pairs.append((keys, counts))
        size += len(keys)
        keys, first, counts = np.unique(found.hashes, return_index=True, return_counts=True)
        for key, n, lang, word in zip(keys.tolist(), counts.tolist(), found.lang[first].tolist(), found.bytes_of(first)):
            known = words.setdefault(found.langs[lang], {})
            before = known.get(key)
            if before is None:
                known[key] = (n, word)
            else:
                _same(before[1], word)
                known[key] = (before[0] + n, word)
        if size > FOLD or sum(map(len, words.values())) > FOLD // 4:
            yield send(pairs, words)
            pairs, words, size = [], {}, 0
    if pairs:
        yield send(pairs, words)


def _same(a: bytes, b: bytes) -> None:
    if a != b:
        raise ValueError(f"two words have one hash: {a!r} and {b!r}")


FREQUENT = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("hash", pa.int64()), ("word", pa.string()), ("n", pa.int64())])


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by part: words (kind 0) and pairs (kind 1) that occur ``least`` times, and all words per language (kind 2)."""

    def rows(kind: int, lang: str | None, keys: np.ndarray, words: list[bytes] | None, counts: np.ndarray) -> pa.RecordBatch:
        n = len(counts)
        texts = pa.nulls(n, pa.string()) if words is None else pa.array([x.decode() for x in words], pa.string())
        arrays = [pa.array([kind] * n, pa.int32()), pa.array([lang] * n, pa.string()), pa.array(keys.view(np.int64)), texts, pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, schema=FREQUENT)

    def settle(words: dict[str, list], pairs: list) -> Iterator[pa.RecordBatch]:
        for lang, held in words.items():
            columns = [unpack(x, 2) for x, _ in held]
            texts = [w for _, raw in held for w in raw.split(b"\n")]
            keys, first, back = np.unique(np.concatenate([c[0] for c in columns]), return_index=True, return_inverse=True)
            for word, k in zip(texts, first[back].tolist()):
                _same(word, texts[k])
            counts = np.bincount(back, np.concatenate([c[1] for c in columns]))
            often = np.flatnonzero(counts >= least)
            yield rows(0, lang, keys[often], [texts[k] for k in first[often]], counts[often])
            yield rows(2, lang, np.zeros(1, np.uint64), None, counts.sum(keepdims=True))
        if pairs:
            columns = [unpack(x, 2) for x in pairs]
            keys, back = np.unique(np.concatenate([c[0] for c in columns]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([c[1] for c in columns]))
            often = np.flatnonzero(counts >= least)
            yield rows(1, None, keys[often], None, counts[often])

    now, words, pairs = None, {}, []
    for batch in batches:
        for kind, part, lang, packed, texts in zip(*(batch.column(n).to_pylist() for n in COUNTED.names)):
            if part != now:
                yield from settle(words, pairs)
                now, words, pairs = part, {}, []
            if kind:
                pairs.append(packed)
            else:
                words.setdefault(lang, []).append((packed, texts))
    yield from settle(words, pairs)


def _pointers(batches: Iterator[pa.RecordBatch], parts: int, bits, levels, longest: int) -> Iterator[pa.RecordBatch]:
    """Pointers to words as rows of hashes, as far as frequent pairs may reach, folded and dealt out by leading pair."""
    schema = pa.schema([("part", pa.int64()), ("split", pa.int32()), ("packed", pa.binary())])
    bits, levels = (np.frombuffer(x.value, np.uint8) for x in (bits, levels))

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        words = np.concatenate(held, axis=1)
        whole = np.zeros(words.shape[1], np.uint64)
        for column in words:
            whole = mix(whole * FACTOR + column)
        order = np.argsort(whole, kind="stable")
        words, whole = words[:, order], whole[order]
        new = np.ones(len(whole), bool)
        new[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
        at = np.flatnonzero(new)
        words, whole, times = words[:, at], whole[at], np.diff([*at, len(order)]).astype(np.uint64)
        pair = mix(words[0] * FACTOR + words[1])
        level = levels[(pair >> np.uint64(8)) % np.uint64(SPLIT_CELLS)]
        sub = whole % (np.uint64(SPLIT_BY) ** level.astype(np.uint64))
        part = (mix(pair + sub) % np.uint64(parts)).astype(np.int64) * 2 + (level > 0)
        rows = []
        for p, at in _by_part(part):
            at = at[np.lexsort((words[1][at], words[0][at]))]
            rows.append((p >> 1, p & 1, pack(*words[:, at], times[at])))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    held, size = [], 0
    for batch in chunks(batches):
        found = Symbols(batch)
        n = len(found.hashes)
        if n < 2:
            continue
        goes_on = np.zeros(n, bool)
        at = np.flatnonzero(found.joined)
        bit = found.pairs() % np.uint64(FILTER_BITS)
        goes_on[at] = bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
        at = np.flatnonzero(goes_on)
        words = np.zeros((longest, len(at)), np.uint64)
        words[0] = found.hashes[at]
        on = np.ones(len(at), bool)
        for k in range(1, longest):
            on &= goes_on[np.minimum(at + k - 1, n - 1)]
            words[k, on] = found.hashes[at[on] + k]
        if len(at):
            held.append(words)
            size += len(at)
        if size > FOLD:
            yield send(held)
            held, size = [], 0
    if held:
        yield send(held)


def quicksort(words: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers, all partitions of a turn at once.

    ``words``: one row per word of the pointer, one column per pointer; zero ends it.
    Returns depth, one pointer and summed ``times`` for every equal partition of ``least``
    or more. Smaller partitions are abandoned.
    """
    longest, count = words.shape
    item, depth, sizes = np.arange(count), np.zeros(1, np.int64), np.array([count])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not count:
        return (np.zeros(0, np.int64),) * 3
    while len(item):
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        key = words[depth[owner], item]
        low, middle, high = key[starts], key[starts + sizes // 2], key[starts + sizes - 1]
        pivot = np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high))[owner]
        side = (key > pivot).astype(np.int64) - (key < pivot) + 1
        group = owner * 3 + side
        new_sizes = np.bincount(group, minlength=3 * len(sizes))
        new_starts = np.cumsum(new_sizes) - new_sizes
        place = np.empty(len(item), np.int64)
        for s in range(3):
            at = np.flatnonzero(side == s)
            before = np.cumsum(np.bincount(owner[at], minlength=len(sizes)))
            place[at] = new_starts[group[at]] + np.arange(len(at)) - np.concatenate(([0], before[:-1]))[owner[at]]
        moved = np.empty_like(item)
        moved[place] = item
        total = np.bincount(group, times[item], 3 * len(sizes)).astype(np.int64)
        new_depth = np.repeat(depth, 3)
        equal = np.arange(3 * len(sizes)) % 3 == 1
        ended = np.zeros(3 * len(sizes), bool)
        ended[1::3] = pivot[starts] == 0
        found = np.flatnonzero(equal & ~ended & (total >= least))
        out.append((new_depth[found] + 1, moved[new_starts[found]], total[found]))
        new_depth[equal] += 1
        alive = (new_sizes > 0) & (total >= least) & ~ended & (new_depth < longest)
        item = moved[np.repeat(alive, new_sizes)]
        depth, sizes = new_depth[alive], new_sizes[alive]
    return tuple(np.concatenate(x) for x in zip(*out))


def _sort(batches: Iterator[pa.RecordBatch], least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by part; equal partitions of each part. Parts of a split pair give all of theirs, to be summed."""

    def settle(split: int, held: list[bytes]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*(unpack(raw, longest + 1) for raw in held))]
        words, times = np.stack(columns[:-1]), columns[-1].astype(np.int64)
        depth, item, counts = quicksort(words, times, 1 if split else least)
        wanted = depth > 1
        depth, item, counts = depth[wanted], item[wanted], counts[wanted]
        ends = np.concatenate(([0], np.cumsum(depth))).astype(np.int32)
        k = np.arange(ends[-1]) - np.repeat(ends[:-1], depth)
        flat = words[k, np.repeat(item, depth)].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(counts)], ["hashes", "n"])

    now, held = None, []
    for batch in batches:
        for part, split, packed in zip(*(batch.column(n).to_pylist() for n in ("part", "split", "packed"))):
            if (part, split) != now and held:
                yield settle(now[1], held)
                held = []
            now = (part, split)
            held.append(packed)
    if held:
        yield settle(now[1], held)


def _packed_bits(pairs: DataFrame) -> bytes:
    """The filter: a bit for each frequent pair. At most ``FILTER_BITS`` / 64 rows reach the driver."""
    # the hash as an unsigned number, modulo a power of two
    bit = F.col("hash").bitwiseAND(FILTER_BITS - 1)
    found = pairs.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(hash & {FILTER_BITS - 1} & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return words.tobytes()


def _packed_levels(pairs: DataFrame, split_at: int) -> bytes:
    """How often each very common pair is split (0: not). At most ``SPLIT_CELLS`` rows reach the driver."""
    level = F.ceil(F.log(F.col("n") / split_at) / F.log(F.lit(float(SPLIT_BY)))).cast("int")
    cell = F.shiftrightunsigned("hash", 8).bitwiseAND(SPLIT_CELLS - 1)
    found = pairs.where(F.col("n") > split_at).groupBy(cell.alias("cell")).agg(F.max(level).alias("level")).toArrow()
    cells = np.zeros(SPLIT_CELLS, np.uint8)
    cells[found.column("cell").to_numpy()] = np.minimum(found.column("level").to_numpy(), 8)
    return cells.tobytes()


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", split_at: int = SPLIT_AT) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur ``least`` times (``lang, words, n``), and all words per language (``lang, n``).

    Null texts are empty, a null language is ``und``. Repeated rows count each time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * tasks, size // 3_000_000) | 1
    counted = rows.mapInArrow(partial(_occurrences, parts=parts), "kind int, part long, lang string, packed binary, words binary")
    met = counted.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_frequent, least=least), "kind int, lang string, hash long, word string, n long")
    known = materialize(met)
    pairs = known.where("kind = 1").select("hash", "n")
    totals = known.where("kind = 2").groupBy("lang").agg(F.sum("n").alias("n"))
    singles = known.where("kind = 0").select("lang", "hash", "word", "n")
    sent = [spark.sparkContext.broadcast(x) for x in (_packed_bits(pairs), _packed_levels(pairs, split_at))]
    reach = pairs.agg(F.sum("n")).first()[0] or 0
    parts = max(2 * tasks, reach // 300_000) | 1
    dealt = rows.mapInArrow(partial(_pointers, parts=parts, bits=sent[0], levels=sent[1], longest=longest), "part long, split int, packed binary")
    equal = dealt.repartition("part").sortWithinPartitions("part", "split").mapInArrow(partial(_sort, least=least, longest=longest), "hashes array<long>, n long")
    phrases = equal.groupBy("hashes").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # every word of a frequent phrase is a frequent word
    named = (
        phrases.select("hashes", "n", F.posexplode("hashes").alias("k", "hash"))
        .join(singles.select("hash", "lang", "word"), "hash")
        .groupBy("hashes")
        .agg(F.first("lang").alias("lang"), F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("words"), F.first("n").alias("n"))
    )
    every = named.select("lang", "words", "n").unionByName(singles.select("lang", F.array("word").alias("words"), "n"))
    return materialize(every), totals


def _cut_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (l * r)) without rounding: the products are decimals of 38 digits."""
    whole = "cast({} as decimal(19, 0))"
    return F.expr(f"(cast(1000 * {whole.format(a)} as decimal(22, 0)) * cast({n} as decimal(16, 0))) div ({whole.format(left)} * {whole.format(right)})")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = 2_000, text: str = "text", lang: str = "lang", split_at: int = SPLIT_AT) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Words are lower-cased runs without blanks, phrases stand inside pieces between marks and
    line breaks. ``a`` is how often the phrase occurs, ``l`` and ``r`` how often the two parts
    of its weakest cut, ``n`` the words of the language. Phrases inside a longer one that
    occurs as often are dropped. Ties go to more occurrences, then to the smaller phrase.

    Null texts are empty, a null language is ``und``; a table without phrases gives no rows.
    """
    counts, totals = frequent_phrases(docs, least, longest, text, lang, split_at)
    wanted = counts.where(F.size("words") > 1)
    inside = (
        wanted.where(F.size("words") > 2)
        .select("lang", "n", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"))
        .distinct()
    )
    kept = wanted.join(inside, ["lang", "words", "n"], "left_anti")
    cuts = kept.select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("slice(words, 1, k)"), "right": F.expr("slice(words, k + 1, size(words))")})
    cuts = cuts.join(counts.select("lang", F.col("words").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("words").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang").withColumn("score", _cut_score("a", "n", "l", "r"))
    best = cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
