"""Phrases against a plain version; odd texts, split pairs, and one pair in a third of all words."""

import re
from collections import Counter

import numpy as np
import pytest

from tableprobe.llm import collocations


def plain(rows, least, longest=5, top=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            count.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    wanted = {k: n for k, n in count.items() if n >= least and len(k[1]) > 1}
    inside = {(lang, w[i : i + k], n) for (lang, w), n in wanted.items() for k in range(2, len(w)) for i in range(len(w) - k + 1)}
    out = {}
    for (lang, w), a in wanted.items():
        if (lang, w, a) in inside:
            continue
        cuts = [(1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]], total[lang]))
    return {(lang, k): (x[2].decode(), -x[1], *x[3:], -x[0]) for lang, found in out.items() for k, x in enumerate(sorted(found)[:top], 1)}


def run(docs, **settings):
    got = collocations.collocations(docs, **settings).collect()
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got}


def made(seed=3):
    rng = np.random.default_rng(seed)
    words = np.array(["the", "The", "of", "É", "x", "日本", "a.b", "c,", "d\n", "e\t", " f", "!"])
    weights = np.array([30, 5, 12, 6, 8, 4, 3, 3, 3, 3, 2, 1]) / 80
    rows = [(["en", "de", None, ""][n % 4], " ".join(rng.choice(words, rng.integers(0, 60), p=weights))) for n in range(400)]
    # one pair with a third of all words behind it, a very long text, repeated rows
    rows += [("en", "hot pair " + " ".join(f"w{j}" for j in rng.integers(0, 30, 3))) for _ in range(800)]
    rows += [("en", "hot pair always the same"), (None, None), ("fr", ""), ("fr", "  "), ("xx", "lone")] * 20
    rows += [("en", "long text here " * 5000)]
    return rows


@pytest.mark.parametrize("split_at", [collocations.SPLIT_AT, 50])
def test_against_plain(spark, split_at):
    rows = made()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    expected = plain(rows, 20)
    assert len(expected) > 100 and {k for k, _ in expected} >= {"en", "de", "und", ""}
    assert run(docs, least=20, split_at=split_at) == expected
    assert run(docs, least=20, split_at=split_at, top=3) == {k: v for k, v in expected.items() if k[1] <= 3}


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([("en", "a b " * 300, 1, b"x")], "lang string, text string, n long, words binary")
    assert run(docs, least=100) == plain([("en", "a b " * 300)], 100)
    assert run(docs.limit(0)) == {}
    assert run(docs.select("lang", "n", "words", docs["lang"].alias("text")), least=2) == {}


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 4, (4, 500)).astype(np.uint64)
    ends = rng.integers(1, 5, 500)
    words[np.arange(4)[:, None] >= ends] = 0
    times = rng.integers(1, 6, 500)
    expected = Counter()
    for k in range(500):
        for d in range(1, ends[k] + 1):
            expected[tuple(words[:d, k].tolist())] += int(times[k])
    for least in (1, 40):
        depth, item, counts = collocations.quicksort(words, times, least)
        got = {tuple(words[:d, i].tolist()): n for d, i, n in zip(depth.tolist(), item.tolist(), counts.tolist())}
        assert got == {k: n for k, n in expected.items() if n >= least}


def test_two_words_with_one_hash_are_an_error():
    with pytest.raises(ValueError, match="one hash"):
        collocations._same(b"a", b"b")
