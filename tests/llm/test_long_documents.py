"""Work in proportion to the length of a document, and notices that are hard to tell apart."""

import random
import time

import pytest

from tableprobe.llm import decontaminate, licenses, line_spread, ngrams
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string"


def test_blocks_find_every_place(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 2, 12, 31, 32, 33, 34, 63, 64, 65, 66, 300)]
    targets = [["a", "b", "a"], ["b"], ["b", "b", "a", "a", "b"]]
    wanted = spark.createDataFrame([(t,) for t in targets], "target array<string>")
    wanted = wanted.select("target", ngrams.hashed_targets(wanted["target"]).alias("hash"))
    docs = spark.createDataFrame([(n, t.split()) for n, t in enumerate(texts)], "doc_id long, words array<string>")
    got = sorted((r["doc_id"], r["at"], r["n"]) for r in ngrams.find_windows(docs, ["doc_id"], wanted, [1, 3, 5]).collect())
    split = [t.split() for t in texts]
    assert got == sorted((d, k, len(t)) for d, w in enumerate(split) for t in targets for k in range(len(w)) if w[k : k + len(t)] == t)


NOTICES = [
    "Released under the MIT License" + " the MIT License" * 40,
    "the MIT License " * 40 + "Released under the MIT License",
    "the MIT License " * 40,
    "Released under the the the MIT License",
    "Permission is hereby granted, without any charge, to any person obtaining a copy of this software and its associated documentation files",
    "Licensed under CC BY-NC 4.0 Licensed under CC BY-NC 4.0 and Licensed under the Apache License, Version 2.0",
    "under the MIT " * 3 + "License",
    "",
    None,
]


def test_labels_of_chained_notices(spark):
    docs = spark.createDataFrame([(n, t, "s") for n, t in enumerate(NOTICES)], SCHEMA)
    done = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for n, text in enumerate(NOTICES):
        more = brute.license_labels(text, licenses.TEMPLATES)
        base = set(done[n]["base_labels"].split(","))
        assert set(done[n]["labels"].split(",")) - base - {""} == set(more) - base, text
    assert [done[n]["labels"] for n in (0, 1)] == ["mit", "mit"] and done[0]["score"] == 1 and done[2]["labels"] == ""


def seconds(frame):
    frame.count()
    begin = time.time()
    assert frame.collect()
    return time.time() - begin


def long_text(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("what", ["benchmark", "licenses", "lines"])
def test_twice_the_length_is_about_twice_the_work(spark, what):
    """With a wide margin: work in the square of the length would take four times as long at 50,000 words and far more in all."""
    rng = random.Random(3)
    items = spark.createDataFrame([(k, long_text(rng, 40)) for k in range(20)], "item_id long, text string")

    def frame(n):
        if what == "lines":
            # ten sites share all their lines
            rows = [(d, "\n".join(f"line {k}" for k in range(n // 5)) + f"\nown {d}", f"s{d}") for d in range(10)]
            docs = spark.createDataFrame(rows, SCHEMA)
            return line_spread.dedup_lines(docs).selectExpr("sum(length(text)) AS n", "sum(n_removed) AS gone")
        docs = spark.createDataFrame([(0, long_text(rng, n), "s")], SCHEMA)
        if what == "licenses":
            return licenses.scan_licenses(docs)
        return decontaminate.contamination(docs, items)

    seconds(frame(1000))
    assert seconds(frame(100_000)) < 3 * seconds(frame(50_000)) + 1
