"""The trees and the join against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from tableprobe.llm import signature_tree
from tableprobe.llm.signature_tree import PERCENT, SignatureTree, bitmap, linked
from tests.llm import brute


def candidates(sets):
    tree = SignatureTree(np.array([len(s) for s in sets]), [bitmap(s) for s in sets], PERCENT)
    return {(min(i, j), max(i, j)) for a, b in tree.candidates() for i, j in zip(a.tolist(), b.tolist())}


@pytest.mark.parametrize("power", [6, 7, 8, 10])
def test_no_link_is_pruned_next_to_a_power_of_two(power):
    """Near copies whose bitmaps have different widths, among sets that are not alike."""
    rng = np.random.default_rng(power)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = range(2**power - 3, 2**power + 4)
    sets = []
    for _ in range(12):
        base = fresh(2**power + 4)
        sets += [np.sort(np.concatenate([base[: n - 2], fresh(2)])) for n in near] + [np.sort(base[:n]) for n in near]
    sets += [np.sort(fresh(int(n))) for n in rng.integers(1, 2 ** (power + 1), 60)]
    found = candidates(sets)
    links = {(i, j) for j in range(len(sets)) for i in range(j) if linked(sets[i], sets[j], PERCENT)}
    assert len(links) >= 12 * 91 and links <= found
    assert len(found) < len(sets) * (len(sets) - 1) // 4
    # alone in their leaves, where no other set adds bits
    assert [(sets[i], sets[j]) for i, j in links if not candidates([sets[i], sets[j]])] == []


def test_near_copies_next_to_a_power_of_two(spark):
    rows = []
    for size in (64, 128, 256):
        for g in range(8):
            words = [f"p{size}g{g}w{k}" for k in range(size + 5)]
            rows += [(len(rows) + k, " ".join(words[: size + 4 + k])) for k in (0, 1)]
    got = signature_tree.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = brute.similar([{"doc_id": n, "text": t} for n, t in rows])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == expected
    assert all(expected[n][1] == n - n % 2 for n in expected)


def versions(name, count):
    """Near copies that differ in their first words or their last ones, so they have different smallest shingles."""
    words = [f"{name}{k}" for k in range(120)]
    return [" ".join(words[k:] if k % 2 else words[: 120 - k]) for k in range(count)]


def test_null_ids_have_near_copies(spark):
    """Of each other, and of documents with an id."""
    rows = [(None, t) for t in versions("none", 8)] + [(None if k % 2 else k, t) for k, t in enumerate(versions("some", 8))]
    rows += [(None if k else 50, t) for n in range(12) for k, t in enumerate(versions(f"more{n}x", 2))]
    got = signature_tree.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert sorted(r["component_id"] for r in got if r["component_id"] is not None) == [0] * 8 + [50] * 24


def test_texts_with_one_id_are_not_mixed(spark):
    """Each id has a version of two documents; a set of the wrong text would lose links or invent some."""
    rows, expected = [], []
    for n in range(12):
        left, right = versions(f"left{n}x", 4), versions(f"right{n}x", 4)
        for k in range(4):
            rows += [(100 * n + k, left[k]), (100 * n + (k + 1) % 4 + 10 * (k == 3), right[k])]
            expected += [100 * n, 100 * n + 1]
    docs = spark.createDataFrame([(*r, e) for r, e in zip(rows, expected)], "doc_id long, text string, expected long").repartition(3)
    got = sorted((r["doc_id"], r["component_id"]) for r in signature_tree.similar_documents(docs).collect())
    assert got == sorted((r[0], e) for r, e in zip(rows, expected))


def family(name, count, words, own):
    """Texts with common words in the middle and ``own`` of their own before and after; of pairs of them, ``own`` decides."""
    common = " ".join(f"{name}{k}" for k in range(words))
    return [" ".join([*(f"{name}a{c}x{k}" for k in range(own)), common, *(f"{name}z{c}x{k}" for k in range(own))]) for c in range(count)]


def test_pairs_that_fail_do_not_grow_with_the_square(spark, monkeypatch):
    """120 sets that are just not alike in pairs: what is stored on the way stays in proportion to them."""
    rows = list(enumerate(family("near", 120, 62, 4)))
    stored = []

    def counted(df, store=signature_tree.materialize):
        out = store(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(signature_tree, "materialize", counted)
    got = signature_tree.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = brute.similar([{"doc_id": n, "text": t} for n, t in rows])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == expected
    assert all(expected[n][1] == n for n in expected)
    values, first = signature_tree.shingle_sets(pa.array([t for _, t in rows]), signature_tree.WIDTH)
    assert len(candidates([values[a:b] for a, b in zip(first[:-1], first[1:])])) > 40 * len(rows)  # bitmaps do not tell them apart
    assert max(stored) < 40 * len(rows)


def test_clusters_of_many_blocks(spark, monkeypatch):
    """Links across blocks, next to pairs that fail, are found whatever the size of a block."""
    monkeypatch.setattr(signature_tree, "BLOCK", 6)
    texts = family("near", 30, 62, 4) + [t for g in range(6) for t in versions(f"v{g}x", 10)]
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[4 * k : 4 * k + 100]) for k in range(20)]
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    got = signature_tree.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    expected = brute.similar([{"doc_id": n, "text": t} for n, t in rows])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == expected
