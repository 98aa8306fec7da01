"""Token alignment against a plain version that walks every text token by token."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tableprobe.llm import alignment
from tableprobe.llm.bpe import byte_letters
from tableprobe.llm.queries import QUERIES
from tests.conftest import SMALL

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "", " ", "  ", "\n", "\n\n x", " \n b", "a\nb", "a\r\nb \r\n c", "tab\tq", "x ▁ y", "▁", "<s> <0x41> </s> <unk> <|endoftext|>", "<|endoftext|>", "  two  blanks  ", "﻿a", "​x 　a", "a\x00b", "é é Ａ 日本 🎉🎉 👩‍👩‍👧",
    "=" * 300, " " * 100 + "x", "don't 'll we've", "a" * 500, "   ", "1234567 89", "x ́y", "mixed 日本 and \n\n\t lines ; {\r\n}",
]


def plain(texts):
    tokenizer, model = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    tokenizer.encode_special_tokens = True
    byte_of = {letter: b for b, letter in byte_letters().items()}
    found, held = [], Counter()
    for text in texts:
        a, b, groups = [], [], []
        links = Counter()
        if text:
            a, b = tokenizer.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)
            a_bytes = [bytes(byte_of[c] for c in tokenizer.id_to_token(n)) for n in a]
            b_bytes = [bytes([int(model.id_to_piece(n)[3:5], 16)]) if model.is_byte(n) else model.id_to_piece(n).replace("▁", " ").encode() for n in b]
            if b"".join(a_bytes) != f" {text}".encode() or b"".join(b_bytes) != f" {text}".encode():
                a, b, a_bytes, b_bytes = [], [], [], []
            i = j = a_end = b_end = 0
            left, right = [], []
            while i < len(a) or j < len(b):
                if a_end <= b_end:
                    left.append(a[i])
                    a_end, i = a_end + len(a_bytes[i]), i + 1
                else:
                    right.append(b[j])
                    b_end, j = b_end + len(b_bytes[j]), j + 1
                if a_end == b_end:
                    groups.append((left, right))
                    links.update((x, y) for x in left for y in right)
                    left, right = [], []
        held.update(links.keys())
        found.append((a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups, links in found:
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        n_best = sum(m for p, m in links.items() if held[p] == best[p[0]])
        out.append((len(a), len(b), len(groups), links.total(), n_best, sum(m * held[p] for p, m in links.items()), digest))
    return out


def test_query(spark):
    rows = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in QUERIES["op11_pair_bitmaps"](spark, SMALL).collect()}
    assert got == dict(zip((r["doc_id"] for r in rows), plain([r["text"] for r in rows])))


@pytest.mark.parametrize("entries", [alignment.BLOCK_ENTRIES, 20])
def test_odd_texts_repeats_and_small_blocks(spark, entries):
    rng = np.random.default_rng(5)
    texts = [None, *ODD, *ODD[5:9], *["".join(rng.choice([*"ab \n\t.é日▁'<|"], 40)) for _ in range(200)]]
    rows = [(n if n % 5 else None, x, n) for n, x in enumerate(texts)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("block", T.LongType(), False)])
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = alignment.align(docs, *FILES, block_entries=entries)
    assert got.columns == ["doc_id", "block", *NAMES[:4], "n_best", "count_sum", "groups_sha256"]
    got = sorted((r["block"], tuple(r[n] for n in NAMES)) for r in got.collect())
    assert [x for _, x in got] == plain(texts) and [k for k, _ in got] == [*range(len(texts))]


def test_columns_like_the_new_ones_are_replaced_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two", 7, "y")], "doc_id long, text string, n_a long, pairs string")
    row = alignment.align(docs, *FILES).first()
    assert row["n_a"] == 2 and row["pairs"] == "y"
    assert alignment.align(docs.limit(0), *FILES).collect() == []


def test_bitmaps_come_back():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 50, 3000))
    numbers = rng.integers(0, 700, 3000)
    keys, numbers = np.unique(keys * 1000 + numbers) // 1000, np.unique(keys * 1000 + numbers) % 1000
    keys, numbers = np.concatenate((keys, np.full(600, 55))), np.concatenate((numbers, np.arange(600)))
    held = alignment.Bitmaps.of(keys, numbers, 60, 700)
    again, end = alignment.Bitmaps.read(b"xx" + held.to_bytes(), 2)
    assert end == 2 + len(held.to_bytes())
    assert again.popcounts().tolist() == np.bincount(keys, minlength=60).tolist()
    assert {*zip(*(x.tolist() for x in again.entries()))} == {*zip(keys.tolist(), numbers.tolist())}
