"""Pieces are looked up once for each different one, words are merged together, and the ids stay those of the tokenizer."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tableprobe.llm import bpe, token_files
from tableprobe.llm.pieces import PieceTable

FILE = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [*"aeTn'st. ,\n\t 19é日🎉-_|<>  ​́\r", "<|endoftext|>", "'ll", "  ", " the", " and"]


def odd_texts() -> list[str]:
    rng = np.random.default_rng(17)
    texts = ["".join(rng.choice(LETTERS, rng.integers(0, 60))) for _ in range(2000)]
    return [*texts, "", " ", "\n", "a  b", "one two one two\nthree"]


def test_ids_of_both_tables():
    texts = odd_texts()
    expected = [x.ids for x in Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)]
    for table in (token_files._table.__wrapped__(FILE), bpe._worker.__wrapped__(FILE)[1]):
        table.remember = 2000  # forgets on the way
        got = []
        for k in range(0, len(texts), 150):
            ids, counts = table.token_ids(texts[k : k + 150])
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == expected
        ids, counts = table.token_ids([])
        assert len(ids) == len(counts) == 0


def test_a_part_is_looked_up_once_in_a_slice():
    looks = []

    def encode(pieces: list[str]) -> list[list[int]]:
        return [[len(x)] for x in pieces]

    class Counting(str):
        def replace(self, *args):  # what is done for every text, word by word, in Python
            looks.append(self)
            return str.replace(self, *args)

    ids, counts = PieceTable(encode).token_ids([Counting("one two one two")] * 100)
    assert ids.tolist() == [3, 4, 4, 4] * 100 and counts.tolist() == [4] * 100
    assert not looks


def test_short_words_are_merged_together():
    rng = np.random.default_rng(23)
    table = bpe.Bpe(FILE)
    words = [x.encode() for x in {"".join(rng.choice([*"aaeeiosthnrlmé日.'-"], rng.integers(1, 40))) for _ in range(2000)}]
    expected = [table.exact(x) for x in words]
    table.exact = None  # is for long ones
    assert table.exact_together(words) == expected
    assert table.exact_together([]) == []
    assert table.encode_words([x.decode() for x in words]) == expected
