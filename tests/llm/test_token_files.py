"""Pieces that are encoded together come out as if each were encoded alone."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tableprobe.llm import token_files
from tableprobe.llm.bpe import Vocabulary
from tableprobe.llm.pieces import cut

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_joined_pieces():
    rng = np.random.default_rng(9)
    letters = [*"aeTn'st. ,\n\t 19é日🎉-_|<> ​́\r", "<|endoftext|>", "'ll", "  "]
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(3000)]
    pieces = [*{p for t in texts for p in cut(t)}]
    tokenizer = Tokenizer.from_file(FILE)
    sizes = np.array([len(x) for x in Vocabulary(FILE).bytes_of])
    expected = [x.ids for x in tokenizer.encode_batch(pieces, add_special_tokens=False)]
    assert sum(map(token_files._joins, pieces)) > 1000
    assert [[*map(int, x)] for x in token_files.encode_joined(tokenizer, sizes, pieces)] == expected
    assert token_files.encode_joined(tokenizer, sizes, []) == []
