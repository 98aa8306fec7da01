"""Byte-level BPE by speculation and verification.

A word is first cut greedily into the longest tokens. That cut is the BPE result
exactly when every two neighbours stay apart, that is, when no merge across their
border comes before the merges that build them. All neighbours of all new words
are tested at once in NumPy; only words with a failing border are merged step by
step. Words come from the pieces of ``pieces.py``, so each is worked on once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableprobe.llm.arrow import chunks, kept, lists, tidy
from tableprobe.llm.pieces import PieceTable

# Fixed value: the word pattern of this family of tokenizers.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = np.int64(1) << 40
#: What a worker remembers at most; bounds its memory, not the result.
WORDS_REMEMBERED = 250_000
PIECES_REMEMBERED = 400_000
#: Words of more bytes are merged one by one, which is not quadratic in their length.
TOGETHER_BYTES = 64
#: Bytes at the start of a token that tell how long one that begins with them can be.
HEAD = 3


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files: itself if visible, else the next free code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in visible}
    hidden = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """The tokens of a tokenizer file; all that decoding needs."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as file:
            self._read(json.load(file))

    def _read(self, whole: dict) -> None:
        self.added = {x["content"]: x["id"] for x in whole["added_tokens"]}
        vocab = whole["model"]["vocab"]
        byte_of = {letter: b for b, letter in byte_letters().items()}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of = [b""] * size
        for token, n in vocab.items():
            self.bytes_of[n] = bytes(byte_of[x] for x in token)
        for token, n in self.added.items():
            self.bytes_of[n] = token.encode()
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in self.bytes_of])))
        self.size = size

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of rows of ids; bytes that are no UTF-8 become replacement characters."""
        starts = self.at[ids]
        sizes = self.at[ids + 1] - starts
        ends = np.concatenate(([0], np.cumsum(sizes)))
        raw = self.flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        rows = ends[np.concatenate(([0], np.cumsum(counts)))]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(rows[:-1], rows[1:])]


class Bpe(Vocabulary):
    """A vocabulary with its merges."""

    def _read(self, whole: dict) -> None:
        super()._read(whole)
        vocab, size = whole["model"]["vocab"], self.size
        self.byte_id = np.array([vocab[x] for _, x in sorted(byte_letters().items())])
        # a merge's rank is when its token is made; single bytes are there from the start
        self.made = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(whole["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, token = (vocab[a], vocab[b]), vocab[a + b]
            self.merge[pair] = (rank, token)
            self.made[token], self.left[token], self.right[token] = rank, *pair
        keys = np.array([a * size + b for a, b in self.merge] or [-1], np.int64)
        ranks = np.array([r for r, _ in self.merge.values()] or [NEVER], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.pair_tokens = np.array([n for _, n in self.merge.values()] or [-1], np.int64)[order]
        self.tokens = {self.bytes_of[n]: n for n in vocab.values()}
        self._drop_unreachable()
        self.reach: dict[bytes, int] = {}
        for x in self.tokens:
            self.reach[x[:HEAD]] = max(self.reach.get(x[:HEAD], 0), len(x))
        added = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.added_pattern = regex.compile(f"({added})") if added else None
        self.word_pattern = regex.compile(WORD)
        self.words: dict[str, list[int]] = {}

    def _drop_unreachable(self) -> None:
        """Greedy cuts may use only tokens that their own bytes merge to."""
        merged = np.flatnonzero(self.made >= 0)
        fine = np.ones(self.size, bool)
        fine[merged] = self.apart(self.left[merged], self.right[merged], 2 * self.made[merged])
        for n in merged[np.argsort(self.made[merged])]:
            fine[n] &= fine[self.left[n]] and fine[self.right[n]]
        alone = self.made < 0
        self.tokens = {x: n for x, n in self.tokens.items() if fine[n] and not (alone[n] and len(x) > 1)}

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the tokens ``a`` and ``b``, side by side, are left as they are by the merges.

        Goes back in time from the finished pair: the part made later is taken apart,
        so (x, y) are the parts that meet at the border at that time. If they have a
        merge that comes earlier than the one undone last, the border would not have
        lasted. Of merges with one rank the leftmost comes first; times are doubled to
        tell "before" from "not after".
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        until = np.full(len(x), 2 * NEVER) if until is None else until.copy()
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            _, rank = self.rank(u, v)
            meet = 2 * rank < until[live]
            good[live[meet]] = False
            made_x, made_y = self.made[u], self.made[v]
            back_y = made_y >= made_x
            until[live] = np.where(back_y, 2 * made_y + 1, 2 * made_x)
            x[live] = np.where(back_y, u, self.right[u])
            y[live] = np.where(back_y, self.left[v], v)
            live = live[~meet & (np.maximum(made_x, made_y) >= 0)]
        return good

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and rank of the merge of each two tokens; never, if there is none."""
        keys = a * self.size + b
        slot = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return slot, np.where(self.pair_keys[slot] == keys, self.pair_ranks[slot], NEVER)

    def greedy(self, word: bytes) -> list[int]:
        out, at, end, tokens, reach = [], 0, len(word), self.tokens, self.reach
        while at < end:
            # no token of more bytes begins like this; shorter ones than the head are tried then
            stop = min(end, at + max(reach.get(word[at : at + HEAD], 0), HEAD - 1))
            while (n := tokens.get(word[at:stop])) is None:
                stop -= 1
            out.append(n)
            at = stop
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge step by step, lowest rank first, leftmost first within a rank."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (found := self.merge.get((ids[k], ids[after[k]]))):
                heapq.heappush(heap, (found[0], k, ids[k], ids[after[k]]))

        for k in range(len(ids)):
            offer(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt < 0 or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = self.merge[a, b][1], -1
            after[k] = after[nxt]
            if after[nxt] >= 0:
                before[after[nxt]] = k
            offer(before[k])
            offer(k)
        return [n for n in ids if n >= 0]

    def exact_together(self, words: list[bytes]) -> list[list[int]]:
        """``exact`` for many short words: a turn makes the next merge in every word that has one."""
        out: list = [None] * len(words)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(x) for x in words])
        slot, rank = np.zeros(len(ids), np.int64), np.full(len(ids), NEVER)  # of an id and the one after it

        def look(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at + 1 < len(ids))]
            at = at[word[at] == word[at + 1]]
            slot[at], rank[at] = self.rank(ids[at], ids[at + 1])

        look(np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            done = least == NEVER
            if done.any():
                flat = ids.tolist()
                for n, a, size in zip(word[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[n] = flat[a : a + size]
                live = np.repeat(~done, sizes)
                ids, word, slot, rank = ids[live], word[live], slot[live], rank[live]
                least, sizes = least[~done], sizes[~done]
            next_up = np.flatnonzero(rank == np.repeat(least, sizes))
            # leftmost first, as after a merge the rest may have others
            left = next_up[np.concatenate(([True], word[next_up[1:]] != word[next_up[:-1]]))] if len(next_up) else next_up
            ids[left] = self.pair_tokens[slot[left]]
            rank[left] = NEVER
            stay = np.ones(len(ids), bool)
            stay[left + 1] = False
            ids, word, slot, rank = ids[stay], word[stay], slot[stay], rank[stay]
            left = left - np.arange(len(left))
            inside = left[(left > 0)] - 1
            inside = inside[word[inside] == word[inside + 1]]
            rank[inside] = NEVER
            look(np.concatenate((inside, left)))
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [x.encode() for x in words]
        found = [*map(self.greedy, raw)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        if len(flat) > 1:
            word = np.repeat(np.arange(len(found)), sizes)
            inside = np.flatnonzero(word[:-1] == word[1:])
            pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            good = self.apart(pairs // self.size, pairs % self.size)[back]
            failed = np.unique(word[inside[~good]]).tolist()
            short = [n for n in failed if len(raw[n]) <= TOGETHER_BYTES]
            for n, ids in zip(short, self.exact_together([raw[n] for n in short])):
                found[n] = ids
            for n in failed:
                if len(raw[n]) > TOGETHER_BYTES:
                    found[n] = self.exact(raw[n])
        return found

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of whole texts, or of pieces of them."""
        if len(self.words) > WORDS_REMEMBERED:
            self.words = {}
        added = self.added_pattern is not None and self.added_pattern.search("".join(pieces)) is not None
        cut: list[list[str | int]] = [self._cut(x) for x in pieces] if added else [*map(self.word_pattern.findall, pieces)]
        words = self.words
        new = [x for x in dict.fromkeys(chain.from_iterable(cut)) if x not in words and isinstance(x, str)]
        words.update(zip(new, self.encode_words(new)))
        if added:
            return [[n for x in parts for n in ([x] if isinstance(x, int) else words[x])] for parts in cut]
        return [words[parts[0]] if len(parts) == 1 else [n for x in parts for n in words[x]] for parts in cut]

    def _cut(self, piece: str) -> list[str | int]:
        """Words, and the ids of added tokens."""
        parts: list[str | int] = []
        for k, part in enumerate(self.added_pattern.split(piece)):
            parts += [self.added[part]] if k % 2 else self.word_pattern.findall(part)
        return parts


@kept
def _worker(tokenizer_file: str) -> tuple[Bpe, PieceTable]:
    """One per worker, kept between tasks."""
    bpe = Bpe(tokenizer_file)
    return bpe, PieceTable(bpe.encode, PIECES_REMEMBERED)


@kept
def _vocabulary(tokenizer_file: str) -> Vocabulary:
    return Vocabulary(tokenizer_file)


@tidy
def _encode(batches: Iterator[pa.RecordBatch], tokenizer_file: str, column: str, ids_name: str) -> Iterator[pa.RecordBatch]:
    _, table = _worker(tokenizer_file)
    for batch in chunks(batches, column):
        ids, counts = table.token_ids([x or "" for x in batch.column(column).to_pylist()])
        others = [n for n in batch.schema.names if n != column]
        columns = [*[batch.column(n) for n in others], lists(ids.astype(np.int32), counts, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [*others, ids_name])


@tidy
def _decode(batches: Iterator[pa.RecordBatch], tokenizer_file: str, column: str, text_name: str) -> Iterator[pa.RecordBatch]:
    yield from _decoded(batches, _vocabulary(tokenizer_file), column, text_name)


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, column: str, text_name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids = part.column(column)
            counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = vocabulary.decode(ids.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_name])


def _encode_and_decode(batches: Iterator[pa.RecordBatch], tokenizer_file: str, column: str, ids_name: str, text_name: str) -> Iterator[pa.RecordBatch]:
    encoded = _encode(batches, tokenizer_file, column, ids_name)
    yield from _decoded(encoded, _worker(tokenizer_file)[0], ids_name, text_name)


def encode(docs: DataFrame, tokenizer_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the text by its token ids; null and empty texts give no ids. Other columns
    stay, repeated rows too; a column named like the new one is replaced."""
    others = docs.drop(ids)
    schema = T.StructType([*[f for f in others.schema.fields if f.name != text], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return others.mapInArrow(partial(_encode, tokenizer_file=tokenizer_file, column=text, ids_name=ids), schema)


def decode(tokens: DataFrame, tokenizer_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for; special tokens are written out, null ids give an empty
    text. A column named like the new one is replaced."""
    others = tokens.drop(text)
    schema = T.StructType([*others.schema.fields, T.StructField(text, T.StringType())])
    return others.mapInArrow(partial(_decode, tokenizer_file=tokenizer_file, column=ids, text_name=text), schema)


def encode_and_decode(docs: DataFrame, tokenizer_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode``, slice by slice in one worker, where each of the two would take one of its own."""
    others = docs.drop(ids, decoded)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    schema = T.StructType([*[f for f in others.schema.fields if f.name != text], *added])
    return others.mapInArrow(partial(_encode_and_decode, tokenizer_file=tokenizer_file, column=text, ids_name=ids, text_name=decoded), schema)
