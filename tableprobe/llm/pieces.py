"""Texts as pieces that a byte-level tokenizer encodes independently.

The pre-tokenizer always breaks before a single blank that stands between two
visible characters, and before and after a line break between two such. A text
cut there can be encoded piece by piece; as pieces repeat, each is encoded once
and then looked up. Other blanks (runs, odd spaces) are left inside a piece.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a worker remembers before it forgets those met only once; bounds its memory, not the result.
REMEMBER = 600_000


def _visible(character: str) -> bool:
    return character != " " and character.isprintable()


def cut(text: str) -> list[str]:
    """Pieces whose encodings, one after another, are the encoding of the text."""
    out, piece = [], ""
    for k, part in enumerate(text.replace("\n", " \n").split(" ")):
        part = part if k == 0 or part[:1] == "\n" else f" {part}"
        if piece and _visible(piece[-1]) and len(part) > 1 and _visible(part[1]):
            out.append(piece)
            piece = part
        else:
            piece += part
    return [*out, piece] if piece else out


class PieceTable:
    """Numbers pieces and holds their ids: ``encode`` maps new pieces to lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list], remember: int = REMEMBER):
        self.encode, self.remember = encode, remember
        self.new: list[str] = []
        self._keep([], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.number = {piece: n for n, piece in enumerate(pieces)}
        self.parts = _Parts(self)
        self.ids, self.ends = ids, ends
        self.met = np.zeros(len(pieces), np.int64)

    def _forget_rare(self) -> None:
        """Keep what was met again; if that is still too much, keep nothing."""
        wanted = np.flatnonzero(self.met > 1)
        if len(wanted) > self.remember // 2:
            wanted = wanted[:0]
        pieces = list(self.number)
        sizes = np.diff(self.ends)
        ids = self.ids[np.repeat(np.isin(np.arange(len(pieces)), wanted), sizes)]
        self._keep([pieces[n] for n in wanted], ids, np.concatenate(([0], np.cumsum(sizes[wanted]))))

    def of(self, piece: str) -> int:
        n = self.number.get(piece)
        if n is None:
            n = self.number[piece] = len(self.number)
            self.new.append(piece)
        return n

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts in a row, and how many each text has."""
        if max(len(self.number), len(self.parts)) > self.remember:
            self._forget_rare()
        found = self._fast(texts)
        if self.new:
            fresh = self.encode(self.new)
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(fresh), np.int32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])
            self.new = []
        numbers = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.met += np.bincount(numbers, minlength=len(self.met))
        return numbers, np.array([len(x) for x in found], np.int64)

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        """Piece numbers of each text. Arrow tells the different parts of all texts, so each is looked up once."""
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        at, parts = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        later = np.ones(len(at), bool)
        later[ends[:-1]] = False
        number = np.full(len(parts), -1, np.int64)
        wanted = np.flatnonzero(np.bincount(at[later], minlength=len(parts)))
        number[wanted] = self.parts.of([parts[k] for k in wanted.tolist()])
        numbers = number[at]
        unsafe = np.concatenate(([0], np.cumsum(later & (numbers < 0))))
        safe = unsafe[ends[1:]] == unsafe[ends[:-1]]
        found = []
        for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            first = parts[at[i]]
            if safe[k] and first and _visible(first[-1]):
                numbers[i] = self.of(first)
                found.append(numbers[i:j])
            else:
                found.append(np.fromiter(map(self.of, cut(texts[k])), np.int64))
        return found

    def token_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        numbers, pieces = self.numbers(texts)
        starts, sizes = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        total = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
        stops = np.concatenate(([0], np.cumsum(pieces)))
        return self.ids[at], np.diff(total[stops])


class _Parts(dict):
    """Part between blanks -> number of its piece, or -1 if the blanks beside it are no safe cuts."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table

    def of(self, parts: list[str]) -> list[int]:
        """Numbers of different parts."""
        numbers, new, out = self.table.number, self.table.new, []
        for part in parts:
            n = self.get(part)
            if n is None and part and part.isprintable():  # most new ones, and safe
                piece = f" {part}"
                before = len(numbers)
                n = self[part] = numbers.setdefault(piece, before)
                if n == before:
                    new.append(piece)
            out.append(self[part] if n is None else n)
        return out

    def __missing__(self, part: str) -> int:
        piece = part if part[:1] == "\n" else f" {part}"
        safe = len(piece) > 1 and _visible(piece[1]) and _visible(piece[-1])
        n = self[part] = self.table.of(piece) if safe else -1
        return n
