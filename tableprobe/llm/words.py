"""Words of many texts at once, as places and hashes in NumPy."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from tableprobe.llm.arrow import text_bytes

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
LETTERS_AND_DIGITS = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


@cache
def not_blank() -> np.ndarray:
    """Byte classes: words are what stands between ASCII blanks."""
    keep = np.ones(256, bool)
    keep[list(BLANKS)] = False
    return keep


@cache
def alphanumeric() -> np.ndarray:
    """Byte classes: words are runs of ASCII letters, digits and all other code points."""
    keep = np.zeros(256, bool)
    keep[list(LETTERS_AND_DIGITS)] = True
    return keep


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


@cache
def _codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * FACTOR)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


class _Powers:
    """Powers of the factor and of its inverse, made longer when needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, f)))) for f in (FACTOR, INVERSE))
        return self.up[:n], self.down


powers = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_codes(lower)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """``start``, ``end``: byte places of all words; ``first``: where each text's words begin (one more at the end)."""

    def __init__(self, column: pa.Array, keep: np.ndarray):
        self.data, self.texts = text_bytes(column)
        inside = keep[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        at = self.texts[:-1][self.texts[:-1] < len(inside)]
        opens[at] = inside[at]
        at = self.texts[1:][self.texts[1:] > 0] - 1
        closes[at] = inside[at]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.texts)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, lower)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of per-word values for each text."""
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words, and which of them lie inside one text."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = hashes[:n].copy()
        for j in range(1, k):
            out = out * FACTOR + hashes[j : n + j]
        return mix(out), self.text[:n] == self.text[k - 1 :]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that begins at one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change)[:n] > 0
