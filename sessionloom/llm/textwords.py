"""Words of many texts at once as NumPy arrays: where they stand and a 64-bit hash of each, without a Python loop over words.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is the sum of byte values (a table of random 64-bit
numbers) times powers of an odd constant, from one running sum over all bytes, and mixed at the end; arithmetic is
modulo 2^64.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SPAN = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole number (a bijection)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BASE = int(numbers(1, 11)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = numbers(256, 7)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 19)
        step = np.full(size, base, U64)
        step[0] = 1
        held = np.multiply.accumulate(step)
        # longer ones are made anew: workers keep few megabytes
        if size <= 1 << 20:
            _powers[base] = held
    return held[:n]


class Words:
    """data: the texts' bytes joined by spaces; starts, ends: of each word in data; first[k]: text k's first word, first[-1]: their number."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        joined = b" ".join([t or b"" for t in texts])
        self.blob = joined.lower() if lower else joined
        self.data = np.frombuffer(self.blob, np.uint8)
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        space = np.ones(len(self.data) + 2, bool)
        space[1:-1] = _SPACE[self.data]
        turns = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = turns[0::2], turns[1::2]
        self.first = np.append(np.searchsorted(self.starts, begins), len(self.starts))

    def hashes(self) -> np.ndarray:
        """One a word, made in runs of words of about SPAN bytes, so that the arrays of 64-bit numbers a byte stay small."""
        out = np.empty(len(self.starts), U64)
        w = 0
        while w < len(out):
            a = int(self.starts[w])
            v = max(w + 1, int(np.searchsorted(self.ends, a + SPAN, side="right")))
            n = int(self.ends[v - 1]) - a
            total = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[self.data[a : a + n]] * powers(_BASE, n), out=total[1:])
            begin, end = self.starts[w:v] - a, self.ends[w:v] - a
            out[w:v] = mix((total[end] - total[begin]) * powers(_INVERSE, n)[begin])
            w = v
        return out

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive hashes (runs go over text borders; the caller leaves those out)."""
    if len(h) < n:
        return np.zeros(0, U64)
    factor = numbers(n, 1000 + seed) | U64(1)
    out = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * factor[k]
    return mix(out)


def window_grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """As ``grams`` for long runs: from one running sum, at a cost that doesn't grow with n."""
    if len(h) < n:
        return np.zeros(0, U64)
    base = int(numbers(1, 2000 + seed)[0]) | 1
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    m = len(h) - n + 1
    return mix((total[n:] - total[:m]) * powers(pow(base, -1, 1 << 64), m))
