"""Executor-side text kernels: ASCII-blank words, word hashes and window hashes in numpy.

Every function works on one whole text. Word hashes are kept in a cache of bounded size, so
memory does not follow the vocabulary.
"""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1
#: Odd multipliers of the two window polynomials (mod 2**64) and of the finaliser.
MULT_A = 0x9E3779B97F4A7C15
MULT_B = 0xD6E8FEB86659FD93
MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordCache(dict):
    """Maps a word (bytes) to ``make(word)``; emptied when it reaches ``limit`` entries."""

    def __init__(self, make, limit: int = 250_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def split_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text: ``bytes.split`` knows these six blanks only."""
    return raw.split() if raw else []


class Powers:
    """Powers of an odd multiplier and of its inverse mod 2**64, grown on demand."""

    def __init__(self, mult: int):
        self.mult, self.inverse, self.size = mult, pow(mult, -1, 1 << 64), 0

    def upto(self, n: int):
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            for name, m in (("up", self.mult), ("down", self.inverse)):
                a = np.full(self.size, m, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class WindowHash:
    """64-bit hashes of all windows of ``width`` entries, from prefix sums of a polynomial."""

    def __init__(self, mult: int):
        self.powers = Powers(mult)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        up, _ = self.powers.upto(len(h))
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up, out=out[1:])
        return out

    def at(self, prefix: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        _, down = self.powers.upto(len(prefix))
        return mix((prefix[start + width] - prefix[start]) * down[start])


def runs_to_mask(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places are covered by [start, start + width) of any start."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:n]) > 0
