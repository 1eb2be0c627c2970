"""Hashed features of many words at once."""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(size, base, "u8"))])


class Words:
    """Words laid end to end as code points, with polynomial hashes of any of their parts modulo 2**64."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype("u8")
        self.sizes = np.fromiter(map(len, words), "i8", len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(points)) - np.repeat(self.starts, self.sizes)
        size = 1 << max(1, int(self.sizes.max(initial=1))).bit_length()
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), size)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, "u8"), np.cumsum((points + np.uint64(1)) * _powers(_BASE, size)[self.place])])

    def hashes(self, at: np.ndarray, size: np.ndarray | int, place: np.ndarray | int, kind: int) -> np.ndarray:
        """Hashes of the ``size`` code points from ``at`` on, which stand ``place`` points into their word."""
        with np.errstate(over="ignore"):
            x = (self.total[at + size] - self.total[at]) * self.inverse[place] + np.uint64(kind) * np.uint64(0xC2B2AE3D27D4EB4F)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def whole(self) -> np.ndarray:
        """A hash of each word."""
        return self.hashes(self.starts, self.sizes, 0, 0)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of at least ``size`` points, and hashes of their beginnings."""
        long = np.flatnonzero(self.sizes >= size)
        return long, self.hashes(self.starts[long], size, 0, size)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For every stretch of ``size`` points within a word: the word, and the stretch's hash wherever it stands."""
        word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.flatnonzero(self.place + size <= self.sizes[word])
        return word[at], self.hashes(at, size, self.place[at], size)
