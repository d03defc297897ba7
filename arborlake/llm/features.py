"""Statistics of whole documents as arrays, for many texts at once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

PIECE = 1 << 19
LETTER, CAPITAL, DIGIT, SPACE, SIGN = 1, 2, 4, 8, 16


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its flags, its small letter and a random number."""
    flags = np.zeros(0x110000, dtype=np.uint8)
    small = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        flags[c] = (kind[0] == "L") * LETTER | (kind == "Lu") * CAPITAL | (kind[0] == "N") * DIGIT | (kind[0] == "Z" or 9 <= c <= 13) * SPACE | (kind[0] in "PS") * SIGN
        if kind == "Lu" and len(low := chr(c).lower()) == 1:
            small[c] = ord(low)
    return flags, small, np.random.default_rng(31).integers(0, 2**64, 0x110000, dtype=np.uint64)


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(2 * n, 0x9E3779B97F4A7C15, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each run of code points [start, end); runs are in order, apart and not empty."""
    if len(starts) == 0:
        return np.empty(0, dtype=np.uint64)
    numbers = _tables()[2]
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    take = inside + np.repeat(starts, sizes)
    return np.add.reduceat(numbers[points[take]] * powers(int(sizes.max()))[inside], before) + sizes.astype(np.uint64)


def word_hash(word: str) -> int:
    points = np.array([ord(c) for c in word], dtype=np.uint32)
    return int(hashes(points, np.array([0]), np.array([len(points)]))[0])


class Texts:
    """Some texts as one array of code points, with each text's bounds."""

    def __init__(self, texts: list[str]) -> None:
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        flags, small, _ = _tables()
        self.kind = flags[self.points]
        self.small = small[self.points]
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        self.number = len(texts)
        self.first = np.zeros(len(self.points) + 1, dtype=bool)
        self.first[self.bounds] = True

    def total(self, flag: np.ndarray) -> np.ndarray:
        """For each text, how many of its characters have the flag."""
        sums = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return (sums[self.bounds[1:]] - sums[self.bounds[:-1]]).astype(np.float64)

    def runs(self, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of flagged characters within texts, and each run's text."""
        if len(flag) == 0:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        edge = np.concatenate(([True], flag[:-1] != flag[1:])) | self.first[:-1]
        at = np.flatnonzero(edge)
        ends = np.concatenate((at[1:], [len(flag)]))
        ok = flag[at]
        starts, ends = at[ok], ends[ok]
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1

    def per_text(self, own: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(own, weight, minlength=self.number).astype(np.float64)

    def different(self, own: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For each text, how many different values it has."""
        key = value + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        _, at = np.unique(key, return_index=True)
        return self.per_text(own[at])


def pieces(texts: list[str | None], size: int = PIECE):
    """Consecutive runs of texts of about ``size`` characters; nulls are empty."""
    run: list[str] = []
    chars = 0
    for t in texts:
        run.append(t or "")
        chars += len(run[-1])
        if chars >= size:
            yield run
            run, chars = [], 0
    if run:
        yield run
