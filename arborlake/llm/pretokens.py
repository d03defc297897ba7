"""Pre-tokens of byte-level BPE for many texts at once, as arrays.

A text is split as the byte-level pattern does: contractions after an apostrophe, then runs of letters, of numbers and
of other signs, each with one space before it, and runs of white space of which the last character stays out if
something follows. Special strings are cut out first. The split works on arrays of code points, not by pattern
matching, and names each pre-token by a 64-bit key, by two where keys meet, so that only different pre-tokens need encoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE, SPECIAL = range(5)
#: A code point that no text has; it stands for the special string.
MARK = 0x110000
CHARS = 1 << 19
GROUP = 6


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    every = "".join(map(chr, points))
    at = np.array(points)
    kinds = np.zeros(MARK + 1, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            kinds[at[m.start() : m.end()]] = kind
    kinds[MARK] = SPECIAL
    draw = np.random.default_rng(20)
    one, two = (draw.integers(0, 2**64, MARK + 1, dtype=np.uint64) for _ in range(2))
    width = np.ones(MARK + 1, dtype=np.uint8)
    width[0x80:] = 2
    width[0x800:] = 3
    width[0x10000:] = 4
    return kinds, one, two, width


_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(2 * n, 0x9E3779B97F4A7C15, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


@dataclass
class Split:
    """keys: of the different pre-tokens; words: their texts, None for the special string; which: for each pre-token in
    order, its place in keys; ends: for each text, how many pre-tokens end with it; starts: each pre-token's first code point."""

    keys: np.ndarray
    words: list[str | None]
    which: np.ndarray
    ends: np.ndarray
    starts: np.ndarray


def code_points(texts: list[str], special: str) -> np.ndarray:
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    if special not in joined:
        return points
    parts = []
    for text in texts:
        for i, part in enumerate(text.split(special)):
            if i:
                parts.append(np.array([MARK], dtype=np.uint32))
            parts.append(np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32))
    return np.concatenate(parts)


def split(texts: list[str], special: str) -> Split:
    """The pre-tokens of some texts; empty texts have none."""
    kinds, one, two, _ = _tables()
    points = code_points(texts, special)
    step = len(special) - 1
    lengths = np.array([len(t) - (step * t.count(special) if special in t else 0) for t in texts], dtype=np.int64)
    n = len(points)
    stops = np.cumsum(lengths)
    if n == 0:
        return Split(np.empty(0, np.uint64), [], np.empty(0, np.int64), np.zeros(len(texts), np.int64), np.empty(0, np.int64))
    kind = kinds[points]
    first = np.zeros(n + 1, dtype=bool)
    first[np.concatenate(([0], stops))] = True
    marks = np.flatnonzero(kind == SPECIAL)
    first[marks] = True
    first[marks + 1] = True
    before = np.concatenate(([OTHER], kind[:-1])).astype(np.uint8)
    after = np.concatenate((kind[1:], [OTHER])).astype(np.uint8)
    space = kind == SPACE
    joins = np.concatenate(([False], (points[:-1] == 0x20) & space[:-1])) & ~first[:-1] & ~space
    last_of_run = space & (after != SPACE) & ~first[1:]
    begin = first[:-1] | ((kind != before) & ~joins) | (last_of_run & (before == SPACE))
    for i in np.flatnonzero((points == 0x27) & begin).tolist():
        tail = "".join(chr(points[i + k]) for k in (1, 2) if i + k < n and not first[i + 1 : i + k + 1].any() and points[i + k] < MARK)
        size = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            begin[i + 1] = False
            if i + 1 + size < n:
                begin[i + 1 + size] = True
    starts = np.flatnonzero(begin)
    sizes = np.diff(np.concatenate((starts, [n])))
    power = _power(int(sizes.max()))[np.arange(n) - np.repeat(starts, sizes)]
    key = np.add.reduceat(one[points] * power, starts) + sizes.astype(np.uint64)
    check = np.add.reduceat(two[points] * power, starts)
    keys, seen, which = np.unique(key, return_index=True, return_inverse=True)
    if not (check[seen][which] == check).all():
        both, seen, which = np.unique(np.rec.fromarrays([key, check]), return_index=True, return_inverse=True)
        keys = both.f0
    parts = points[: n]
    words: list[str | None] = []
    for a, b in zip(starts[seen].tolist(), (starts[seen] + sizes[seen]).tolist()):
        words.append(None if parts[a] == MARK else parts[a:b].tobytes().decode("utf-32-le"))
    return Split(keys, words, which, np.searchsorted(starts, stops), starts)


def pieces(texts: list[str], chars: int = CHARS) -> Iterator[list[str]]:
    """Runs of consecutive texts of about ``chars`` characters."""
    size, run = 0, []
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            size, run = 0, []
    if run:
        yield run


def splits(texts: list[str], special: str) -> Iterator[list[Split]]:
    """The splits of consecutive runs of texts, GROUP runs at a time: what is encoded together and then forgotten."""
    group = []
    for run in pieces(texts):
        group.append(split(run, special))
        if len(group) == GROUP:
            yield group
            group = []
    if group:
        yield group
