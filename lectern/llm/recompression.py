"""Recompression of word sequences with names that are the same wherever the words are.

Rounds name runs of one symbol and pairs of symbols in turn. A name is a 64-bit hash of what it
stands for, so every task gives the same run or pair the same name without a shared dictionary.
In a pair round a hash bit splits the symbols into left and right ones, and each left symbol
that stands before a right one is joined with it.

Whether a symbol comes out of a round depends on itself and at most the symbols beside it, so
each symbol carries its span of words and the wider span of words that decided it. Two places
with equal words over the deciding span have the same symbol there, whatever surrounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from lectern.llm.words import mix

#: Stands between documents; never part of a run or pair.
BORDER = np.uint64(0)
_RUN, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Symbols(NamedTuple):
    name: np.ndarray
    #: First word of the symbol.
    at: np.ndarray
    #: Words that decided it: from `low` up to `high`, end exclusive.
    low: np.ndarray
    high: np.ndarray


def first_level(words: np.ndarray) -> Symbols:
    at = np.arange(len(words), dtype=np.int32)
    return Symbols(words, at, at, at + np.int32(1))


def _decided_with_neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    low, high = s.low.copy(), s.high.copy()
    np.minimum(low[1:], s.low[:-1], out=low[1:])
    np.maximum(high[:-1], s.high[1:], out=high[:-1])
    return low, high


def name_runs(s: Symbols) -> Symbols:
    """Each run of one symbol becomes one symbol."""
    if not len(s.name):
        return s
    first = np.ones(len(s.name), bool)
    first[1:] = (s.name[1:] != s.name[:-1]) | (s.name[1:] == BORDER)
    low, high = _decided_with_neighbours(s)
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(s.name))
    length = (ends - starts).astype(np.uint64)
    name = s.name[starts]
    many = length > 1
    name[many] = mix(name[many] + length[many] * _RUN)
    return Symbols(name, s.at[starts], low[starts], high[ends - 1])


def name_pairs(s: Symbols, level: int) -> Symbols:
    """Each left symbol before a right one becomes one symbol with it."""
    if len(s.name) < 2:
        return s
    right = (s.name >> np.uint64(level % 64) & np.uint64(1)).astype(bool)
    inner = s.name != BORDER
    joined = ~right[:-1] & right[1:] & inner[:-1] & inner[1:]
    second = np.zeros(len(s.name), bool)
    second[1:] = joined
    head = np.zeros(len(s.name), bool)
    head[:-1] = joined
    low, high = s.low.copy(), s.high.copy()
    # a symbol left alone would have been joined with another neighbour on its open side
    alone = ~head & ~second
    lone_left = np.flatnonzero(alone[:-1] & ~right[:-1])
    high[lone_left] = np.maximum(high[lone_left], s.high[lone_left + 1])
    lone_right = np.flatnonzero(alone[1:] & right[1:]) + 1
    low[lone_right] = np.minimum(low[lone_right], s.low[lone_right - 1])
    heads = np.flatnonzero(head)
    name = s.name.copy()
    name[heads] = mix(s.name[heads] * _PAIR + mix(s.name[heads + 1]))
    high[heads] = np.maximum(high[heads], s.high[heads + 1])
    low[heads] = np.minimum(low[heads], s.low[heads + 1])
    kept = ~second
    return Symbols(name[kept], s.at[kept], low[kept], high[kept])


def levels(words: np.ndarray, rounds: int) -> Iterator[Symbols]:
    """The word sequence itself, then the symbols after each round."""
    s = first_level(words)
    yield s
    for level in range(rounds):
        s = name_pairs(name_runs(s) if level == 0 else s, level)
        yield s


def anchors(words: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `size` words (by its first word): a symbol decided by the window's words alone.

    It is the one with the least name (the first of equals) among those of the highest level that
    has any, so equal windows get the same symbol at the same place within them. A word is decided
    by itself, so every window gets one. Returned: for each window its key, the hash of the words
    that decided its symbol, and where the symbol starts. Windows with a border in them get what
    they get and must be left out.
    """
    n = max(0, len(words) - size + 1)
    most = np.iinfo(np.uint64).max
    best, place, key = np.full(n, most, np.uint64), np.full(n, -1, np.int32), np.zeros(n, np.uint64)
    upto = _prefix_hashes(words)
    for level, s in reversed([(i, s) for i, s in enumerate(levels(words, rounds)) if i in (0, rounds // 2, rounds)]):
        use = (s.high - s.low <= size) & (s.name != BORDER)
        gap = place < 0
        if not gap.any():
            break
        if level < rounds:
            # only symbols near a window that still has none
            some = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
            use &= some[np.minimum(s.at + 1, n)] > some[np.clip(s.at + 1 - size, 0, n)]
        name, at, low, high = s.name[use], s.at[use], s.low[use], s.high[use]
        decided = _range_hashes(upto, low, high)
        chosen = np.full(n, -1, np.int32)
        for back in range(size):
            p = at - np.int32(back)
            ok = np.flatnonzero((p <= low) & (p + size >= high) & (p >= 0) & (p < n))
            if level < rounds:
                ok = ok[gap[p[ok]]]
            ok = ok[name[ok] < best[p[ok]]]
            best[p[ok]], chosen[p[ok]] = name[ok], ok
        new = chosen >= 0
        place[new], key[new] = at[chosen[new]], decided[chosen[new]]
    return key, place


_BASE = 0x9E3779B97F4A7C15


def _prefix_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the words before each place times powers of a base, and powers of the base's inverse."""
    powers = np.ones(len(words) + 1, np.uint64)
    powers[1:] = np.uint64(_BASE)
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[:-1], out=sums[1:])
    inverse = np.ones(len(words) + 1, np.uint64)
    inverse[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    np.multiply.accumulate(inverse, out=inverse)
    return sums, inverse


def _range_hashes(upto: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sums, inverse = upto
    return mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64))
