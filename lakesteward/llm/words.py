"""Words and word shingles of many texts at once, as 64-bit hashes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A to Z are lower-cased and no other character is.
"""

from __future__ import annotations

import numpy as np

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


class Powers:
    """Powers of the hash's base and of its inverse, grown on demand and kept for a task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)]) for base in (_PRIME, _INVERSE)
            )


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text of a slice."""
    solid = _SOLID[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[heads] = solid[heads]
    return np.diff(np.searchsorted(np.flatnonzero(begin), offsets))


class Words:
    """Words of a slice: ``hashes``, byte ranges ``starts`` and ``ends``, and ``first`` word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: Powers) -> None:
        n = len(data)
        lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
        lower[65:91] += np.uint64(32)
        solid = _SOLID[data]
        begin, finish = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        finish[:-1] &= ~solid[1:]
        full = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        begin[heads], finish[tails] = solid[heads], solid[tails]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)
        powers.grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(lower[data] * powers.up[:n], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * powers.down[self.starts]
        self.hashes = mixed(raw + (self.ends - self.starts).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words and the first of each text; a text of fewer words is one run."""
        counts = np.diff(self.first)
        hashes, n = self.hashes, len(self.hashes)
        lengths = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        first = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(lengths, out=first[1:])
        most = max(n - k + 1, 0)
        runs = np.zeros(most, np.uint64)
        factor = np.uint64(1)
        for i in range(k):
            factor = np.uint64((int(factor) * _PRIME + 2 * i) % (1 << 64) | 1)
            runs += hashes[i : i + most] * factor
        out = np.zeros(first[-1], np.uint64)
        long = counts >= k
        inner = np.repeat(self.first[:-1][long] - first[:-1][long], lengths[long])
        at = np.repeat(long, lengths)
        out[at] = mixed(runs[np.flatnonzero(at) + inner] + np.uint64(k))
        for d in np.flatnonzero((counts > 0) & ~long):
            total = 0
            for h in hashes[self.first[d] : self.first[d + 1]].tolist():
                total = (total * _PRIME + h) % (1 << 64)
            out[first[d]] = mixed(np.array([total ^ int(counts[d])], np.uint64))[0]
        return out, first
