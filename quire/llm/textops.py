"""Words and their hashes, vectorised over the bytes of a text.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, which is what bytes.split() gives. Hashes are position-independent polynomials modulo 2**64 in an
odd base, mixed afterwards, so that any worker computes the same value for the same word.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_QBASE = 0xC2B2AE3D27D4EB4F
_CHUNK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    filled = 1
    step = _U(base)
    with np.errstate(over="ignore"):
        while filled < n:  # out[filled:2*filled] = out[:filled] * base**filled
            take = min(filled, n - filled)
            out[filled : filled + take] = out[:take] * step
            step = _U((int(step) * int(step)) & 0xFFFFFFFFFFFFFFFF)
            filled += take
    return out


class _Powers:
    """Powers of an odd base and of its inverse, grown as longer inputs come."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_QBASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words."""
    space = _SPACE[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return edge[0::2], edge[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; long texts go through in chunks that end between words."""
    out = np.empty(len(starts), dtype=np.uint64)
    data, first = np.frombuffer(raw, dtype=np.uint8), 0
    while first < len(starts):
        origin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, origin + _CHUNK, side="right")))
        stop = int(ends[last - 1])
        up, down = _BYTES.upto(stop - origin + 1)
        with np.errstate(over="ignore"):
            terms = (data[origin:stop].astype(np.uint64) + _U(1)) * up[: stop - origin]
            sums = np.empty(stop - origin + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(terms, out=sums[1:])
            s, e = starts[first:last] - origin, ends[first:last] - origin
            out[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    return mix(out)


class WindowHasher:
    """Hashes of word ranges of one text, by prefix sums over its word hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        up, self.down = _WORDS.upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(words * up[: self.n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            length = (end - start).astype(np.uint64)
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + length * _U(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        if self.n < width:
            return np.empty(0, dtype=np.uint64)
        start = np.arange(self.n - width + 1)
        return self.ranges(start, start + width)


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width consecutive values the index of its leftmost minimum."""
    at = np.arange(len(values))
    span = 1
    while span * 2 <= width:
        a, b = at[:-span], at[span:]
        at = np.where(values[a] <= values[b], a, b)
        span *= 2
    if span < width:
        a, b = at[: len(at) - (width - span)], at[width - span :]
        at = np.where(values[a] <= values[b], a, b)
    return at
