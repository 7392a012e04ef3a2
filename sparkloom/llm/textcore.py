"""Vectorised work on UTF-8 bytes: words, hashes of words and of word windows.

A chunk is many texts joined by newlines, so one pass of numpy serves all of
them. Every separator is ASCII, hence bytes can be split without decoding.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table_of(pattern_bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: Words are runs of anything but ASCII white space.
BLANK = table_of([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, letters a-z and bytes of non-ASCII characters.
NOT_ALNUM = table_of([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            seq = np.full(size, U64(base), U64)
            seq[0] = U64(1)
            _powers[k] = np.multiply.accumulate(seq)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Chunk:
    """Words of several texts: ``starts``/``ends`` are byte positions, ``first[d]:first[d+1]`` the words of text d."""

    def __init__(self, items: list[bytes], separator: np.ndarray = BLANK, lower: bool = False):
        joined = b"\n".join(items) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        self.buf = LOWER[self.raw] if lower else self.raw
        lengths = np.fromiter((len(x) for x in items), np.int64, len(items))
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        word = np.empty(len(self.buf) + 1, bool)
        word[0] = False
        np.logical_not(separator[self.buf], out=word[1:])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.begin)
        self.n_words = np.diff(self.first)
        self._prefix = None

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes."""
        power, inverse = powers(len(self.buf))
        if self._prefix is None:
            prefix = np.empty(len(self.buf) + 1, U64)
            prefix[0] = 0
            np.cumsum(_BYTE[self.buf] * power, out=prefix[1:])
            self._prefix = prefix
        h = self._prefix[ends] - self._prefix[starts]
        h *= inverse[np.minimum(starts, len(self.buf) - 1)]
        h += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(h)

    def word_hashes(self) -> np.ndarray:
        return self.hash_spans(self.starts, self.ends)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text's word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = h[:n] * U64(0xA24BAED4963EE407)
    for i in range(1, k):
        out = mix(out + h[i : i + n]) * U64(0x9FB21C651E98DF25 + 2 * i & _MASK)
    return mix(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct window hashes; a text of fewer words is one shingle, one without words none."""
    if not len(h):
        return np.empty(0, U64)
    if len(h) < k:
        return mix(windows(h, len(h)) + U64(len(h)))
    out = np.sort(windows(h, k))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
