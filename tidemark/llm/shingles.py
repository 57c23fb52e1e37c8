"""Words and word shingles of whole Arrow columns as 64-bit hashes, without a Python object per word.

Words are what the six ASCII white-space bytes separate, with A-Z lower-cased. A word's hash is a polynomial over its
bytes modulo 2^64, taken from prefix sums and mixed; work is cut at word ends, so memory doesn't grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd base and its inverse modulo 2^64, and the constants of a 64-bit finaliser.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
MIX1, MIX2, GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
PIECE = 1 << 18
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * MIX1
    h = (h ^ (h >> U(27))) * MIX2
    return h ^ (h >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=U)
        while len(have) < max(n, PIECE):
            have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
        _POWERS[base] = have
    return have[:n]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts[i]:ends[i]]; data are folded bytes."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(high - low + 1, dtype=U)
        np.cumsum((data[low:high].astype(U) + U(1)) * powers(BASE, high - low), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * powers(INVERSE, high - low + 1)[s] + (e - s).astype(U) * GOLD)
        i = j
    return out


class Words:
    """The words of some consecutive texts. ``first[i]:first[i + 1]`` are those of text i; starts and ends are bytes in it."""

    def __init__(self, column: pa.Array):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        self.data = FOLD[np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and offsets[-1] > offsets[0] else np.empty(0, dtype=np.uint8)
        self.offsets = offsets - offsets[0]
        solid = self.data != 32
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        before, after = np.empty_like(solid), np.empty_like(solid)
        if len(solid):
            before[0], before[1:] = True, ~solid[:-1]
            after[-1], after[:-1] = True, ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = hash_words(self.data, self.starts, self.ends)

    def shingles(self, n: int) -> np.ndarray:
        """A hash for each n words that follow each other; those that span two texts are to be left out."""
        h = self.hashes
        if len(h) < n:
            return np.empty(0, dtype=U)
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * GOLD + h[k : len(h) - n + 1 + k])
        return out


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in pieces of about ``limit`` bytes, one row at least."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, column.slice(i, j - i)
        i = j


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles, sorted; with fewer words the whole sequence is one, without words none."""
    for _, part in slices(column):
        words = Words(part)
        all_ = words.shingles(n)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= n:
                s = np.sort(all_[a : b - n + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                h = np.array([b - a], dtype=U)
                for x in words.hashes[a:b]:
                    h = mix(h * GOLD + x)
                yield h
            else:
                yield np.empty(0, dtype=U)
