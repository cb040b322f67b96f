"""Rolling hashes over word sequences, for many documents at once in numpy.

A batch is one flat array of 64-bit word hashes and the offsets of its
documents.  Polynomial hashes modulo 2^64 come from prefix sums, so a window of
any width at any position costs two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Odd multipliers modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of a batch that are worked on at a time; one longer document goes alone.
SLICE = 1 << 17


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _rounded(n: int) -> int:
    return max(SLICE + 1, 1 << (n - 1).bit_length())


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for ``n`` words; those of a longer text are not kept."""
    n = _rounded(n)
    return _powers(base, n) if n <= SLICE + 1 else _powers.__wrapped__(base, n)


class Words:
    """Word hashes of consecutive documents."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat, self.offsets = flat, offsets
        self.lengths = np.diff(offsets)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.pos = np.arange(len(flat)) - offsets[self.doc]
        self.left = self.lengths[self.doc] - self.pos  # words from here to the document's end
        self._sums: dict[int, np.ndarray] = {}
        self._down: dict[int, np.ndarray] = {}

    def _prefix(self, kind: int) -> np.ndarray:
        if kind not in self._sums:
            h = self.flat if kind == 0 else (self.flat ^ (self.flat >> np.uint64(29))) * np.uint64(BASES[0])
            up, self._down[kind] = _power(BASES[kind], len(h) + 1)
            self._sums[kind] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        return self._sums[kind]

    def window(self, at: np.ndarray, width: int | np.ndarray, kind: int = 0) -> np.ndarray:
        """Hash of ``width`` words from each flat index; the caller keeps windows inside documents."""
        sums = self._prefix(kind)
        return (sums[at + width] - sums[at]) * self._down[kind][at]


def mixed(h: np.ndarray) -> np.ndarray:
    """Well-spread values with the order of hashes forgotten."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def slices(column: pa.ListArray) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a list<int64> column with about SLICE words each."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        b = min(b, n)
        yield a, b, Words(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b
