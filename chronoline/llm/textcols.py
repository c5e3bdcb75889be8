"""Numpy views of Arrow text columns: whole texts as byte buffers, words as hashed spans.

Every function works on a *slab*: the UTF-8 bytes of several whole documents laid end to
end plus their offsets. Work is per slab, so memory is bounded by ``SLAB`` bytes or by one
document, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB = 1 << 20
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
CLASSES = {"space": _SPACE, "alnum": _ALNUM}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
        wide = True
    _, offsets, data = column.buffers()
    n = len(column)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slabs(column: pa.Array, size: int = SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive whole documents of about ``size`` bytes."""
    raw, at = buffers(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLAB + (1 << 16))
        inverse = pow(BASE, -1, 1 << 64)
        up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


class Words:
    """Words of a slab: ``start``, ``end`` (bytes), ``doc`` (row in the slab), ``h`` (64-bit
    hash of the lower-cased bytes), ``first`` (index of each document's first word, n+1)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, kind: str):
        low = _LOWER[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = CLASSES[kind][low]
        cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(cut):  # a word never crosses documents
            cut = np.unique(cut)
            cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        self.low, self.start, self.end = low, start, end
        self.first = np.searchsorted(start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        up, down = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=total[1:])
        self.total, self.down = total, down
        self.h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * GOLD)

    def __len__(self) -> int:
        return len(self.start)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges within words."""
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64) * GOLD)


def word_hash(word: str) -> int:
    """The hash that ``Words`` gives one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]), "space")
    return int(w.h[0])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words starting at each of the first len(h)-n+1 words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out + GOLD) ^ (h[k : len(h) - n + 1 + k] * M2)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, end to end."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - begin


class Sieve:
    """A Bloom filter of 64-bit hashes: rows that can't meet any of these in a join needn't leave the
    task that makes them. It lets through every one of its hashes and about one in 10**6 others."""

    def __init__(self, hashes: np.ndarray):
        self.size = np.uint64(1 << max(16, int(np.ceil(np.log2(max(1, len(hashes)) * 64)))))
        self.bits = np.zeros(int(self.size) // 8, np.uint8)
        for at in self._places(hashes):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _places(self, h):
        return (h & (self.size - np.uint64(1)), (h >> np.uint64(24)) & (self.size - np.uint64(1)), mix(h) & (self.size - np.uint64(1)))

    def pick(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be among the sieve's."""
        keep = np.arange(len(h))
        for k in range(3):
            if len(keep):
                at = self._places(h[keep])[k]
                keep = keep[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return keep
