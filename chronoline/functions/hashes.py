"""Hashes that Spark doesn't have."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_1 = np.uint32


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _1(by)) | (x >> _1(32 - by))


def murmur3_32(raw: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """The 32-bit murmur3 of each of the byte strings raw[at[i]:at[i + 1]], as signed numbers. All strings advance by a
    block of 4 bytes at once, the longest first, so those that are done drop off the end."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, length = at[:-1][order], size[order]
    padded = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
    h = np.full(len(order), seed, np.uint32)
    blocks = length // 4

    def mixed(k):
        return _turned(k * _1(0xCC9E2D51), 15) * _1(0x1B873593)

    live, done = np.searchsorted(-blocks, -1, "right"), 0
    while live:
        p = begin[:live] + 4 * done
        k = padded[p] | padded[p + 1] << _1(8) | padded[p + 2] << _1(16) | padded[p + 3] << _1(24)
        h[:live] = _turned(h[:live] ^ mixed(k), 13) * _1(5) + _1(0xE6546B64)
        done += 1
        live = np.searchsorted(-blocks, -(done + 1), "right")
    rest, p = length % 4, begin + 4 * blocks
    tail = np.zeros(len(order), np.uint32)
    for i in range(3):
        tail |= np.where(rest > i, padded[np.minimum(p + i, len(raw))], _1(0)) << _1(8 * i)
    h ^= np.where(rest > 0, mixed(tail), _1(0))
    h ^= length.astype(np.uint32)
    for by, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> _1(by))) * _1(times)
    out = np.empty(len(order), np.uint32)
    out[order] = h
    return out.view(np.int32)


def murmur3(column, seed: int = 0x9520E3C4):
    """A column with the murmur3-32 of a string's UTF-8 bytes, or of a binary, under a fixed seed; null for null."""

    @F.arrow_udf("int")
    def hashed(x: pa.Array) -> pa.Array:
        x = x.cast(pa.large_binary())
        filled = x.fill_null(b"")
        _, offsets, data = filled.buffers()
        at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return pa.array(murmur3_32(raw[at[0] : at[-1]], at - at[0], seed), pa.int32(), mask=x.is_null().to_numpy(zero_copy_only=False))

    return hashed(column)
