"""Bloom filter positions: exact ones by Murmur3, and ones any engine with MD5 can compute."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits and hashes of a filter that nobody reserved.
DEFAULT_M, DEFAULT_K = 8192, 5
_MASK = 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Murmur3 x86-32, unsigned."""

    def rotl(x: int, r: int) -> int:
        return ((x << r) | (x >> (32 - r))) & _MASK

    def mixed(k: int) -> int:
        return rotl(k * 0xCC9E2D51 & _MASK, 15) * 0x1B873593 & _MASK

    h, whole = seed, len(data) & ~3
    for at in range(0, whole, 4):
        h = (rotl(h ^ mixed(int.from_bytes(data[at : at + 4], "little")), 13) * 5 + 0xE6546B64) & _MASK
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * factor & _MASK
    return h


def _signed(x: int) -> int:
    return x - (1 << 32) if x >> 31 else x


def polynomial_31(data: bytes) -> int:
    """Sum of signed bytes times powers of 31, as a signed 32-bit number."""
    h = 0
    for b in data:
        h = (31 * h + (b - 256 if b > 127 else b)) & _MASK
    return _signed(h)


def murmur_positions(data: bytes, m: int, k: int) -> list[int]:
    """The ``k`` double-hashing positions of an item in a filter of ``m`` bits."""
    h1, h2 = _signed(murmur3_32(data)), polynomial_31(data)
    return [abs(x) % m for x in (h1 + i * h2 for i in range(k))]


def _hashes(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``murmur3_32`` and ``polynomial_31`` of many items at once, items of like length together."""
    size = np.array([len(x) for x in items], np.int64)
    murmur, polynomial = np.zeros(len(items), np.uint32), np.zeros(len(items), np.uint32)
    rotl = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    mixed = lambda k: rotl(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        data = np.frombuffer(b"".join(items[i] for i in at), np.uint8).reshape(len(at), n)
        h, whole = np.zeros(len(at), np.uint32), n & ~3
        words = np.ascontiguousarray(data[:, :whole]).view("<u4").astype(np.uint32)
        for k in range(whole // 4):
            h = rotl(h ^ mixed(words[:, k]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if whole < n:
            tail = np.zeros(len(at), np.uint32)
            for k in range(n - whole):
                tail |= data[:, whole + k].astype(np.uint32) << np.uint32(8 * k)
            h ^= mixed(tail)
        h ^= np.uint32(n)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        p = np.zeros(len(at), np.uint32)
        for k in range(n):
            p = p * np.uint32(31) + data[:, k].view(np.int8).astype(np.int32).view(np.uint32)
        murmur[at], polynomial[at] = h, p
    return murmur.view(np.int32).astype(np.int64), polynomial.view(np.int32).astype(np.int64)


def murmur_positions_column(item: Column, m: Column, k: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def positions(items: pd.Series, ms: pd.Series, ks: pd.Series) -> pd.Series:
        if not len(items):
            return pd.Series([], dtype=object)
        h1, h2 = _hashes([bytes(x) for x in items])
        every = np.abs(h1[:, None] + np.arange(int(ks.max())) * h2[:, None]) % ms.to_numpy(np.int64)[:, None]
        return pd.Series([row[:n] for row, n in zip(every, ks)])

    return positions(item.cast("binary"), m.cast("long"), k.cast("long"))


def md5_positions_column(item: Column, m: Column, k: Column) -> Column:
    """Double hashing over the first two 32-bit words of the item's MD5; no Python."""
    digest = F.md5(item.cast("binary"))
    h1, h2 = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), lambda i: (h1 + i * h2) % m)
