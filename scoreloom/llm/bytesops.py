"""Array helpers over the byte buffers of Arrow string columns.

Everything here works inside a task on one Arrow batch, in chunks of about
``CHUNK`` bytes, so memory does not depend on the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole rows of about ``size`` bytes."""
    buf, offs = string_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array; the input is left as it is."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=None)
def byte_table(seed: int, fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold``, A-Z have those of a-z."""
    table = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, dtype=np.uint64)
    if fold:
        table[65:91] = table[97:123]
    return table


P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, CHUNK + 4096), np.uint64)
        size = 1
        while size < len(out):
            k = min(size, len(out) - size)
            out[size : size + k] = out[:k] * np.uint64(pow(base, size, 2**64))
            size += k
        if len(out) > 1 << 24:
            return out
        _POWERS[base] = have = out
    return have[:n]


WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


class Words:
    """White-space words of a chunk: start and end bytes, and the first word of each row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, split: np.ndarray = WHITE):
        white = split[buf]
        word = ~white
        first, last = word.copy(), word.copy()
        first[1:] &= white[:-1]
        last[:-1] &= white[1:]
        full = offs[:-1] < offs[1:]
        at = offs[:-1][full]
        first[at] = word[at]
        at = offs[1:][full] - 1
        last[at] = word[at]
        self.buf, self.offs = buf, offs
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row_first = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.row_first)

    def hashes(self, fold: bool, seed: int = 7) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n = len(self.buf)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_table(seed, fold)[self.buf] * powers(P, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(P_INV, n)[self.start])

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


WINDOW_SALT = np.random.Generator(np.random.PCG64(99)).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(words: Words, hashed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within a row, and the index of its first word."""
    n = len(hashed)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashed[: n - k + 1] * WINDOW_SALT[0]
    for j in range(1, k):
        out += hashed[j : n - k + 1 + j] * WINDOW_SALT[j]
    left = np.repeat(words.row_first[1:], words.counts)[: n - k + 1] - np.arange(n - k + 1)
    at = np.flatnonzero(left >= k)
    return mix(out[at]), at
