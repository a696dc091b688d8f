"""Content-chosen anchors: every window of a text has one, and equal windows have the same one."""

from __future__ import annotations

import numpy as np

from scoreloom.llm.bytesops import P, P_INV, byte_table, mix, powers

#: Bytes of a window and of the gram that anchors it; a window has SPAN grams.
WINDOW, GRAM = 50, 16
SPAN = WINDOW - GRAM + 1
#: Windows that start more than HALF bytes before their anchor are keyed on its left, others on its right.
HALF = SPAN // 2
PIECE = 1 << 18
FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def _grams(buf: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes from each place."""
    x = (byte_table(21, False) >> np.uint64(32)).astype(np.uint32)[buf]
    for i, factor in enumerate(FACTORS):
        n = 1 << i
        y = x[:-n] * factor
        y += x[n:]
        x = y
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    return x


def _least(x: np.ndarray) -> np.ndarray:
    """The offset of the leftmost minimum among the SPAN values from each place."""
    at, size = np.zeros(len(x), np.uint8), 1
    while size < SPAN:
        step = min(size, SPAN - size)
        later = x[step:] < x[:-step]
        at = np.where(later, at[step:] + np.uint8(step), at[:-step])
        x = np.minimum(x[step:], x[:-step])
        size += step
    return at


def anchored_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, key) of the runs of windows with one anchor, none across documents.

    The anchor of a window is its gram of least hash, the leftmost of equals,
    so it depends on the window's bytes alone. Runs are also cut between
    windows that start more than HALF bytes before the anchor and the rest:
    then all windows of a run share 33 bytes or more on one side, and the key
    is a hash of those. Works in pieces, so a very long text needs no more
    memory than others.
    """
    out = []
    stops = offs[1:]
    for lo in range(0, max(0, len(buf) - WINDOW + 1), PIECE):
        hi = min(len(buf) - WINDOW + 1, lo + PIECE)
        x = _grams(buf[lo : hi + WINDOW - 1])
        at = _least(x)
        inside = np.ones(hi - lo, bool)
        ends = stops[np.searchsorted(stops, lo, "right") : np.searchsorted(stops, hi + WINDOW, "right")] - lo
        crossing = (ends[:, None] - np.arange(1, WINDOW)).ravel()
        inside[crossing[(crossing >= 0) & (crossing < hi - lo)]] = False
        fresh = np.ones(hi - lo + 1, bool)
        np.not_equal(at[1:] + np.uint8(1), at[:-1], out=fresh[1:-1])
        fresh[1:-1] |= at[1:] == HALF
        fresh[1:-1] |= ~inside[:-1]
        begin = np.flatnonzero(fresh[:-1] & inside)
        stop = np.flatnonzero((fresh[1:] | np.append(~inside[1:], True)) & inside)
        anchor = begin + at[begin]
        left = at[begin] > HALF
        one, two = x[np.where(left, anchor - HALF - 1, anchor)], x[np.where(left, anchor - 2, anchor + HALF)]
        key = mix(one.astype(np.uint64) << np.uint64(32) | two.astype(np.uint64)) ^ left
        out.append((anchor + lo, begin + lo, stop + lo, key))
    if not out:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def range_hashes(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of byte ranges of a buffer; ``lo`` ascends, and no range is longer than 4096 bytes."""
    out = np.zeros(len(lo), np.uint64)
    table = byte_table(seed, False)
    at = 0
    while at < len(lo):
        base = int(lo[at])
        end = int(np.searchsorted(lo, base + PIECE))
        piece = buf[base : base + PIECE + 4096]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(table[piece] * powers(P, len(piece)), out=total[1:])
        a, b = lo[at:end] - base, hi[at:end] - base
        out[at:end] = (total[b] - total[a]) * powers(P_INV, len(piece))[a]
        at = end
    return mix(out)
