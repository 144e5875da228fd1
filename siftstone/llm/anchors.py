"""Anchors: places chosen by a text's content, such that equal windows of WIDTH bytes have equal anchors.

The anchor of a window is the first of its K-byte strings with the least hash. It depends on the
window alone, so equal windows have equal anchors at equal offsets, wherever they stand. One anchor
serves the windows lo to hi around it, about 17 on average.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WIDTH, K = 50, 16
SPAN = WIDTH - K + 1
_PIECE = 1 << 19
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(base)
        size, base = size + more, base * base & _MASK
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a random number for each byte."""
    return _powers(_BASE, _PIECE + WIDTH), _powers(pow(_BASE, -1, 1 << 64), _PIECE + WIDTH), np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hash_rows(rows: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row of bytes."""
    up, _, numbers = _tables()
    return _mix((numbers[rows] * up[: rows.shape[1]]).sum(axis=1) + np.uint64(salt))


def _of_piece(text: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    up, down, numbers = _tables()
    n = len(text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(numbers[text] * up[:n], out=sums[1:])
    hashes = _mix((sums[K:] - sums[: n + 1 - K]) * down[: n + 1 - K])
    # the place in the low bits makes the first of equal hashes the least, and gives it back
    least = hashes >> np.uint64(20) << np.uint64(20) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
    windows = np.flatnonzero(valid[: len(least)])
    own = (least[windows] & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (np.diff(windows) != 1)]) if len(own) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(own)] - 1 if len(own) else first
    at, lo, hi = own[first], windows[first], windows[last]
    shape = (at - lo).astype(np.uint64) << np.uint64(8) | (hi - lo).astype(np.uint64)
    return at, lo, hi, hashes[at], _mix((sums[hi + WIDTH] - sums[lo]) * down[lo] + shape)


def find_anchors(raw: bytes, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of concatenated texts: document, place, first and last window, hash of the K bytes, and hash of all bytes of those windows, for each anchor."""
    text, ends = np.frombuffer(raw, np.uint8), np.cumsum(lens)
    found = []
    doc, start = 0, 0
    while doc < len(lens):
        last = max(doc, int(np.searchsorted(ends, start + _PIECE, side="right")) - 1)  # as many whole texts as fit, or a part of one
        stop = min(int(ends[last]), start + _PIECE)
        if stop - start >= WIDTH:
            inside = np.minimum(ends[doc : last + 1], stop) - start
            until = np.repeat(inside, np.diff(np.r_[0, inside]))
            at, lo, hi, key, whole = _of_piece(text[start:stop], np.arange(stop - start) + WIDTH <= until)
            found.append((np.searchsorted(inside, at, side="right") + doc, at + start, lo + start, hi + start, key, whole))
        if stop == ends[last]:
            doc, start = last + 1, stop
        else:
            doc, start = last, stop - WIDTH + 1
    kinds = [np.int64] * 4 + [np.uint64] * 2
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, k) for i, k in enumerate(kinds))
