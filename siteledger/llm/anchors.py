"""Anchors of fixed-length strings: the place of the smallest k-gram hash, which equal strings have in common."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

GRAM = 32  # bytes of a k-gram
BASE = 0x9E3779B97F4A7C15 | 1
PLACE_BITS = 26  # of a hash, its place in the batch takes the low bits
BLOCK = (1 << 20) - 4096  # bytes looked at together; a longer text is taken in parts that overlap by a string


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Well spread 64-bit hash of the ``width`` bytes from each place on."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = 1 << max(20, (len(data) - 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[width:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose strings of ``length`` bytes have one anchor: first start, last start, hash of the anchor.

    ``data`` holds texts one after the other with the given bounds; no string crosses from one text to the next. A string's
    anchor is its leftmost smallest k-gram, so it depends on the string alone.
    """
    if len(data) > BLOCK:
        parts = []
        for a in range(0, len(data), BLOCK):
            part = data[a : a + BLOCK + length - 1]
            found = _runs(part, np.unique(np.clip(bounds - a, 0, len(part))), length)
            parts.append((found[0] + a, found[1] + a, found[2]))
        return tuple(np.concatenate(x) for x in zip(*parts))
    return _runs(data, bounds, length)


def _runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = gram_hashes(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, np.zeros(0, np.uint64)
    keyed = hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(keyed, length - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    n = np.diff(bounds)
    valid = np.zeros(len(data) + 1, np.int32)
    some = n >= length
    np.add.at(valid, bounds[:-1][some], 1)
    np.add.at(valid, bounds[1:][some] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(starts):
        return none, none, np.zeros(0, np.uint64)
    at = anchor[starts]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], hashes[at[first]]
