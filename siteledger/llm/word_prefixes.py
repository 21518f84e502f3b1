"""Words of a batch of texts as numbers, and the sampled suffixes whose prefixes every long window of words contains."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from .anchors import sliding_min
from .common import SPACE_BYTES

BASE = 0x9E3779B97F4A7C15
STRIDE = 1 << 20  # values hashed together, so that one table of powers serves all
LONG_WORD = 1 << 10  # a longer word is hashed on its own
PLACE_BITS = 21  # of a prefix hash, its place in the block takes the low bits
BLOCK_WORDS = 1 << 20  # words whose windows are looked at together; blocks overlap by a window

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(2 * STRIDE, BASE, np.uint64), np.full(2 * STRIDE, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def range_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[first:end]`` for every pair of ascending bounds; ranges are shorter than ``STRIDE``."""
    up, down = _powers()
    out = np.empty(len(first), np.uint64)
    cuts = np.flatnonzero(np.diff(first // STRIDE, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(first)]):
        base, top = int(first[a]), int(end[a:b].max())
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((values[base:top].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=sums[1:])
        out[a:b] = (sums[end[a:b] - base] - sums[first[a:b] - base]) * down[first[a:b] - base]
    return _mix(out)


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word of the joined texts, and where each text's words start (with the end of the last)."""
    word = ~_IS_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]  # a word does not go on in the next text
    first[edge], last[edge - 1] = word[edge], word[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, bounds)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(begin), np.uint64)
    short = end - begin <= LONG_WORD
    out[short] = range_hashes(data, begin[short], end[short])
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]])
    return out


def prefix_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on, from hashes of halves."""
    out, have = words * np.uint64(BASE) + np.uint64(1), 1
    while have < n:
        step = min(have, n - have)
        out = out[: len(out) - step] * np.uint64(0xD6E8FEB86659FD93) + _mix(out[step:])
        have += step
    return _mix(out)


def sampled(words: np.ndarray, bounds: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled suffixes: the windows that share one (first and last start), the hash of its prefix, that of the words they span.

    Of the suffixes that start in a window of ``length`` words and have ``prefix`` words in it, the window takes the one with the
    smallest prefix hash, the leftmost of equals. The choice depends on the window's words alone, so equal windows take suffixes
    with equal prefixes.
    """
    parts = []
    for a in range(0, max(1, len(words) - length + 1), BLOCK_WORDS):
        part = words[a : a + BLOCK_WORDS + length - 1]
        if len(part) < length:
            break
        hashes = prefix_hashes(part, prefix)
        keyed = hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        taken = (sliding_min(keyed, length - prefix + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        start = np.arange(a, a + len(taken))
        text = np.searchsorted(bounds, start, "right") - 1
        inside = start + length <= bounds[text + 1]
        start, text, taken = start[inside], text[inside], taken[inside]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (taken[1:] != taken[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        first, last = start[head], start[np.append(head[1:], len(start)) - 1]
        parts.append((first, last, hashes[taken[head]], range_hashes(words, first, last + length)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))
