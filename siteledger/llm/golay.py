"""The perfect Golay code of 23 bits: every word lies within three bits of exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainders(bits: int) -> np.ndarray:
    """Remainder by the generator of every word of so many bits."""
    out = np.zeros(1, np.uint32)
    for bit in range(bits):
        r = 1 << bit
        for top in range(bit, CHECKS - 1, -1):
            if r >> top & 1:
                r ^= GENERATOR << (top - CHECKS)
        out = np.concatenate([out, out ^ np.uint32(r)])
    return out


_SYNDROME = _remainders(LENGTH).astype(np.uint16)


def _errors() -> np.ndarray:
    """The error pattern, of at most three bits, behind each syndrome."""
    out = np.zeros(1 << CHECKS, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            out[_SYNDROME[pattern]] = pattern
    return out


_ERROR = _errors()


def nearest(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword: its twelve leading bits, which tell codewords apart."""
    words = words.astype(np.uint32)
    return (words ^ _ERROR[_SYNDROME[words]]) >> CHECKS


def around(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codeword indices nearest to each word or to the word with one of its ``width`` bits turned.

    Returns the indices and, for each, the position of its word. A word at distance one from another shares its own
    nearest index with this list of the other. There are one to six.
    """
    turned = words.astype(np.uint32)[:, None] ^ np.array([0, *(1 << b for b in range(width))], np.uint32)
    found = np.sort(nearest(turned), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return found[new], np.nonzero(new)[0]
