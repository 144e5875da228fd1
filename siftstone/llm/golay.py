"""The perfect binary Golay code of length 23 as a fuzzy hash.

Every 23-bit word lies within three bits of exactly one codeword. Its keys here are all codewords
within four bits: one if it lies within two bits of a codeword, else six. Two words that differ in at
most two bits share a key (the distances of both to the codeword of either add up to few enough bits,
as codewords are seven bits apart at least; test_simhash tries every case).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: The code's length, the bits of a codeword's index, and its generator polynomial (fixed values).
LENGTH, INDEX_BITS, GENERATOR = 23, 12, 0b101011100011
CHECK_BITS = LENGTH - INDEX_BITS


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of the division of polynomials over GF(2) by the generator; zero for codewords."""
    rest = words.astype(np.uint32).copy()
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest ^= ((rest >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - CHECK_BITS))
    return rest


@lru_cache(1)
def nearby_errors() -> tuple[np.ndarray, np.ndarray]:
    """For each remainder: the error patterns of up to four bits that lead to it, and how many there are."""
    patterns = np.array([sum(1 << i for i in at) for n in range(5) for at in combinations(range(LENGTH), n)], np.uint32)
    rest = _remainder(patterns)
    order = np.argsort(rest, kind="stable")
    counts = np.bincount(rest, minlength=1 << CHECK_BITS)
    table = np.zeros((1 << CHECK_BITS, counts.max()), np.uint32)
    slot = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[rest[order], slot] = patterns[order]
    return table, counts


@lru_cache(1)
def _remainders() -> np.ndarray:
    return _remainder(np.arange(1 << LENGTH)).astype(np.uint16)


def nearby_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within four bits of each word, and how many of each row count."""
    table, counts = nearby_errors()
    rest = _remainders()[words]
    return (words[:, None].astype(np.uint32) ^ table[rest]) >> np.uint32(CHECK_BITS), counts[rest]
