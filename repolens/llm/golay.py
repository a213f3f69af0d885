"""The perfect binary Golay code (23, 12, 7), for whole arrays: syndromes and nearby codewords.

Every 23-bit word has exactly one codeword within distance 3. Two words that differ in one bit still share
a codeword if one side lists those within distance 4; two that differ in two bits share one if both sides
do (some word between them is one bit from each).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 23
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0xC75


def _remainder(word: int) -> int:
    for k in range(BITS - 1, 10, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - 11)
    return word


@lru_cache(maxsize=1)
def _high() -> np.ndarray:
    """Remainders of the upper twelve bits."""
    return np.array([_remainder(i << 11) for i in range(1 << 12)], np.int64)


def syndrome(words: np.ndarray) -> np.ndarray:
    return _high()[words >> 11] ^ (words & 0x7FF)


@lru_cache(maxsize=4)
def _patterns(radius: int) -> np.ndarray:
    """For each syndrome, the error patterns of at most ``radius`` bits, lightest first; -1 fills up."""
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(radius + 1):
        for bits in combinations(range(BITS), weight):
            error = sum(1 << b for b in bits)
            found[_remainder(error)].append(error)
    width = max(map(len, found))
    return np.array([f + [-1] * (width - len(f)) for f in found], np.int64)


def nearby(words: np.ndarray, radius: int = 4) -> np.ndarray:
    """Indices (twelve bits) of all codewords within ``radius`` of each word, nearest first; -1 fills up."""
    errors = _patterns(radius)[syndrome(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)
