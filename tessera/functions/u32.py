"""Unsigned 32-bit arithmetic on BIGINT columns, and the same on NumPy arrays.

ANSI mode raises on overflow, so the product of two 32-bit words is formed from halves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The generator's step and the multipliers and shifts of its finaliser.
STEP, M1, M2 = 0x9E3779B9, 0x21F0AAAD, 0x735A2D97
S1, S2, S3 = 16, 15, 15
MASK = 0xFFFFFFFF


def imul(a: Column, c: int) -> Column:
    """a * c modulo 2**32 for a in 0 .. 2**32 - 1."""
    high = F.shiftright(a, 16) * F.lit(c)
    return (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + a.bitwiseAND(0xFFFF) * F.lit(c)).bitwiseAND(MASK)


def mix32(a: Column) -> Column:
    """The avalanche bijection on 32-bit words."""
    a = a.cast("long")
    a = imul(a.bitwiseXOR(F.shiftright(a, S1)), M1)
    a = imul(a.bitwiseXOR(F.shiftright(a, S2)), M2)
    return a.bitwiseXOR(F.shiftright(a, S3))


def np_mix32(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a, np.uint32).copy()
    a ^= a >> np.uint32(S1)
    a *= np.uint32(M1)
    a ^= a >> np.uint32(S2)
    a *= np.uint32(M2)
    return a ^ (a >> np.uint32(S3))


def words(seed: int, n: int) -> np.ndarray:
    """The first n words of the seeded generator."""
    states = (np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP)) & np.uint64(MASK)
    return np_mix32(states.astype(np.uint32))
