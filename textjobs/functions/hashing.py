"""Seeded, reproducible choices.  They replace random generators whose draws
depend on row order, so a lost executor recomputes the very same rows."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

PRIME = 2147483647  # 2^31 - 1; the products below stay inside a bigint


def seeded_hash(seed: int | str, *keys: Column) -> Column:
    """Hex digest that orders rows at random but reproducibly."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_pick(seed: int | str, key: Column, n: int) -> Column:
    """Zero-based choice among ``n`` options."""
    head = F.conv(F.substring(seeded_hash(seed, key), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(n)).cast("int")


#: Positions below come from two numbers of 31 bits, in 63-bit arithmetic.
MAX_DRAW_SIZE = 1 << 32


def _residue(x: np.ndarray) -> np.ndarray:
    """A number below 2^31 + 8 that is equal to ``x`` modulo 2^31 - 1: the
    upper bits are added to the lower ones, twice, without a division."""
    x = (x & PRIME) + (x >> 31)
    return (x & PRIME) + (x >> 31)


def draw_positions(seed: int, replicates: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
    """Positions in ``[0, size)`` of the draws ``low`` to ``high`` of every
    replicate, one row each; any cut into ranges of draws gives the same draws.

    Rounds of ``x -> x^5 + c`` over a prime field (a permutation there) mix
    replicate and draw number in plain integer arithmetic; the last two states
    are the digits of the drawn fraction.
    """
    start = (replicates.astype("int64") * 1000003 + seed * 104729) % PRIME
    j = np.arange(low, high, dtype="uint64")[None, :]
    x = _residue(start.astype("uint64")[:, None] + j * 7919)
    fine = x
    for added in (12345, j * 31 + 67890, 0):
        fine = x
        square = _residue(x * x)
        x = _residue(_residue(square * square) * x + added)
    x, fine = np.minimum(x, x - PRIME), np.minimum(fine, fine - PRIME)  # a difference below zero wraps to a large number
    return ((x * size + (fine * size) // PRIME) // PRIME).astype("int64")


class DrawnUnits:
    """Sums of what stands at positions of a sorted list that is given as
    values and the positions where they end.

    Stretches of positions that hold one value, nearly all, are looked up; the
    others are searched."""

    def __init__(self, units: np.ndarray, ends: np.ndarray):
        n = int(ends[-1])
        self.units, self.ends, self.shift = units, ends, max(0, n.bit_length() - 16)
        first = np.arange(0, n, 1 << self.shift)
        at = np.searchsorted(ends, first, side="right")
        last = np.searchsorted(ends, np.minimum(first + (1 << self.shift), n) - 1, side="right")
        self.known, self.mixed = units[at], at != last
        self.any_mixed = bool(self.mixed.any())

    def sum(self, positions: np.ndarray) -> int:
        stretch = positions >> self.shift
        found = self.known[stretch]
        if self.any_mixed:
            open_ = np.flatnonzero(self.mixed[stretch])
            found[open_] = self.units[np.searchsorted(self.ends, positions[open_], side="right")]
        return int(found.sum())
