"""Polynomial hashes of all substrings of some bytes, and bitmaps that tell which hashes can't be in a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Least and most bits of a bitmap: 128 KB to 32 MB, whatever it is made from.
LEAST_BITS, MOST_BITS = 20, 28


class Powers:
    """Powers of the base of the prefix hashes and their inverses modulo 2^64, as long as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, _BASE), np.full(size, _INVERSE)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PrefixHash:
    """Polynomial hashes modulo 2^64 of all substrings of some bytes.  Equal strings have equal hashes; the other
    way round holds for random strings only, so what follows from equal hashes has to be confirmed."""

    def __init__(self, data: np.ndarray, powers: Powers, twist: np.uint64 = np.uint64(1)):
        up, self.down = powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((mixed(data.astype(np.uint64) * twist + twist)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


class Bitmap:
    """One bit for each value of the low bits of a hash: a hash without its bit isn't in the table.  About 256 bits
    a hash up to MOST_BITS in all; beyond, the bitmap lets more through and never loses one."""

    def __init__(self, hashes: DataFrame, column: str, most_bits: int = MOST_BITS):
        """hashes: distinct longs, a written table."""
        n = hashes.count()
        self.mask = np.int64((1 << min(most_bits, max(LEAST_BITS, (256 * n).bit_length()))) - 1)
        place = F.col(column).bitwiseAND(int(self.mask))
        # Built from pieces of 4 KB; the driver gets no more than the bitmap has.
        pieces = hashes.groupBy(F.shiftright(place, 15).alias("piece")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits")).collect()
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        for r in pieces:
            self.bits[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """A mask of the hashes (int64)."""
        at = hashes & self.mask
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
