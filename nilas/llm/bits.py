"""Bit vectors with rank, and wavelet matrices over integers, as numpy arrays; all questions are asked for many places at once."""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A bit vector; one(i) counts the ones before i."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, U)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def one(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class Wavelet:
    """A wavelet matrix over non-negative integers: a bit vector for each of their bits, the highest first."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.levels, self.zeros = [], []
        for bit in range(self.depth - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(len(values) - int(ones.sum()))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each value (less than 2 to the depth) stands before its i."""
        start = np.zeros_like(i)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones, ones_start = level.one(i), level.one(start)
            up = (value >> (self.depth - 1 - k)) & 1 == 1
            i, start = np.where(up, zeros + ones, i - ones), np.where(up, zeros + ones_start, start - ones_start)
        return i - start

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least `least` among places lo to hi - 1, or -1: the values below are counted in one descent, the next one is found in another."""
        l, r, below = lo, hi, np.zeros_like(lo)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones_l, ones_r = level.one(l), level.one(r)
            up = (least >> (self.depth - 1 - k)) & 1 == 1
            below += np.where(up, (r - ones_r) - (l - ones_l), 0)
            l, r = np.where(up, zeros + ones_l, l - ones_l), np.where(up, zeros + ones_r, r - ones_r)
        found = (below < hi - lo) & (least < 1 << self.depth)
        l, r, left, value = lo, hi, np.where(found, below, 0), np.zeros_like(lo)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones_l, ones_r = level.one(l), level.one(r)
            few = (r - ones_r) - (l - ones_l)
            up = left >= few
            left = np.where(up, left - few, left)
            value |= up.astype(np.int64) << (self.depth - 1 - k)
            l, r = np.where(up, zeros + ones_l, l - ones_l), np.where(up, zeros + ones_r, r - ones_r)
        return np.where(found, value, -1)
