"""Suffix arrays, equal-extension queries and a wavelet tree over NumPy arrays, for the operators that sort suffixes.

Symbols are 64-bit values; equality of stretches is that of 64-bit hashes of them.
"""

from __future__ import annotations

import numpy as np

from kbspark.llm.arrowtext import mix, powers

_BASE = 0xD1342543DE82EF95


class Stretches:
    """Running sums over symbols: hashes of stretches and how far two places agree."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(symbols * powers(_BASE, self.n), out=self.sums[1:]) if self.n else None

    def hashes(self, starts: np.ndarray, lengths) -> np.ndarray:
        """A hash of each stretch; equal stretches have equal hashes."""
        lift = powers(pow(_BASE, -1, 1 << 64), self.n + 1)
        return mix((self.sums[starts + lengths] - self.sums[starts]) * lift[starts] + np.asarray(lengths).astype(np.uint64))

    def _same(self, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        lift = powers(_BASE, self.n + 1)
        return (self.sums[i + m] - self.sums[i]) * lift[j - i] == self.sums[j + m] - self.sums[j]

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` on equal those from ``j`` on (i <= j), up to ``most``."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            m = (low + high + 1) >> 1
            ok = self._same(i, j, m)
            low, high = np.where(ok, m, low), np.where(ok, high, m - 1)
        return low

    def behind(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols before ``i`` equal those before ``j`` (i <= j), up to ``most``."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            m = (low + high + 1) >> 1
            ok = self._same(i - m, j - m, m)
            low, high = np.where(ok, m, low), np.where(ok, high, m - 1)
        return low


class WaveletTree:
    """A wavelet tree (in matrix form, packed bits) over non-negative integers: for ranges of the sequence, how many
    values lie below a bound, and which is the smallest value at or above it."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros((self.n >> 6) + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((b, words, before, int(self.n - one.sum())))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(words[i >> 6] & low)

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range ``[lo, hi)`` are smaller than ``bound``."""
        count = np.where(bound >= 1 << self.bits, hi - lo, 0)
        live = bound < 1 << self.bits
        lo, hi = lo.copy(), hi.copy()
        for b, words, before, zeros in self.levels:
            one_lo, one_hi = self._ones(words, before, lo), self._ones(words, before, hi)
            up = (bound >> b & 1).astype(bool)
            count += np.where(up & live, (hi - lo) - (one_hi - one_lo), 0)
            lo, hi = np.where(up, zeros + one_lo, lo - one_lo), np.where(up, zeros + one_hi, hi - one_hi)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range."""
        lo, hi, k, value = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for b, words, before, zeros in self.levels:
            one_lo, one_hi = self._ones(words, before, lo), self._ones(words, before, hi)
            null = (hi - lo) - (one_hi - one_lo)
            up = k >= null
            value |= up.astype(np.int64) << b
            k = np.where(up, k - null, k)
            lo, hi = np.where(up, zeros + one_lo, lo - one_lo), np.where(up, zeros + one_hi, hi - one_hi)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of each range that is at least ``bound``; -1 where there is none."""
        k = self.below(lo, hi, bound)
        some = k < hi - lo
        out = np.full(len(lo), -1, np.int64)
        out[some] = self.kth(lo[some], hi[some], k[some])
        return out
