"""A compressed FM-index: suffix order, Burrows-Wheeler transform and a wavelet matrix of packed bits.

The index of a sequence of ``n`` symbols takes ``n * log2(symbols)`` bits and
half as much again for ranks, and answers backward search: the number of
places where a pattern stands, one symbol to the left at a time.  All steps are
made for many patterns at once.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order; every separator (code 0) counts as a symbol of its own, so common beginnings end at the next one."""
    n, parts = len(codes), codes == 0
    rank = codes.astype(np.int64) + int(parts.sum())
    rank[parts] = np.arange(int(parts.sum()))
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        sorted_keys = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])))
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Of a sequence of codes: 0 separates, 1 .. symbols-1 are words.  Patterns hold words only."""

    def __init__(self, codes: np.ndarray, symbols: int):
        self.size = len(codes)
        order = suffix_order(codes)
        seq = codes[order - 1]  # the symbol before each suffix
        self.levels = max(1, (symbols - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            packed = np.zeros((self.size // 64 + 1) * 8, dtype=np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            packed = packed.view(_U)
            self.bits.append(packed)
            self.ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed)[:-1], dtype=np.int64))))
            self.zeros.append(int(self.size - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        before = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=symbols))[:-1]))
        every = np.arange(symbols)
        self.base = before - self._down(every, np.zeros(symbols, dtype=np.int64))

    def _down(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places ``at`` followed through the wavelet matrix along the bits of ``codes``."""
        for k in range(self.levels):
            word, low = at >> 6, (at & 63).astype(_U)
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & ((_U(1) << low) - _U(1)))
            at = np.where((codes >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol at their left."""
        n = len(codes)
        both = self._down(np.concatenate((codes, codes)), np.concatenate((low, high)))
        return self.base[codes] + both[:n], self.base[codes] + both[n:]

    def occurrences(self, pattern: np.ndarray) -> int:
        low, high = np.zeros(1, dtype=np.int64), np.full(1, self.size)
        for c in pattern[::-1]:
            low, high = self.extend(np.array([c]), low, high)
        return int(high[0] - low[0])


def repeated(index: FMIndex, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of a pattern at which a window starts that stands twice or more in the index; -1 where none does.

    The matching statistic of an end is how many symbols up to it still stand
    twice.  It is found by backward search, and an end whose statistic falls
    short rules out every window that holds the symbol that broke it, so the
    next end to look at is a whole window after that symbol.
    """
    n = len(begins)
    first, last = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    _search(index, flat, begins, lengths, window, np.flatnonzero(lengths >= window), np.full(n, window - 1, dtype=np.int64), first, forward=True)
    _search(index, flat, begins, lengths, window, np.flatnonzero(first >= 0), lengths - 1, last, forward=False)
    return first, last


def _search(index: FMIndex, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, window: int, live: np.ndarray, ends: np.ndarray, out: np.ndarray, forward: bool) -> None:
    end, depth = ends[live].copy(), np.zeros(len(live), dtype=np.int64)
    low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), index.size, dtype=np.int64)
    while len(live):
        low, high = index.extend(flat[begins[live] + end - depth], low, high)
        broken = high - low < 2
        depth += 1
        whole = ~broken & (depth == window)
        out[live[whole]] = end[whole] - window + 1
        end = np.where(broken, end - depth + 1 + window if forward else end - 1, end)
        depth[broken], low[broken], high[broken] = 0, 0, index.size
        keep = ~whole & (end < lengths[live]) & (end >= window - 1)
        live, end, depth, low, high = live[keep], end[keep], depth[keep], low[keep], high[keep]
