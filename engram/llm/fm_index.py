"""A compressed FM-index over word sequences: packed wavelet matrix, ranks by popcount, lockstep backward search."""

from __future__ import annotations

import numpy as np


def context_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``seq`` in the order of at least their first ``depth`` symbols (prefix doubling). Patterns of up to
    ``depth`` symbols need no more of the order than that."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank, h = rank.astype(np.int64) + 1, 1
    while True:
        key = rank * (n + 2)
        key[: n - h] += rank[h:] if h < n else 0
        order = np.argsort(key, kind="stable")
        if h * 2 >= depth:
            return order
        fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        ranks = np.cumsum(fresh)
        if ranks[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        h *= 2


class FMIndex:
    """Index of ``seq`` (dense symbols from 0); counts occurrences of patterns of up to ``depth`` symbols."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.n, sigma = len(seq), int(seq.max()) + 1
        bwt = seq[context_order(seq, depth) - 1].astype(np.int64)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            packed = np.zeros((self.n >> 6) + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            counts = np.bitwise_count(packed).astype(np.int32)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(counts, dtype=np.int32)))[:-1].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            row = np.concatenate((row[~bit], row[bit]))
        symbols = np.arange(sigma)
        first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))[:-1]
        self.base = first - self._descend(symbols, np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions mapped down the wavelet matrix along each symbol's bits."""
        for k in range(self.levels):
            block = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][block] + np.bitwise_count(self.words[k][block] & low)
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step of many searches at once: the rows of each symbol followed by each interval's pattern."""
        both = self._descend(np.concatenate((symbol, symbol)), np.concatenate((lo, hi))) + np.concatenate((self.base[symbol],) * 2)
        return both[: len(lo)], both[len(lo) :]


def repeated_range(index: FMIndex, seq: np.ndarray, start: np.ndarray, windows: np.ndarray, width: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of ``seq`` (each ``windows`` windows of ``width`` words from ``start``): the first and the last window
    that occurs ``least`` times in the index, -1 if none does.

    Each stretch streams through backward search from a window's right end. The match grows leftwards while it
    is repeated; where that ends, no window across the break is repeated, so the search goes on beyond it.
    First upwards for the first window, then downwards from the last; all stretches step together.
    """
    m = len(start)
    first, last = np.full(m, -1), np.full(m, -1)
    window, step = np.zeros(m, np.int64), np.zeros(m, np.int64)
    up = np.ones(m, bool)
    lo, hi = np.zeros(m, np.int64), np.full(m, index.n)
    live = np.arange(m)
    while len(live):
        w, k = window[live], step[live]
        a, b = index.extend(seq[start[live] + w + width - 1 - k], lo[live], hi[live])
        fine = b - a >= least
        k = k + 1
        lo[live], hi[live], step[live] = a, b, k
        whole, broken = fine & (k == width), ~fine
        over = np.zeros(len(live), bool)
        if whole.any():
            x = live[whole]
            rise = up[x]
            first[x[rise]] = window[x[rise]]
            last[x] = window[x]
            up[x] = False
            top = windows[x] - 1
            over[whole] = ~rise | (window[x] == top)
            window[x] = np.where(rise, top, window[x])
        if broken.any():
            x = live[broken]
            rise = up[x]
            window[x] = np.where(rise, window[x] + width - k[broken] + 1, window[x] - 1)
            over[broken] = np.where(rise, window[x] >= windows[x], window[x] <= first[x])
        again = live[whole | broken]
        step[again], lo[again], hi[again] = 0, 0, index.n
        live = live[~over]
    return first, last
