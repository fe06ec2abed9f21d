"""FM-index over sequences of small integers: suffix order, wavelet matrix, backward search, location."""

from __future__ import annotations

import numpy as np

#: Every how many places of the sequence a suffix position is kept.
SAMPLING = 8


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; the end sorts before every symbol."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        key = rank * np.int64(n + 2)
        key[:n - k] += rank[k:] if k < n else 0
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.all() or k >= n:
            return order
        k *= 2


class WaveletMatrix:
    """Rank of a symbol before a place, for many questions at once: one bit level per bit of the alphabet."""

    def __init__(self, s: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(symbol), np.int64), before.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1) == 1
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FMIndex:
    """Index of ``s`` (symbols 0 <= s < 2^bits - 1). Inside, symbols count from 1 and a single 0 ends the sequence,
    so stepping back is right at every place."""

    def __init__(self, s: np.ndarray, bits: int) -> None:
        s = np.append(np.asarray(s, np.int64) + 1, 0)
        order = suffix_order(s)
        self.last = s[order - 1]
        self.size = len(s)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << bits))])
        self.tree = WaveletMatrix(self.last, bits)
        self.kept = np.where(order % SAMPLING == 0, order, -1)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of each phrase; ``phrases`` holds one per row, padded at the left to one width."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((high > low) & (sizes >= back))
            if not len(live):
                break
            symbol = phrases[live, -back] + 1
            start = self.before[symbol]
            low[live], high[live] = start + self.tree.rank(symbol, low[live]), start + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of rows, by stepping back to a kept place."""
        place, steps, row = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            at = self.kept[row[open_]]
            hit = at >= 0
            place[open_[hit]] = at[hit] + steps[open_[hit]]
            open_ = open_[~hit]
            if len(open_):
                symbol = self.last[row[open_]]
                row[open_] = self.before[symbol] + self.tree.rank(symbol, row[open_])
                steps[open_] += 1
        return place
