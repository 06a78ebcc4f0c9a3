"""FM-index over a sequence of word numbers: suffix array, BWT, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. 0 separates texts; separators differ from each
    other, so no comparison runs past one."""
    n = len(seq)
    sep = seq == 0
    z = int(sep.sum())
    rank = np.where(sep, np.cumsum(sep) - 1, z + seq.astype(np.int64))
    h = 0
    while True:
        key = rank
        if h:
            second = np.zeros(n, np.int64)
            second[:n - h] = rank[h:] + 1
            key = rank * (int(rank.max()) + 2) + second
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        dense = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[sa] = dense
        h = 1 if h == 0 else h * 2
        if dense[-1] == n - 1 or h >= n:
            return sa


class WaveletMatrix:
    """Rank of a symbol in any prefix of a sequence, for many (symbol, prefix) pairs at once."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels, cur = [], seq.astype(np.int64)
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (cur >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.levels.append((shift, ones, len(cur) - int(ones[-1])))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(upto), np.int64), upto.astype(np.int64)
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Index of ``seq`` (numbers 1..sigma-1, texts separated by 0; must end with 0)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1].astype(np.int64)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        self.tree = WaveletMatrix(self.bwt, sigma)
        # sampled positions: every SAMPLE-th one and the first of each text, so that a walk ends inside its text
        self.sampled = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.slot = np.cumsum(self.sampled) - 1
        self.value = sa[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern (right-aligned rows of
        ``patterns``, filled with 0 on the left), by backward search."""
        width = patterns.shape[1]
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        for j in range(width - 1, -1, -1):
            k = np.flatnonzero((lengths >= width - j) & (hi > lo))
            if len(k):
                c = patterns[k, j]
                lo[k] = self.less[c] + self.tree.rank(c, lo[k])
                hi[k] = self.less[c] + self.tree.rank(c, hi[k])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes given by their rows: steps back to a sampled one."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            end = self.sampled[at]
            out[todo[end]] = self.value[self.slot[at[end]]] + steps
            todo, at = todo[~end], at[~end]
            c = self.bwt[at]
            rows[todo] = self.less[c] + self.tree.rank(c, at)
            steps += 1
        return out
