"""An FM-index over a sequence of symbols: wavelet-matrix ranks, batched backward search, sampled suffix positions.

Symbol 0 separates runs and is never part of a pattern. All searches are vectorised over the patterns.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(c, i): how often symbol c stands before position i, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        at = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (at >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(int(bits.size - self.ones[-1][-1]))
            at = np.concatenate([at[bits == 0], at[bits == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, at = np.zeros_like(i), i
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            n_at, n_start = self.ones[k][at], self.ones[k][start]
            at = np.where(one, self.zeros[k] + n_at, at - n_at)
            start = np.where(one, self.zeros[k] + n_start, start - n_start)
        return at - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            n = self.ones[k][i]
            one = self.ones[k][i + 1] > n
            out = (out << 1) | one
            i = np.where(one, self.zeros[k] + n, i - n)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling. Separators (0) sort below all symbols and, among themselves, by position."""
    n = symbols.size
    zero = symbols == 0
    seps = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + seps)
    width = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - width] = rank[width:] + 1
        key = rank * (int(nxt.max(initial=0)) + 1) + nxt
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        width *= 2


class FMIndex:
    """Index of ``symbols`` (0 only as separator, first and last); ``sample`` is the distance of kept suffix positions."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        if symbols[0] or symbols[-1]:
            raise ValueError("the sequence must start and end with a separator")
        order = suffix_array(symbols)
        self.bwt = WaveletMatrix(symbols[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        keep = (order % sample == 0) | (symbols[order - 1] == 0)  # so a walk never crosses a separator
        self.kept = np.concatenate([[0], np.cumsum(keep)])
        self.positions = order[keep]
        self.size = symbols.size

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns padded at the left (pattern k is the last lengths[k] columns): rows [lo, hi) of each."""
        lo = np.zeros(lengths.size, np.int64)
        hi = np.full(lengths.size, self.size, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not live.size:
                break
            c = patterns[live, width - 1 - step]
            lo[live] = self.before[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.before[c] + self.bwt.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a kept row, count the steps."""
        out = np.zeros(rows.size, np.int64)
        at, live, steps = rows.astype(np.int64), np.arange(rows.size), 0
        while live.size:
            kept = self.kept[at + 1] > self.kept[at]
            out[live[kept]] = self.positions[self.kept[at[kept]]] + steps
            at, live = at[~kept], live[~kept]
            if live.size:
                c = self.bwt.access(at)
                at = self.before[c] + self.bwt.rank(c, at)
                steps += 1
        return out
