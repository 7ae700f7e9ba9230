"""Cutting stock by column generation over a histogram of piece lengths.

The linear programme picks how often to use each pattern (a multiset of length classes that fits one sequence).
Its columns are priced by an unbounded-knapsack dynamic programme on the duals; the rounded-down patterns leave a
few pieces of each class, which best-fit decreasing packs. The histogram has a fixed number of classes, so the
work does not depend on the number of documents.
"""

from __future__ import annotations

import numpy as np


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: knapsack over capacities, all classes at once per capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.searchsorted(sizes, c, side="right")
        if fits:
            total = best[c - sizes[:fits]] + values[:fits]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], last[c] = total[k], k
    counts = np.zeros(sizes.size, np.int64)
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = 2000, gap: float = 1e-6) -> list[tuple[np.ndarray, int]]:
    """(counts by class, how often) of patterns that hold the demand exactly. sizes: ascending, each at most capacity."""
    m = sizes.size
    if not m:
        return []
    columns = np.diag(np.minimum(capacity // sizes, np.maximum(demand, 1))).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(max_rounds):
        duals = inverse.sum(0)  # every pattern costs one sequence
        value, pattern = _best_pattern(sizes, duals.clip(0), capacity)
        if value <= 1 + gap:
            break
        step = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        move = ratio[out]
        x = (x - move * step).clip(0)
        x[out] = move
        columns[:, out] = pattern
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return _rounded(sizes, demand, capacity, columns.T.round().astype(np.int64), x)


def _rounded(sizes: np.ndarray, demand: np.ndarray, capacity: int, patterns: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, int]]:
    left, out = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x, kind="stable"):
        used = np.flatnonzero(patterns[k])
        times = int(min(np.floor(x[k] + 1e-9), (left[used] // patterns[k][used]).min())) if used.size else 0
        if times > 0:
            out.append((patterns[k], times))
            left -= times * patterns[k]
    # the rest, fewer pieces than patterns x pieces in one: best fit, the largest first
    bins: list[tuple[int, np.ndarray]] = []
    for c in np.flatnonzero(left)[::-1]:
        for _ in range(int(left[c])):
            room = [(space, b) for b, (space, _) in enumerate(bins) if space >= sizes[c]]
            if room:
                space, b = min(room)
                bins[b][1][c] += 1
                bins[b] = (space - int(sizes[c]), bins[b][1])
            else:
                counts = np.zeros(sizes.size, np.int64)
                counts[c] = 1
                bins.append((capacity - int(sizes[c]), counts))
    same: dict[tuple[int, ...], int] = {}
    for _, counts in bins:
        same[tuple(counts)] = same.get(tuple(counts), 0) + 1
    return out + [(np.array(p, np.int64), n) for p, n in same.items()]
