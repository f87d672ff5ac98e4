"""A packed R-tree over count vectors, and its self-join under an overlap bound."""

from __future__ import annotations

import numpy as np

FANOUT = 16


class CountTree:
    """Points are vectors of group counts; a node keeps the largest count of each group and the range of set sizes.

    The overlap of two sets is at most the sum over groups of the smaller count; for two nodes, of the smaller maximum.
    """

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        # Packed by size, then by the two groups in which the points differ most.
        wide = np.argsort(-counts.var(axis=0), kind="stable")[:2] if len(counts) else [0, 0]
        self.order = np.lexsort((counts[:, wide[1]], counts[:, wide[0]], sizes)) if len(counts) else np.zeros(0, np.int64)
        self.sizes, self.counts = sizes[self.order], counts[self.order]
        self.levels = []
        most, low, high = self.counts, self.sizes, self.sizes
        while len(most) > 1:
            at = np.arange(0, len(most), FANOUT)
            most, low, high = np.maximum.reduceat(most, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((most, low, high))

    def pairs(self, num: int, den: int) -> np.ndarray:
        """(i, j), each pair of points once, whose bound allows a Jaccard similarity of num / den or more."""
        if len(self.sizes) < 2:
            return np.zeros((0, 2), np.int64)
        found = np.zeros((1, 2), np.int64)
        for most, low, high in self.levels[::-1][1:] + [(self.counts, self.sizes, self.sizes)]:
            child = np.arange(FANOUT)
            a = (found[:, :1] * FANOUT + child)[:, :, None]
            b = (found[:, 1:] * FANOUT + child)[:, None, :]
            a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
            ok = (a < len(most)) & (b < len(most)) & (a <= b)
            kept = []
            a, b = a[ok], b[ok]
            for k in range(0, len(a), 1 << 12):
                x, y = a[k : k + (1 << 12)], b[k : k + (1 << 12)]
                fit = (high[x] * den >= low[y] * num) & (high[y] * den >= low[x] * num)
                x, y = x[fit], y[fit]
                bound = np.minimum(most[x], most[y]).sum(axis=1, dtype=np.int64)
                fit = bound * (num + den) >= num * (low[x] + low[y])
                kept.append(np.stack([x[fit], y[fit]], axis=1))
            found = np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)
        found = found[found[:, 0] < found[:, 1]]
        return self.order[found]
