"""Vectorised union-find over the rows of one group."""

from __future__ import annotations

import numpy as np


class Disjoint:
    """Sets of 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(q, p):
                self.parent = p
                return p
            p = q

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i], for all i at once."""
        while len(a):
            p = self.roots()
            x, y = p[a], p[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
