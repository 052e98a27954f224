"""Spanning forests of links found inside one task, so that a task reports links and not all pairs."""

from __future__ import annotations

import numpy as np


class Forest:
    """Places 0..n-1 and the smallest place each is known to be linked with."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook larger roots to smaller ones until both ends of every pair have one root."""
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                nxt = self.root[self.root]
                if np.array_equal(nxt, self.root):
                    break
                self.root = nxt
