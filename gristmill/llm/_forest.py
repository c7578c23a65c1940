"""Union-find over whole arrays of links, for the members of one task."""

from __future__ import annotations

import numpy as np


class Forest:
    """Keeps the root of each of n members; link() gives only the links that join two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = [np.zeros((2, 0), np.int64)]
        a, b = self.up[a], self.up[b]
        while len(a):
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            differ = lo != hi
            lo, hi = lo[differ], hi[differ]
            if not len(lo):
                break
            hi, first = np.unique(hi, return_index=True)  # each root hooks on one other
            made.append(np.stack((hi, lo[first])))
            self.up[hi] = lo[first]
            while True:
                up = self.up[self.up]
                if (up == self.up).all():
                    break
                self.up = up
            a, b = self.up[a], self.up[b]
        both = np.concatenate(made, axis=1)
        return both[0], both[1]
