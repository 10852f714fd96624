"""A wavelet matrix over numpy arrays: which points lie in a rectangle."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Points ``(x, ys[x])``; ``ys`` is a permutation of ``0..n-1``.

    A level has the points of each node of the level above parted by the next bit
    of ``y``, the zeros of all nodes first; ``before[k]`` counts the zeros among
    the first k.  A rectangle goes down the levels as intervals of x, one for each
    node whose range of y it meets.
    """

    def __init__(self, ys: np.ndarray):
        self.depth = max(1, int(len(ys) - 1).bit_length())
        self.before, self.zeros = [], []
        now = ys.astype(np.int64)
        for bit in range(self.depth - 1, -1, -1):
            one = (now >> bit) & 1
            before = np.zeros(len(now) + 1, np.int64)
            np.cumsum(1 - one, out=before[1:])
            self.before.append(before)
            self.zeros.append(int(before[-1]))
            now = np.concatenate([now[one == 0], now[one == 1]])

    def report(self, xlo: np.ndarray, xhi: np.ndarray, ylo: np.ndarray, yhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the rectangle and y of every point in ``[xlo, xhi) x [ylo, yhi)``."""
        who = np.flatnonzero((xhi > xlo) & (yhi > ylo))
        lo, hi, node = xlo[who], xhi[who], np.zeros(len(who), np.int64)
        for level, before in enumerate(self.before):
            rest = self.depth - 1 - level
            l0, h0, z = before[lo], before[hi], self.zeros[level]
            who, node = np.concatenate([who, who]), np.concatenate([node << 1, (node << 1) | 1])
            lo, hi = np.concatenate([l0, z + lo - l0]), np.concatenate([h0, z + hi - h0])
            keep = (hi > lo) & ((node << rest) < yhi[who]) & (((node + 1) << rest) > ylo[who])
            who, lo, hi, node = who[keep], lo[keep], hi[keep], node[keep]
        return who, node
