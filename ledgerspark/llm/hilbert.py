"""Positions on a Hilbert curve, for whole arrays of points at once."""

from __future__ import annotations

import numpy as np


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of `cells` (unsigned, below 2 ** bits; columns * bits <= 63) on the curve of that order.

    Walks from the coarsest bit down. The state of the walk, how the cell's axes are turned and reflected, is applied
    to the coordinates themselves; a Gray code of each level's corner gives the position.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = (one << np.uint64(b)) - one
        for i in range(n):
            up = (x[i] >> np.uint64(b) & one).astype(bool)
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> np.uint64(b) & one == 1, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    out = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << one | (x[i] >> np.uint64(b) & one)
    return out
