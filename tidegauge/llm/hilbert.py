"""Hilbert curve keys of points with several dimensions, vectorised (Skilling's transform)."""

from __future__ import annotations

import numpy as np


def keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the curve of each row of cell numbers below 2**bits; bits * dimensions is at most 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out
