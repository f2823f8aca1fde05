"""Index of integer points on the Hilbert curve (transposed coordinates, J. Skilling 2004)."""

from __future__ import annotations

import numpy as np


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """``points``: (rows, dims) integers in [0, 2**bits); dims * bits at most 63."""
    x = np.array(points, dtype=np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo excess work, from the top bit down
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):  # Gray decode
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[n - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= t
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out
