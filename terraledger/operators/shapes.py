"""Polygons between Arrow columns and numpy, for the operators that walk along rings.

A polygon is a list of rings (exterior first), a ring an (n, 2) array that
does not repeat its first vertex.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
RINGS = "array<array<struct<x:double,y:double>>>"


def points(column: pa.Array) -> np.ndarray:
    """A column of struct(x, y) as rows."""
    return np.column_stack([column.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y")])


def point_array(rows: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (0, 1)], names=["x", "y"])


def _nested(parts: list[int], inner: pa.Array, known: list[bool] | None = None) -> pa.ListArray:
    ends = np.r_[0, np.cumsum(parts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=None if known is None else np.r_[[not k for k in known], False].astype(bool)), inner)


def ring_column(rings: list[np.ndarray]) -> pa.ListArray:
    """One ring a row."""
    flat = np.concatenate(rings) if rings else np.zeros((0, 2))
    return _nested([len(r) for r in rings], point_array(flat.reshape(-1, 2)))


def polygon_column(polygons: list[list[np.ndarray] | None]) -> pa.ListArray:
    """One polygon a row; None gives null."""
    rings = [np.asarray(r, dtype=np.float64).reshape(-1, 2) for p in polygons for r in p or []]
    return _nested([len(p or []) for p in polygons], ring_column(rings), [p is not None for p in polygons])


def opened(ring: np.ndarray) -> np.ndarray:
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def polygons(column: pa.ListArray) -> list[list[np.ndarray] | None]:
    """A column of polygons as lists of open rings."""
    out: list[list[np.ndarray] | None] = []
    for p in column:
        out.append([opened(points(r.values)) for r in p.values] if p.is_valid else None)
    return out


def signed_area(ring: np.ndarray) -> float:
    """Shoelace area, over zero where the ring runs counter-clockwise."""
    if len(ring) < 3:
        return 0.0
    p = ring - ring[0]
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def inside(ring: np.ndarray, x: float, y: float) -> bool:
    """Even-odd rule."""
    a, b = ring, np.roll(ring, -1, axis=0)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[over], b[over]
    return bool((x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).sum() % 2)
