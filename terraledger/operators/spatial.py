"""Spatial joins and measures on rectangles, and closed-form projections.

A join on overlap explodes each side to the grid cells it touches and joins on
the cell; a pair that shares several cells is reported in the one that holds
the lower-left corner of the overlap, so no distinct is needed afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terraledger.functions import rings as R
from terraledger.operators.lineage import saved

#: Web Mercator's radius, and the semi-axis and eccentricity of WGS 84.
RADIUS, SEMI_AXIS, ECC = 6378137.0, 6378137.0, 0.0818191908426215


def cells(df: DataFrame, x0: str, x1: str, y0: str, y1: str, size: int) -> DataFrame:
    """One row for each grid cell a rectangle touches: _ix, _iy."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return df.withColumn("_ix", span(x0, x1)).withColumn("_iy", span(y0, y1))


def overlap(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Area that two rectangles share; 0 if none."""
    w = F.least(F.col(a[1]), F.col(b[1])) - F.greatest(F.col(a[0]), F.col(b[0]))
    h = F.least(F.col(a[3]), F.col(b[3])) - F.greatest(F.col(a[2]), F.col(b[2]))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def overlapping(left: DataFrame, right: DataFrame, a: tuple[str, str, str, str], b: tuple[str, str, str, str], size: int = 400, touch: bool = False, same: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of rectangles that share area (with ``touch``: or a border), with ``shared``; with ``same`` only those equal in two columns."""
    l, r = cells(left, *a, size), cells(right, *b, size)
    x, y = F.greatest(F.col(a[0]), F.col(b[0])), F.greatest(F.col(a[2]), F.col(b[2]))
    own = (F.floor(x / size) == l["_ix"]) & (F.floor(y / size) == l["_iy"])
    if touch:
        hit = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col(a[2]) <= F.col(b[3])) & (F.col(b[2]) <= F.col(a[3]))
    else:
        hit = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col(a[2]) < F.col(b[3])) & (F.col(b[2]) < F.col(a[3]))
    on = (l["_ix"] == r["_ix"]) & (l["_iy"] == r["_iy"]) & own & hit
    if same:
        on &= l[same[0]] == r[same[1]]
    return l.join(r, on).drop("_ix", "_iy").withColumn("shared", overlap(a, b))


def first_meeting(left: DataFrame, right: DataFrame, a: tuple[str, str, str, str], b: tuple[str, str, str, str], rid: str, more: Sequence[str], size: int = 100) -> DataFrame:
    """Left rectangles that meet right ones, with the least ``rid`` of these and its ``more``.

    Equal rectangles meet the same ones, so each place and size is joined once,
    by the least id it has.
    """
    of = lambda t: F.min_by(t, F.col(f"{t}.{rid}") if isinstance(t, str) else rid)
    first = right.groupBy(*b).agg(of(F.struct(rid, *more)).alias("_t"))
    hit = overlapping(left.select(*a).distinct(), first, a, b, size, touch=True).groupBy(*a).agg(of("_t").alias("_t"))
    return left.join(hit, list(a)).select(*left.columns, "_t.*")


def containing(points: DataFrame, boxes: DataFrame, x: str, y: str, b: tuple[str, str, str, str], size: int = 400, how: str = "inner") -> DataFrame:
    """Points with each rectangle that holds them (borders included)."""
    r = cells(boxes, *b, size)
    p = points.withColumn("_px", F.floor(F.col(x) / size)).withColumn("_py", F.floor(F.col(y) / size))
    on = (p["_px"] == r["_ix"]) & (p["_py"] == r["_iy"]) & F.col(x).between(F.col(b[0]), F.col(b[1])) & F.col(y).between(F.col(b[2]), F.col(b[3]))
    return p.join(r, on, how).drop("_px", "_py", "_ix", "_iy")


def nearest(left: DataFrame, right: DataFrame, k: int, lid: str, rid: str, lx: str, ly: str, rx: str, ry: str, size: float = 200, others: bool = False) -> DataFrame:
    """The k nearest right points of each left point by squared distance ``d2``, then id: ``place`` from 1.

    Points meet in tiles of ``TILE`` cells a side, to which the right points
    around them go too; left points look at the nine cells around them, and
    only their neighbours leave the tile, with all columns of both sides.  What
    lies within a cell's width is then complete; points with fewer than k such
    neighbours go on with cells twice as wide, until a cell is as wide as the
    whole map.  With ``others`` a point of the same id is no neighbour.  Ids
    are unique; both sides are read several times.
    """
    span = lambda df, x, y: df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    boxes = [b for b in (span(left, lx, ly), span(right, rx, ry)) if b["x0"] is not None]
    extent = max((max(b[f"{c}1"] for b in boxes) - min(b[f"{c}0"] for b in boxes) for c in "xy"), default=0)
    step = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    dist = (F.col(lx) - F.col(rx)) * (F.col(lx) - F.col(rx)) + (F.col(ly) - F.col(ry)) * (F.col(ly) - F.col(ry))
    first = Window.partitionBy(lid).orderBy("d2", rid)
    pending, out = left, None
    if size <= extent:
        tiled = _tiled(left, right, k, lid, rid, lx, ly, rx, ry, size, others, dist)
        pending, out = saved(tiled(False)), tiled(True)
        if pending.isEmpty():
            return out
        size *= 2
    while True:
        l = pending.withColumn("_dx", step).withColumn("_dy", step).withColumn("_ix", F.floor(F.col(lx) / size) + F.col("_dx")).withColumn("_iy", F.floor(F.col(ly) / size) + F.col("_dy")).drop("_dx", "_dy")
        r = right.withColumn("_ix", F.floor(F.col(rx) / size)).withColumn("_iy", F.floor(F.col(ry) / size))
        met = l.join(r, ["_ix", "_iy"]).drop("_ix", "_iy").withColumn("d2", dist)
        last = size > extent
        if not last:
            met = met.where(F.col("d2") <= size * size)
        if others:
            met = met.where(F.col(lid) != F.col(rid))
        near = met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
        if not last:
            near = saved(near)
            full = near.where(F.col("place") == k).select(lid)
            pending = saved(pending.join(full, lid, "left_anti"))
            near, last = near.join(full, lid, "left_semi"), pending.isEmpty()
        out = near if out is None else out.unionByName(near)
        if last:
            return out
        size *= 2


#: Cells along a side of a tile in which neighbours are looked for, and pairs of points looked at at a time.
TILE, PAIRS = 8, 1 << 20


def _tiled(left: DataFrame, right: DataFrame, k: int, lid: str, rid: str, lx: str, ly: str, rx: str, ry: str, size: float, others: bool, dist: Column) -> Callable[[bool], DataFrame]:
    """f(True): neighbours of the left points that have k within a cell's width; f(False): the other left points."""
    cell = lambda c: F.floor(F.col(c) / size)
    tile = lambda c: F.floor(c / TILE)
    reach = lambda c: F.explode(F.sequence(tile(cell(c) - 1), tile(cell(c) + 1)))
    l = left.where(F.col(lx).isNotNull() & F.col(ly).isNotNull()).withColumn("_tx", tile(cell(lx))).withColumn("_ty", tile(cell(ly)))
    r = right.where(F.col(rx).isNotNull() & F.col(ry).isNotNull()).withColumn("_tx", reach(rx)).withColumn("_ty", reach(ry))
    d2 = left.select(lx, ly).crossJoin(right.select(rx, ry)).select(dist.alias("d2")).schema["d2"]
    schemas = {True: T.StructType([*left.schema, *right.schema, d2, T.StructField("place", T.IntegerType())]), False: left.schema}
    lefts, rights = left.columns, right.columns

    def found(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left row, right row, d2): k rows for each left point that has as many within a cell's width, the nearest first."""
        v = lambda t, c: t.column(c).to_numpy()
        b_order = np.argsort(v(b, rid), kind="stable")
        bx, by, ax, ay = v(b, rx)[b_order], v(b, ry)[b_order], v(a, lx), v(a, ly)
        at = lambda x, y: (np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64))
        (ai, aj), (bi, bj) = at(ax, ay), at(bx, by)
        own, which = np.unique(np.stack([ai, aj]), axis=1, return_inverse=True)
        by_cell = np.argsort(which.ravel(), kind="stable")
        columns = np.argsort(bi, kind="stable")
        got = []
        for (i, j), rows in zip(own.T, np.split(by_cell, np.cumsum(np.bincount(which.ravel()))[:-1]), strict=True):
            near = columns[slice(*np.searchsorted(bi[columns], [i - 1, i + 2]))]
            near = np.sort(near[np.abs(bj[near] - j) <= 1])  # in order of ids, which breaks ties
            for s in range(0, len(rows), n := max(1, PAIRS // max(1, len(near)))):
                some = rows[s : s + n]
                dx, dy = ax[some, None] - bx[near], ay[some, None] - by[near]
                d = dx * dx + dy * dy
                ok = d <= size * size
                if others:
                    ok &= v(a, lid)[some, None] != v(b, rid)[b_order[near]]
                full = ok.sum(1) >= k
                some, d, ok = some[full], d[full], ok[full]
                if not len(some):
                    continue
                far = np.where(ok, d, size * size + 1)
                ok &= d <= np.partition(far, k - 1, axis=1)[:, k - 1 : k]
                p, q = np.nonzero(ok)
                order = np.lexsort((d[p, q], p))  # stable, so equal ones stay in order of ids
                p, q = p[order], q[order]
                head = np.arange(len(p)) - np.searchsorted(p, p) < k
                p, q = p[head], q[head]
                got.append((some[p], b_order[near[q]], d[p, q]))
        if not got:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def run(full: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        target = to_arrow_schema(schemas[full])

        def one(a: pa.Table, b: pa.Table) -> pa.Table:
            p, q, d = found(a, b) if len(a) else (np.zeros(0, dtype=np.int64),) * 3
            if not full:
                rest = np.ones(len(a), dtype=bool)
                rest[p] = False
                return a.select(lefts).filter(pa.array(rest)).cast(target)
            place = pa.array(np.arange(len(p)) % k + 1)
            return pa.Table.from_arrays([*a.select(lefts).take(pa.array(p)).columns, *b.select(rights).take(pa.array(q)).columns, pa.array(d), place], names=target.names).cast(target)

        return one

    return lambda full: l.groupBy("_tx", "_ty").cogroup(r.groupBy("_tx", "_ty")).applyInArrow(run(full), schemas[full])


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 of degrees."""
    return F.radians(lon) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of EPSG:3857."""
    return F.degrees(x / RADIUS), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - math.pi / 2)


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area metres (standard parallel 30 degrees, WGS 84)."""
    s30 = math.sin(math.radians(30))
    k0 = math.cos(math.radians(30)) / math.sqrt(1 - ECC**2 * s30**2)
    s = F.sin(F.radians(lat))
    q = (1 - ECC**2) * (s / (1 - ECC**2 * s * s) - F.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
    return F.radians(lon) * SEMI_AXIS * k0, q * SEMI_AXIS / (2 * k0)


#: Fixed value: square feet of a square metre.
SQUARE_FEET = 10.76391041671


def geodesic_area(rings: Column) -> Column:
    """Square feet of a polygon in degrees on the ellipsoid, holes subtracted; null for none.

    Vertices go to an equal-area map, sides are straight there: over a parcel
    that is the geodesic area to eight digits.
    """
    def flat(p: Column) -> Column:
        x, y = equal_area(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    def moved(origin: Column) -> Column:  # near the origin, so that products do not cancel
        return F.transform(rings, lambda r: F.transform(F.transform(r, flat), lambda p: F.struct((p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y"))))

    return F.greatest(R.let(R.let(flat(rings[0][0]), moved), R.area), F.lit(0.0)) * SQUARE_FEET


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile of a point, clamped to the map."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
    return clamp(x), clamp(y)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of an array of struct(x, y); the ring is closed implicitly."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: at(i)["x"] * at(i % n + 1)["y"] - at(i % n + 1)["x"] * at(i)["y"])
    return F.aggregate(terms, F.lit(0).cast("double"), lambda a, x: a + x) / 2
