"""Polygons as arrays of rings (the first is the exterior, the others are holes), rings as arrays of struct(x, y)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Average hexagon areas of the resolutions 0 to 15, in square metres.
HEX_AREAS = (
    4357449416078.383, 609788441794.133, 86801780398.997, 12393434655.088, 1770347654.491, 252903858.182, 36129062.164, 5161293.360,
    737327.598, 105332.513, 15047.502, 2149.643, 307.092, 43.870, 6.267, 0.895)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def opened(ring: Column) -> Column:
    """The ring without a last vertex that repeats the first."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def signed_area(ring: Column) -> Column:
    """Shoelace area, over zero where the ring runs counter-clockwise; 0 for fewer than three vertices."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2)


def area(rings: Column) -> Column:
    """Area of the exterior less the holes."""
    sizes = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return F.aggregate(sizes, F.lit(0.0), lambda s, a: s - a) + F.element_at(sizes, 1) * 2


def vertex_mean(ring: Column) -> Column:
    """Mean of the vertices, the closing one left out."""
    o = opened(ring)
    mean = lambda c: F.aggregate(o, F.lit(0.0), lambda s, v: s + v[c]) / F.size(o)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def centroid(rings: Column) -> Column:
    """Centre of mass of the exterior less the holes."""

    def moment(ring: Column, c: str) -> Column:
        after = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
        terms = F.zip_with(ring, after, lambda a, b: (a[c] + b[c]) * (a["x"] * b["y"] - b["x"] * a["y"]))
        return F.signum(signed_area(ring)) * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 6

    total = lambda c: moment(F.element_at(rings, 1), c) - F.aggregate(F.transform(F.slice(rings, F.lit(2), F.size(rings) - 1), lambda r: moment(r, c)), F.lit(0.0), lambda s, t: s + t)
    return F.struct((total("x") / area(rings)).alias("x"), (total("y") / area(rings)).alias("y"))


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """How often a ray to the right of a point crosses the ring."""
    after = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
    hit = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])
    return F.aggregate(F.zip_with(ring, after, lambda a, b: F.coalesce(hit(a, b), F.lit(False)).cast("int")), F.lit(0), lambda s, t: s + t)


def _joined(ring: Column) -> Column:
    """Each vertex's successor, the first after the last."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def spans(rings: Column, y: Column) -> Column:
    """The stretches of a level line inside a polygon, as an array of struct(lo, hi); lower ends belong to it, upper ends do not."""
    at = lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])
    hits = F.transform(rings, lambda r: F.filter(F.zip_with(r, _joined(r), at), lambda x: x.isNotNull()))
    pair = lambda xs, i: F.struct(F.get(xs, i * 2).alias("lo"), F.get(xs, i * 2 + 1).alias("hi"))
    none = F.array().cast("array<struct<lo:double,hi:double>>")
    paired = lambda xs: F.when(F.size(xs) > 1, F.transform(F.sequence(F.lit(0), (F.size(xs) / 2 - 1).cast("int")), lambda i: pair(xs, i))).otherwise(none)
    return let(F.array_sort(F.flatten(hits)), paired)


def inside_point(rings: Column) -> Column:
    """A point that surely lies in a polygon: the middle of the widest stretch (the first of equal ones) of a level line.

    The line runs midway between the vertices next above and below the middle
    of the extent, so it meets no vertex.
    """
    first = F.transform(F.element_at(rings, 1), lambda p: p["y"])
    every = F.transform(F.flatten(rings), lambda p: p["y"])
    level = lambda mid: (F.array_max(F.filter(every, lambda v: v <= mid)) + F.array_min(F.filter(every, lambda v: v > mid))) / 2
    wider = lambda best, s: F.when(best.isNull() | (s["hi"] - s["lo"] > best["hi"] - best["lo"]), s).otherwise(best)
    widest = lambda y: F.aggregate(spans(rings, y), F.lit(None).cast("struct<lo:double,hi:double>"), wider)
    at = lambda y: let(widest(y), lambda w: F.struct(((w["lo"] + w["hi"]) / 2).alias("x"), y.alias("y")))
    return let(let((F.array_min(first) + F.array_max(first)) / 2, level), at)


def clipped(ring: Column, planes: Column) -> Column:
    """A ring cut by half planes, one after the other (Sutherland-Hodgman); ``planes`` are struct(nx, ny, c): inside is nx x + ny y <= c.

    Where the rest falls apart, its pieces hang together by edges that are
    walked to and fro; areas are not touched by them.
    """
    none = F.array().cast("array<struct<x:double,y:double>>")

    def cut(r: Column, h: Column) -> Column:
        out = lambda p: h["nx"] * p["x"] + h["ny"] * p["y"] - h["c"]

        def step(a: Column, b: Column) -> Column:
            t = a["d"] / F.when(a["d"] != b["d"], a["d"] - b["d"])
            meet = F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
            end = F.struct(b["x"].alias("x"), b["y"].alias("y"))
            return F.when((b["d"] <= 0) & (a["d"] > 0), F.array(meet, end)).when(b["d"] <= 0, F.array(end)).when(a["d"] <= 0, F.array(meet)).otherwise(none)

        away = F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), out(p).alias("d")))
        return let(away, lambda v: F.flatten(F.zip_with(v, _joined(v), step)))

    return F.aggregate(planes, ring.cast("array<struct<x:double,y:double>>"), cut)


def holds(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, holes left out (even-odd rule)."""
    return F.aggregate(F.transform(rings, lambda r: crossings(r, x, y)), F.lit(0), lambda s, n: s + n) % 2 == 1


def filled(rings: Column, under: float | None = None) -> Column:
    """Without holes, or without those of less than ``under`` in area."""
    keep = F.slice(rings, 1, 1)
    if under is None:
        return keep
    return F.concat(keep, F.filter(F.slice(rings, F.lit(2), F.size(rings) - 1), lambda r: F.abs(signed_area(r)) >= under))


def wound(rings: Column) -> Column:
    """Exterior counter-clockwise, holes clockwise."""
    return F.transform(rings, lambda r, i: F.when((signed_area(r) > 0) == (i == 0), r).otherwise(F.reverse(r)))


def rounded(rings: Column, digits: int = 6) -> Column:
    """Coordinates rounded, halves up."""
    k = 10.0**digits
    r = lambda v: F.floor(v * k + 0.5) / k
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(r(p["x"]).alias("x"), r(p["y"]).alias("y"))))


def canonical(ring: Column) -> Column:
    """The open ring, counter-clockwise and begun at its least vertex, so that equal shapes are equal arrays."""
    o = opened(ring)
    way = F.when(signed_area(o) < 0, F.reverse(o)).otherwise(o)
    at = F.array_position(way, F.array_min(way)).cast("int")
    return F.concat(F.slice(way, at, F.size(way) - at + 1), F.slice(way, F.lit(1), at - 1))


def shape_key(rings: Column, grid: float = 1e-7) -> Column:
    """MD5 of a geometry on a grid, whatever vertex its rings begin at and whichever way they run."""
    snapped = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.round(p["x"] / grid).cast("long").alias("x"), F.round(p["y"] / grid).cast("long").alias("y"))))
    text = F.transform(snapped, lambda r: F.array_join(F.transform(canonical(r), lambda p: F.concat_ws(" ", p["x"], p["y"])), ","))
    return F.md5(F.array_join(F.concat(F.slice(text, 1, 1), F.array_sort(F.slice(text, F.lit(2), F.size(text) - 1))), ";"))


def repaired(rings: Column) -> Column:
    """Repeated neighbours and rings without area left out; null if the exterior has none."""
    def bare(ring):
        o = opened(ring)
        return F.filter(o, lambda p, i: (i == 0) | (p != F.element_at(o, F.when(i == 0, 1).otherwise(i).cast("int"))))

    bare_rings = F.transform(rings, bare)
    good = lambda r: (F.size(r) >= 3) & (F.abs(signed_area(r)) > 0)
    return F.when(good(F.element_at(bare_rings, 1)), F.filter(bare_rings, good))


#: Fixed value: metres of a degree of latitude.
METRES_PER_DEGREE = 111320


def metric_area(ring: Column, lat: Column) -> Column:
    """Square metres of a ring in degrees near a latitude, on a flat map of its surroundings."""
    wide = F.cos(F.radians(lat)) * METRES_PER_DEGREE
    return F.abs(signed_area(F.transform(ring, lambda p: F.struct((p["x"] * wide).alias("x"), (p["y"] * METRES_PER_DEGREE).alias("y")))))


def resolution(largest: Column) -> Column:
    """The hexagon resolution whose average area is nearest; 9 for no area."""
    errors = F.array(*[F.struct(F.abs(largest - a).alias("e"), F.lit(i).alias("i")) for i, a in enumerate(HEX_AREAS)])
    return F.when(largest > 0, F.array_min(errors)["i"]).otherwise(9)
