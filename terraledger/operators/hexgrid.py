"""A hexagonal grid in the plane: axial cells by cube rounding (pointy top)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraledger.functions import rings as R


#: Resolutions and the zooms that they serve, counts of parcels above which the finest ones are left out, zoom of the parcels otherwise.
BANDS = {7: (0, 6), 8: (7, 8), 10: (9, 9), 11: (10, 11), 12: (12, 12)}
CAPS = {11: 1_000_000, 12: 600_000}
PARCEL_ZOOM = 13


def ladder(parcels: Column, median: Column) -> Column:
    """Which hexagons stand for parcels at low zooms: struct(kept, hex_maxzoom, parcel_minzoom).

    Fine resolutions go where parcels are many, and those whose hexagon is
    smaller than the median parcel (square metres), though the coarsest stays;
    parcels then take over at the first zoom of those that were too small.
    """
    counted = F.filter(F.array(*[F.lit(r) for r in BANDS]), lambda r: ~F.coalesce(*[F.when((r >= k) & (parcels > n), True) for k, n in CAPS.items()], F.lit(False)))
    areas = F.create_map(*[F.lit(v) for r in BANDS for v in (r, R.HEX_AREAS[r])])
    starts = F.create_map(*[F.lit(v) for r, (low, _) in BANDS.items() for v in (r, low)])
    small = F.filter(counted, lambda r: F.element_at(areas, r) < median)
    fine = F.array_except(counted, small)
    kept = F.when(F.size(fine) > 0, fine).otherwise(F.slice(counted, 1, 1))
    first = F.coalesce(F.array_min(F.transform(F.array_except(counted, kept), lambda r: F.element_at(starts, r))), F.lit(PARCEL_ZOOM))
    return F.struct(kept.alias("kept"), (first - 1).alias("hex_maxzoom"), first.alias("parcel_minzoom"))


def binned(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """``df`` with the axial coordinates hq, hr of the hexagon (centre to corner: ``size``) that holds each point.

    Rounding is floor(v + 0.5); the coordinate that rounding moved most is
    recomputed from the other two, so the three always add up to 0.
    """
    q = (F.col(x) * (math.sqrt(3) / 3) - F.col(y) / 3) / size
    r = F.col(y) * 2 / 3 / size
    d = df.withColumns({"_q": q, "_r": r}).withColumns({"_a": F.floor(F.col("_q") + 0.5), "_b": F.floor(F.col("_r") + 0.5), "_c": F.floor(-F.col("_q") - F.col("_r") + 0.5)})
    dq, dr, ds = F.abs(F.col("_a") - F.col("_q")), F.abs(F.col("_b") - F.col("_r")), F.abs(F.col("_c") + F.col("_q") + F.col("_r"))
    hq = F.when((dq > dr) & (dq > ds), -F.col("_b") - F.col("_c")).otherwise(F.col("_a"))
    hr = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -F.col("_a") - F.col("_c")).otherwise(F.col("_b"))
    return d.withColumns({"hq": hq, "hr": hr}).drop("_q", "_r", "_a", "_b", "_c")


def ring(q, r, size: float):
    """Corners of a hexagon as an array of struct(x, y)."""
    cx, cy = (q * math.sqrt(3) + r * (math.sqrt(3) / 2)) * size, r * 1.5 * size
    corner = lambda k: F.struct((cx + size * math.cos(math.pi / 6 + k * math.pi / 3)).alias("x"), (cy + size * math.sin(math.pi / 6 + k * math.pi / 3)).alias("y"))
    return F.array(*[corner(k) for k in range(6)])


def area(size: float) -> float:
    return 1.5 * math.sqrt(3) * size * size


def _extent(rings: Column, c: str) -> tuple[Column, Column]:
    v = F.transform(F.element_at(rings, 1), lambda p: p[c])
    return F.array_min(v), F.array_max(v)


def _each(df: DataFrame, name: str, lo: Column, hi: Column) -> DataFrame:
    """A row for each whole number from ``lo`` to ``hi``; none where lo > hi."""
    d = df.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).where("_lo <= _hi")
    return d.withColumn(name, F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def polyfill(df: DataFrame, rings: str, size: float) -> DataFrame:
    """A row for each hexagon whose centre lies in the polygon: ``df`` with hq, hr.

    Row by row of the grid: the stretches of the row's middle line inside the
    polygon give the hexagons as intervals, so the work is the rows and the
    hexagons found, not those of the extent.
    """
    wide, high = math.sqrt(3) * size, 1.5 * size
    low, top = _extent(F.col(rings), "y")
    rows = _each(df, "hr", F.ceil(low / high), F.floor(top / high))
    s = rows.withColumn("_s", F.explode(R.spans(F.col(rings), F.col("hr") * high)))
    first = lambda c: F.ceil(F.col(f"_s.{c}") / wide - F.col("hr") / 2)
    return _each(s, "hq", first("lo"), first("hi") - 1).drop("_s")


def touched(df: DataFrame, rings: str, size: float) -> DataFrame:
    """A row for each hexagon that the polygon's extent may touch: ``df`` with hq, hr."""
    wide, high = math.sqrt(3) * size, 1.5 * size
    low, top = _extent(F.col(rings), "y")
    left, right = _extent(F.col(rings), "x")
    rows = _each(df, "hr", F.ceil((low - size) / high), F.floor((top + size) / high))
    return _each(rows, "hq", F.ceil((left - wide / 2) / wide - F.col("hr") / 2), F.floor((right + wide / 2) / wide - F.col("hr") / 2))


def planes(size: float) -> Column:
    """The six half planes whose common part is a hexagon around the origin."""
    faces = [(math.cos(k * math.pi / 3), math.sin(k * math.pi / 3)) for k in range(6)]
    return F.array(*[F.struct(F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), F.lit(math.sqrt(3) / 2 * size).alias("c")) for nx, ny in faces])


def pieces(df: DataFrame, rings: str, size: float) -> DataFrame:
    """``df`` with hq, hr and ``piece``: the area that a polygon and a hexagon share, holes left out; only where there is some.

    Exact: every ring is clipped by the hexagon's half planes, seen from the
    hexagon's middle, so that far from the origin products do not cancel.
    """
    cx, cy = (F.col("hq") + F.col("hr") / 2) * math.sqrt(3) * size, F.col("hr") * (1.5 * size)
    cut = touched(df, rings, size).withColumn("_c", F.struct(cx.alias("x"), cy.alias("y")))
    moved = lambda ring: F.transform(ring, lambda p: F.struct((p["x"] - F.col("_c.x")).alias("x"), (p["y"] - F.col("_c.y")).alias("y")))
    sizes = F.transform(F.col(rings), lambda ring: R.let(R.clipped(moved(ring), planes(size)), lambda c: F.abs(R.signed_area(c))))
    piece = R.let(sizes, lambda s: F.aggregate(s, F.element_at(s, 1) * 2, lambda t, a: t - a))
    # a generator, so that the filter does not compute the piece once more
    return cut.withColumn("piece", F.explode(F.array(piece))).drop("_c").where(F.col("piece") > 1e-9)


def binned_pieces(df: DataFrame, rings: str, size: float, times: float = 3.0) -> DataFrame:
    """``df`` with hq, hr, ``piece``, for inputs too large for exact pieces.

    A polygon goes to the hexagon of a point inside it, with its area or the
    hexagon's, whichever is less.  One of over ``times`` a hexagon's area also
    fills the other hexagons whose centre it holds, each with its whole area.
    """
    once = F.explode(F.array(F.struct(R.area(F.col(rings)).alias("a"), R.inside_point(F.col(rings)).alias("p"))))  # a generator: what uses it does not compute it again
    sized = df.withColumn("_o", once).withColumns({"_area": F.col("_o.a"), "_at": F.col("_o.p")}).drop("_o")
    base = binned(sized.withColumns({"_x": F.col("_at.x"), "_y": F.col("_at.y")}), "_x", "_y", size).drop("_x", "_y", "_at")
    own = base.withColumn("piece", F.least(F.col("_area"), F.lit(area(size))))
    large = base.where(F.col("_area") > times * area(size)).withColumnsRenamed({"hq": "_oq", "hr": "_or"})
    more = polyfill(large, rings, size).where("hq <> _oq or hr <> _or").withColumn("piece", F.lit(area(size)))
    cols = [*df.columns, "hq", "hr", "piece"]
    return own.select(*cols).unionByName(more.select(*cols))
