"""Region totals, and regions by layers of polygons."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraledger.functions import rings as R
from terraledger.operators.rollup import sums
from terraledger.operators.spatial import containing


def land_totals(par: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Land and non-exempt land of the whole and of each region field, by grouping sets."""
    free = F.sum(F.when(F.col("exempt") == 0, F.col("land")).otherwise(0))
    return sums(par, fields, [F.sum("land").alias("land"), free.alias("non_exempt")])


def tagged(points: DataFrame, key: str, x: str, y: str, layers: Sequence[tuple[str, DataFrame, Callable[[Column], Column]]], default: str = "(None)", size: int = 1000) -> DataFrame:
    """``points`` with a column a layer: the name of the polygon that holds the point, made fit for its column, or ``default``.

    A layer is (column, polygons, rule); its polygons have name, place and
    rings, holes included.  Of several that hold a point the one with the least
    ``place`` counts.  Keys are unique; a point without coordinates, or outside
    all polygons, or in one whose name is null, gets the default.
    """
    out, at = points, points.select(key, x, y)
    for column, polygons, rule in layers:
        v = lambda c: F.transform(F.element_at("rings", 1), lambda p: p[c])
        boxes = polygons.select("name", "place", "rings", F.array_min(v("x")).alias("_x0"), F.array_max(v("x")).alias("_x1"), F.array_min(v("y")).alias("_y0"), F.array_max(v("y")).alias("_y1"))
        hit = containing(at, boxes, x, y, ("_x0", "_x1", "_y0", "_y1"), size).where(R.holds(F.col("rings"), F.col(x), F.col(y)))
        first = hit.groupBy(key).agg(F.min_by(rule(F.col("name")), "place").alias(column))
        out = out.join(first, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))
    return out
