"""Roads as strips of their width, and land without them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraledger.functions import rings as R
from terraledger.operators.overlay import taken

#: Half of a road's width in metres by its class, of other classes, of a lane, and of what lies beside the lanes.
HALF_WIDTHS = {
    "motorway": 18, "trunk": 14, "primary": 11, "secondary": 9, "tertiary": 7, "residential": 5, "unclassified": 6, "service": 3.5,
    "motorway_link": 10, "trunk_link": 9, "primary_link": 8, "secondary_link": 7,
}
OTHER, LANE, BESIDE = 6.0, 1.75, 1.5
#: Straight pieces of a strip's round end.
ROUND = 16


def half_width(kind: Column, lanes: Column) -> Column:
    """Half of a road's width: that of its class, or of its lanes where they are known and need more."""
    table = F.create_map(*[F.lit(v) for k, w in HALF_WIDTHS.items() for v in (k, float(w))])
    return F.greatest(F.coalesce(F.try_element_at(table, kind), F.lit(OTHER)), lanes.try_cast("double") * LANE + BESIDE)


def strip(ax: Column, ay: Column, bx: Column, by: Column, half: Column) -> Column:
    """All places within ``half`` of a straight road, as a polygon with round ends."""
    turn = F.atan2(by - ay, bx - ax)

    def end(x: Column, y: Column, start: float) -> Column:
        at = lambda i: turn + (F.lit(start) + i * (math.pi / ROUND))
        return F.transform(F.sequence(F.lit(0), F.lit(ROUND)), lambda i: F.struct((x + half * F.cos(at(i))).alias("x"), (y + half * F.sin(at(i))).alias("y")))

    return F.array(F.concat(end(ax, ay, math.pi / 2), end(bx, by, -math.pi / 2)))


def without_roads(land: DataFrame, key: str, roads: DataFrame, least: float = 0.0, cell: int = 200) -> DataFrame:
    """key, part, rings of land (key, rings) less all roads (road, rings), parts under ``least`` in area left out.

    Roads that cross or overlap count once; land that no road meets stays as it is.
    """
    return taken(land, roads, key, "difference", cell=cell).where(R.area(F.col("rings")) >= least)
