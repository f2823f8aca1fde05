"""Simplified polygons whose common borders stay common.

Vertices where other than two border lines meet are junctions.  They cut rings
into arcs; an arc between two polygons is the same points on both sides, walked
in one direction whichever ring it comes from, so both sides keep the same
ones of them (Douglas-Peucker).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraledger.functions import rings as R
from terraledger.operators import shapes


def kept(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay so that those left out lie within ``tolerance`` of it; its ends always do."""
    stay = np.zeros(len(line), dtype=bool)
    stay[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        p, way = line[i + 1 : j] - line[i], line[j] - line[i]
        long = float(way @ way)
        along = np.clip(p @ way / long, 0, 1)[:, None] * way if long else 0
        away = ((p - along) ** 2).sum(1)
        far = int(np.argmax(away))
        if away[far] > tolerance * tolerance:
            k = i + 1 + far
            stay[k] = True
            todo += [(i, k), (k, j)]
    return stay


def _forward(line: np.ndarray) -> bool:
    """Whether a line runs the way in which it is simplified."""
    return line.tolist() <= line[::-1].tolist()


def simplified_ring(ring: np.ndarray, junction: np.ndarray, tolerance: float) -> np.ndarray:
    """An open ring with its arcs simplified; without junctions it is one arc from its least vertex to itself."""
    cuts = np.flatnonzero(junction)
    if not len(cuts):
        cuts = np.lexsort((ring[:, 1], ring[:, 0]))[:1]
    ring = np.roll(ring, -cuts[0], axis=0)
    out = []
    for i, j in zip(cuts - cuts[0], [*(cuts[1:] - cuts[0]), len(ring)], strict=True):
        arc = ring[i : j + 1] if j < len(ring) else np.vstack([ring[i:], ring[:1]])
        stay = kept(arc, tolerance) if _forward(arc) else kept(arc[::-1], tolerance)[::-1]
        out.append(arc[stay][:-1])
    return np.concatenate(out)


def simplified(polys: DataFrame, key: str, rings: str, tolerance: float) -> DataFrame:
    """key, rings: every polygon simplified.  Keys are unique.

    Polygons that share a border must share its vertices.  A hole that shrinks
    to a line is left out; an exterior that would is kept as it was.  A vertex
    meets the few that it is joined to, a polygon its own vertices.
    """
    open_ = polys.select(F.col(key).alias("k"), F.posexplode(F.transform(rings, R.opened)).alias("ring", "p"))
    turn = lambda by: F.concat(F.slice("p", F.lit(1) + by, F.size("p") - by), F.slice("p", F.lit(1), F.lit(by)))
    last = F.concat(F.slice("p", -1, 1), F.slice("p", F.lit(1), F.size("p") - 1))
    v = open_.where("size(p) > 0").select("k", "ring", F.posexplode(F.arrays_zip(F.col("p").alias("p"), turn(1).alias("a"), last.alias("b"))).alias("i", "v")).select("k", "ring", "i", "v.p", "v.a", "v.b")
    met = v.groupBy("p").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.array("a", "b"))))).alias("lines"))
    marked = v.select("k", "ring", "i", "p").join(met.where("lines <> 2").select("p", F.lit(True).alias("j")), "p", "left")
    whole = marked.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ring", "i", "p", F.coalesce("j", F.lit(False)).alias("j")))).alias("v"))
    schema = T.StructType([T.StructField("k", polys.schema[key].dataType), T.StructField("rings", T._parse_datatype_string(shapes.RINGS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.column("v"):
                all_of, no = row.values, row.values.field("ring").to_numpy()
                p, j = shapes.points(all_of.field("p")), all_of.field("j").to_numpy(zero_copy_only=False)
                poly = []
                for r in np.unique(no):
                    ring, junction = p[no == r], j[no == r]
                    thin = simplified_ring(ring, junction, tolerance)
                    if len(thin) > 2 and shapes.signed_area(thin):
                        poly.append(thin)
                    elif r == 0:
                        poly.append(ring)
                out.append(poly)
            yield pa.RecordBatch.from_arrays([b.column("k"), shapes.polygon_column(out)], names=["k", "rings"])

    return whole.mapInArrow(run, schema).select(F.col("k").alias(key), "rings")
