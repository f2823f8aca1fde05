"""From borders to polygons.

A region's border is a set of directed edges with the region on their left.
``outlines`` finds the border of rectangles that do not overlap, as sums along
the lines on which their sides lie; ``traced`` links the edges of each key to
rings and sorts these into exteriors with their holes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraledger.operators import arrange, shapes

EDGE = ("ax", "ay", "bx", "by")


def outlines(rects: DataFrame, key: Sequence[str], x0: str = "x0", x1: str = "x1", y0: str = "y0", y1: str = "y1", weight: str | None = None) -> DataFrame:
    """key..., ax, ay, bx, by: the border of each key's rectangles, which share sides but no area.

    ``weight`` is 1 or -1: a rectangle of weight -1 is taken away from the one
    of weight 1 in which it lies.  On a line, the sides of the rectangles to
    its one side count against those to its other side; where the sum is not
    zero the line is border.  Sums are spread by (key, line).
    """
    key = list(key)
    sign = F.lit(1) if weight is None else F.col(weight)
    c = lambda n: F.col(n).cast("double")
    side = lambda line, lo, hi, w: F.struct(c(line).alias("line"), c(lo).alias("lo"), c(hi).alias("hi"), (sign * w).alias("w"))

    def swept(a: F.Column, b: F.Column) -> DataFrame:
        sides = rects.select(*key, F.explode(F.array(a, b)).alias("s"))
        ends = sides.select(*key, "s.line", F.explode(F.array(F.struct(F.col("s.lo").alias("at"), F.col("s.w").alias("w")), F.struct(F.col("s.hi").alias("at"), (-F.col("s.w")).alias("w")))).alias("e"))
        steps = ends.groupBy(*key, "line", F.col("e.at").alias("at")).agg(F.sum("e.w").alias("w")).where("w <> 0")
        on = Window.partitionBy(*key, "line").orderBy("at")
        return steps.select(*key, "line", "at", F.sum("w").over(on).alias("net"), F.lead("at").over(on).alias("to")).where("net <> 0 and to is not null")

    up = swept(side(x1, y0, y1, 1), side(x0, y0, y1, -1))
    right = swept(side(y0, x0, x1, 1), side(y1, x0, x1, -1))
    first, last = (F.when(F.col("net") > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("at", "to"), ("to", "at")))
    vertical = up.select(*key, F.col("line").alias("ax"), first.alias("ay"), F.col("line").alias("bx"), last.alias("by"))
    level = right.select(*key, first.alias("ax"), F.col("line").alias("ay"), last.alias("bx"), F.col("line").alias("by"))
    return vertical.unionByName(level)


def trace(edges: np.ndarray) -> list[list[np.ndarray]]:
    """Polygons (exterior counter-clockwise, then its holes) whose border the rows (ax, ay, bx, by) are; rings as in ``arrange.walks``."""
    return traces(np.zeros(len(edges), dtype=int), edges)[1]


def traces(group: np.ndarray, edges: np.ndarray) -> tuple[list[int], list[list[np.ndarray]]]:
    """(group, polygon) of the borders of many groups, which are in order."""
    owner, length, xy = arrange.walks(group, edges)
    rings = np.split(xy, np.cumsum(length)[:-1]) if len(length) else []
    size = arrange.areas(length, xy)
    groups, polygons = [], []
    for i, j in zip(*(v.tolist() for v in arrange.spans(owner)), strict=True):
        found = [[rings[i]]] if j == i + 1 and size[i] > 0 else nested(rings[i:j])
        groups += [int(owner[i])] * len(found)
        polygons += found
    return groups, polygons


def nested(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings that run counter-clockwise, each with the clockwise ones that lie in it and in no smaller one."""
    sized = [(shapes.signed_area(r), r) for r in rings if len(r) > 2]
    outer = sorted(([r] for s, r in sized if s > 0), key=lambda p: (p[0][0].tolist(), p[0].tolist()))
    areas = [shapes.signed_area(p[0]) for p in outer]
    for s, r in sorted(sized, key=lambda x: x[1].tolist()):
        if s < 0:
            x, y = (r[0] + r[1]) / 2
            holders = [i for i, p in enumerate(outer) if areas[i] > -s and shapes.inside(p[0], x, y)]
            if holders:
                outer[min(holders, key=areas.__getitem__)].append(r)
    return outer


def traced(edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """key..., part, rings: the polygons of each key.  A key's border meets in one task: a key is one shape."""
    key = list(key)
    schema = T.StructType([*[edges.schema[k] for k in key], T.StructField("part", T.IntegerType()), T.StructField("rings", T._parse_datatype_string(shapes.RINGS))])
    grouped = edges.groupBy(*key).agg(F.flatten(F.collect_list(F.array(*EDGE))).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, polygons = [], [], []
            for i, e in enumerate(b.column("e")):
                found = trace(e.values.to_numpy(zero_copy_only=False).reshape(-1, 4))
                rows += [i] * len(found)
                parts += range(len(found))
                polygons += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in key), pa.array(parts, pa.int32()), shapes.polygon_column(polygons)], names=[*key, "part", "rings"])

    return grouped.mapInArrow(run, schema)
