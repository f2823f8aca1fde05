"""Prism meshes of grid cells, their checks and exports, and the ordered overlap carve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraledger.functions.rings import let
from terraledger.operators.spatial import cells

#: A unit box's corners as bits x, y, z, and its twelve outward triangles.
FACES = [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)]

#: Places of a cell's grid that are painted at a time.
PAINT = 1 << 21


def prisms(cells: DataFrame, x: str, y: str, height: str) -> DataFrame:
    """Twelve triangles a cell: cell, face, p1, p2, p3 (struct x, y, z)."""
    at = lambda k: F.struct((F.col(x) + (k & 1)).cast("double").alias("x"), (F.col(y) + (k >> 1 & 1)).cast("double").alias("y"), (F.lit(k >> 2) * F.col(height)).cast("double").alias("z"))
    faces = F.array(*[F.struct(*[at(k).alias(f"p{i + 1}") for i, k in enumerate(f)]) for f in FACES])
    return cells.select(F.struct(x, y).alias("cell"), F.posexplode(faces).alias("face", "t")).select("cell", "face", "t.*")


#: The four walls of a cell: the neighbour behind it, and its lower corners from left to right, seen from there.
WALLS = [((1, 0), (1, 0), (1, 1)), ((-1, 0), (0, 1), (0, 0)), ((0, 1), (1, 1), (0, 1)), ((0, -1), (0, 0), (1, 0))]


def heightfield(cells: DataFrame, x: str, y: str, height: str) -> DataFrame:
    """One closed surface over unit cells: cell, p1, p2, p3 (struct x, y, z), outward.

    Cells of one height share no wall; between unequal ones stands the step
    that is left over, and where the grid ends a wall down to 0.  A wall's
    corners are cut at the heights of all four cells around them, so no
    triangle ends in the middle of another's side.  Every cell learns its
    eight neighbours' heights from one shuffle.  Cells are unique; those
    without a positive height are none.
    """
    c = cells.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(height).cast("double").alias("h")).where("h > 0")
    near = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    sent = c.select(F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(k).alias("k"), F.col("h").alias("h")) for k, (dx, dy) in enumerate(near)])).alias("s")).select("s.*")
    around = sent.groupBy("x", "y").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("h"))), F.lit(0.0)).alias(f"h{k}") for k in range(9)]).where(f"h{near.index((0, 0))} > 0")
    at = lambda d: F.col(f"h{near.index(d)}")
    h = at((0, 0))
    point = lambda corner, z: F.struct((F.col("x") + corner[0]).cast("double").alias("x"), (F.col("y") + corner[1]).cast("double").alias("y"), z.alias("z"))
    triangle = lambda a, b, d: F.struct(a.alias("p1"), b.alias("p2"), d.alias("p3"))
    zero = F.lit(0.0)
    flat = [triangle(*[point(p, z) for p in ps]) for z, ps in ((h, ((0, 0), (1, 0), (1, 1))), (h, ((0, 0), (1, 1), (0, 1))), (zero, ((0, 0), (1, 1), (1, 0))), (zero, ((0, 0), (0, 1), (1, 1))))]
    walls = []
    for behind, p, q in WALLS:
        low = at(behind)

        def cut(corner, low, make):
            """Triangles from one corner's lower end to the next, at the heights around it."""
            four = F.array(*[at((i, j)) for i in (corner[0] - 1, corner[0]) for j in (corner[1] - 1, corner[1])])
            levels = F.array_sort(F.array_distinct(F.filter(four, lambda z: (z >= low) & (z <= h))))
            return let(levels, lambda z: F.transform(F.sequence(F.lit(0), F.size(z) - 2), lambda i: make(F.get(z, i), F.get(z, i + 1))))

        right = cut(q, low, lambda a, b: triangle(point(p, low), point(q, a), point(q, b)))
        left = cut(p, low, lambda a, b: triangle(point(q, h), point(p, b), point(p, a)))
        walls.append(F.when(h > low, F.concat(right, left)))
    none = F.slice(F.array(*flat), 1, 0)
    return around.select(F.struct("x", "y").alias("cell"), F.explode(F.concat(F.array(*flat), *[F.coalesce(w, none) for w in walls])).alias("t")).select("cell", "t.*")


def closed(triangles: DataFrame) -> DataFrame:
    """One row over the whole surface: cells, triangles, edges that their opposites do not close, edges of more than two triangles, volume."""
    edges = triangles.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("p1", "p2"), ("p2", "p3"), ("p3", "p1"))])).alias("e"))
    way = F.when(F.col("e.a") < F.col("e.b"), 1).otherwise(-1)
    per = edges.groupBy(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).agg(F.sum(way).alias("s"), F.count("*").alias("n"))
    open_ = per.agg(F.count_if(F.col("s") != 0).alias("open_edges"), F.count_if(F.col("n") > 2).alias("thick_edges"))
    total = triangles.agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("triangles"), F.round(F.sum(_determinant()) / 6, 4).alias("volume"))
    return total.crossJoin(open_)  # one row each


def _determinant():
    c = lambda p, k: F.col(f"{p}.{k}")
    return c("p1", "x") * (c("p2", "y") * c("p3", "z") - c("p2", "z") * c("p3", "y")) - c("p1", "y") * (c("p2", "x") * c("p3", "z") - c("p2", "z") * c("p3", "x")) + c("p1", "z") * (c("p2", "x") * c("p3", "y") - c("p2", "y") * c("p3", "x"))


def checked(triangles: DataFrame) -> DataFrame:
    """One row: cells, triangles, edges that no opposite edge closes, signed volume."""
    edges = triangles.select("cell", F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("p1", "p2"), ("p2", "p3"), ("p3", "p1"))])).alias("e"))
    key = F.when(F.col("e.a") < F.col("e.b"), F.struct(F.col("e.a"), F.col("e.b"))).otherwise(F.struct(F.col("e.b").alias("a"), F.col("e.a").alias("b")))
    way = F.when(F.col("e.a") < F.col("e.b"), 1).otherwise(-1)
    open_ = edges.groupBy("cell", key.alias("k")).agg(F.sum(way).alias("s"), F.count("*").alias("n")).agg(F.count_if((F.col("s") != 0) | (F.col("n") != 2)).alias("open_edges"))
    total = triangles.agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("triangles"), F.round(F.sum(_determinant()) / 6, 4).alias("volume"))
    return total.crossJoin(open_).select("cells", "triangles", "open_edges", "volume")  # one row each


def stl_lines(triangles: DataFrame) -> DataFrame:
    """Facets as ASCII STL text, one value a triangle."""
    v = lambda p: F.format_string("vertex %f %f %f", f"{p}.x", f"{p}.y", f"{p}.z")
    return triangles.select(F.concat_ws("\n", F.lit("facet normal 0 0 0"), F.lit("outer loop"), v("p1"), v("p2"), v("p3"), F.lit("endloop"), F.lit("endfacet")).alias("value"))


def stl_records(triangles: DataFrame) -> DataFrame:
    """Facets as the 50-byte records of binary STL (little-endian floats), in no order; a head of 80 bytes and the count go before them."""
    def run(parts):
        for t in parts:
            flat = np.zeros(len(t), dtype=[("n", "<f4", 3), ("v", "<f4", 9), ("a", "<u2")])
            flat["v"] = np.array([[p[k] for p in (a, b, c) for k in "xyz"] for a, b, c in zip(t["p1"], t["p2"], t["p3"], strict=True)], dtype="<f4").reshape(-1, 9)
            v = flat["v"].reshape(-1, 3, 3)
            flat["n"] = np.cross(v[:, 1] - v[:, 0], v[:, 2] - v[:, 0])
            length = np.linalg.norm(flat["n"], axis=1, keepdims=True)
            flat["n"] = np.divide(flat["n"], length, out=np.zeros_like(flat["n"]), where=length > 0)
            raw = flat.tobytes()
            yield pd.DataFrame({"record": [raw[i : i + 50] for i in range(0, len(raw), 50)]})

    return triangles.select("p1", "p2", "p3").mapInPandas(run, "record binary")


def obj_lines(triangles: DataFrame) -> DataFrame:
    """(part, n, value): OBJ text, equal vertices written once: part 0 holds vertices, part 1 faces that name them by number.

    Numbers come from one window over the distinct vertices, so a model for
    one printer, not a city's parcels, is what this is for.
    """
    t = triangles.withColumn("id", F.struct("cell", "face"))
    v = t.select(F.explode(F.array("p1", "p2", "p3")).alias("p")).distinct()
    v = v.withColumn("i", F.row_number().over(Window.orderBy("p")))
    corner = t.select("id", F.posexplode(F.array("p1", "p2", "p3")).alias("k", "p")).join(v, "p")
    faces = corner.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "i"))).alias("c"))
    names = F.array_join(F.transform("c", lambda x: x["i"].cast("string")), " ")
    vertices = v.select(F.lit(0).alias("part"), F.col("i").cast("long").alias("n"), F.concat_ws(" ", F.lit("v"), "p.x", "p.y", "p.z").alias("value"))
    return vertices.unionByName(faces.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy("id")).cast("long").alias("n"), F.concat(F.lit("f "), names).alias("value")))


def carved(boxes: DataFrame, size: int = 200) -> DataFrame:
    """(lot, area, kept): the area left to each rectangle after all larger ones that overlap it (ties: smaller id first).

    A rectangle keeps the places at which it comes first.  Of equal rectangles
    the first one keeps what they have, and in each map cell the others are
    painted over each other, the first one last; so no pair of rectangles is
    made, however many lie on one place.
    """
    box = ("x0", "x1", "y0", "y1")
    sized = boxes.select("lot", *box).withColumn("area", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("long"))
    first = sized.where("x1 > x0 and y1 > y0").groupBy(*box, "area").agg(F.min("lot").alias("lot"))
    row = F.struct((-F.col("area")).alias("area"), "lot", *[F.col(c).cast("double").alias(c) for c in box])
    cell = cells(first, *box, size).groupBy("_ix", "_iy").agg(F.array_sort(F.collect_list(row)).alias("r"))
    schema = T.StructType([sized.schema["lot"], T.StructField("own", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ix, iy, r in zip(b.column("_ix").to_pylist(), b.column("_iy").to_pylist(), b.column("r"), strict=True):
                x0, x1, y0, y1 = (r.values.field(c).to_numpy(zero_copy_only=False) for c in box)
                x, y = (np.clip(v, i * size, (i + 1) * size) for v, i in ((np.stack([x0, x1]), ix), (np.stack([y0, y1]), iy)))
                own = _painted(x, y)
                some = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([r.values.field("lot").take(pa.array(some)), pa.array(own[some])], names=["lot", "own"])

    own = cell.mapInArrow(run, schema).groupBy("lot").agg(F.sum("own").alias("own"))
    covered = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) - F.coalesce("own", F.lit(0.0))
    return sized.join(own, "lot", "left").select("lot", "area", (F.col("area") - covered).cast("long").alias("kept"))


def _painted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The area at which each rectangle (columns of from and to) is the first, some ``PAINT`` places of the grid of borders at a time."""
    xs, ys = np.unique(x), np.unique(y)
    i, j = np.searchsorted(xs, x), np.searchsorted(ys, y)
    own = np.zeros(x.shape[1])
    step = max(1, PAINT // max(len(ys), 1))
    for at in range(0, len(xs) - 1, step):
        wide, high = np.diff(xs[at : at + step + 1]), np.diff(ys)
        top = np.full((len(wide), len(high)), -1, dtype=np.int32)
        a, b = np.clip(i - at, 0, len(wide))
        for k in np.flatnonzero((b > a) & (j[1] > j[0]))[::-1]:
            top[a[k] : b[k], j[0, k] : j[1, k]] = k
        seen = top >= 0
        own += np.bincount(top[seen], weights=np.outer(wide, high)[seen], minlength=len(own))
    return own
