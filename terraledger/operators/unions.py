"""Exact unions of rectangles by key, as disjoint slabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dissolved(rects: DataFrame, key: Sequence[str], x0: str = "x0", x1: str = "x1", y0: str = "y0", y1: str = "y1") -> DataFrame:
    """key..., sx0, sx1, sy0, sy1: disjoint rectangles that cover the union of a key's rectangles.

    The key's x-borders are numbered, a rectangle lies in the slabs between the
    numbers of its two; in a slab, y-intervals that meet become one.  Rows meet
    by equality alone, so work is the number of (rectangle, slab) pairs that
    belong together, spread by (key, slab).
    """
    key = list(key)
    r = rects.select(*key, *[F.col(c).cast("double").alias(n) for c, n in zip((x0, x1, y0, y1), ("_x0", "_x1", "_y0", "_y1"), strict=True)]).where("_x1 > _x0 and _y1 > _y0")
    borders = r.select(*key, F.explode(F.array("_x0", "_x1")).alias("_b")).distinct()
    order = Window.partitionBy(*key).orderBy("_b")
    slabs = borders.select(*key, "_b", F.row_number().over(order).alias("_i"), F.lead("_b").over(order).alias("_e"))
    ends = lambda side, name: slabs.select(*key, F.col("_b").alias(side), F.col("_i").alias(name))
    inside = r.join(ends("_x0", "_from"), [*key, "_x0"]).join(ends("_x1", "_to"), [*key, "_x1"]).withColumn("_i", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
    cut = inside.join(slabs.where("_e is not null"), [*key, "_i"])
    w = Window.partitionBy(*key, "_b").orderBy("_y0", "_y1")
    before = F.max("_y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = cut.withColumn("_new", F.coalesce(F.col("_y0") > before, F.lit(True)).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, F.col("_b").alias("sx0"), F.col("_e").alias("sx1"), "_run").agg(F.min("_y0").alias("sy0"), F.max("_y1").alias("sy1")).drop("_run")


def union_area(rects: DataFrame, key: Sequence[str], **names: str) -> DataFrame:
    """key..., covered: area of the union of each key's rectangles."""
    return dissolved(rects, key, **names).groupBy(*key).agg(F.sum((F.col("sx1") - F.col("sx0")) * (F.col("sy1") - F.col("sy0"))).alias("covered"))
