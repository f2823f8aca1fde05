"""Connected components over an edge table, with no edge list on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.llm.scratch import discard, materialize


def _down(e: DataFrame, a: str, b: str) -> DataFrame:
    return e.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).where("big <> small")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; root is the component's least node.

    Alternating large-star and small-star contraction (Kiveris et al., 2014):
    each round joins every node's neighbours to the least of them.  Rounds
    grow with the logarithm of the longest chain; each is written to the
    shared folder, and both stars are aggregate-then-join, so a hub's
    neighbours never meet in one task's memory.
    """
    spark = edges.sparkSession
    e, path = materialize(_down(edges, "u", "v").distinct())
    mark = _mark(e)
    for _ in range(most):
        if not mark[0]:
            break
        both = e.select(F.col("big").alias("u"), F.col("small").alias("v")).unionAll(e.select(F.col("small").alias("u"), F.col("big").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("big"), F.col("m").alias("small")).where("big <> small").distinct()
        low = large.groupBy("big").agg(F.min("small").alias("m"))
        small = large.join(low, "big")
        nxt = _down(small.select(F.col("small").alias("x"), "m").unionAll(small.select(F.col("big").alias("x"), "m")), "x", "m").distinct()
        e, new_path = materialize(nxt)
        discard(spark, path)
        path, was, mark = new_path, mark, _mark(e)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("big").alias("node"), F.col("small").alias("root"))


def _mark(e: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")), F.sum(F.crc32(F.concat(F.col("big").cast("binary"), F.col("small").cast("binary"))))).first())
