"""Exact ranks and percentiles of long columns, without a group's values in one task.

Values are counted, and the distinct ones range-partitioned; a partition's
place in the order comes from one sum a partition and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraledger.operators.lineage import saved


def distribution(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by..., field, value, n, before: the distinct non-null values of each column and group, and how many rows are smaller."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias("value")) for v in values]))
    keys = [*by, "field"]
    counts = df.select(*by, pairs.alias("p")).select(*by, "p.field", "p.value").where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    placed = saved(counts.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "part").agg(F.sum("n").alias("s"))  # a row a partition and group
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "part"]]
    return ranked.alias("r").join(offsets.alias("o"), on).select(*[f"r.{k}" for k in keys], "r.value", "r.n", (F.col("within") + F.col("base")).alias("before"))


#: Groups with a larger part of all rows than this are known where the rows are; there are fewer than its inverse.
LARGE_PART = 1 / 1024


def _beside(rows: DataFrame, known: DataFrame, on: list) -> DataFrame:
    """Rows with their group's row of ``known``, which tells the group's ``_rows``: those of large groups are not moved, so no task gets one whole."""
    bound = known.agg((F.sum("_rows") * LARGE_PART).alias("_bound"))
    split = known.crossJoin(F.broadcast(bound))  # one row
    large, small = (split.where(F.col("_rows") > F.col("_bound")), split.where(F.col("_rows") <= F.col("_bound")))
    return rows.join(F.broadcast(large), on).unionByName(rows.join(F.broadcast(large), on, "left_anti").join(small, on))


#: Accuracy of the sketch that brackets a percentile, and how far the bracket reaches in parts of all values.
ACCURACY = 50_000
SLACK = 4 / ACCURACY


def percentiles(df: DataFrame, values: Sequence[str], ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., field, p, n: exact percentiles (0 to 100) with linear interpolation, as an array, and the number of values.

    Two aggregations: a mergeable sketch brackets each percentile of a group
    of over 2 * ``ACCURACY`` values, then values below the bracket are counted and
    those inside it, a few in ten thousand, are put in order.  Smaller groups
    are put in order whole.  Groups without a value give no row.
    """
    by, stops = list(by), [p / 100 for p in ps]
    edges = F.array(*[F.lit(min(1.0, max(0.0, q + side))) for q in stops for side in (-SLACK, SLACK)])
    marks = [F.struct(F.percentile_approx(F.col(v).cast("double"), edges, F.lit(ACCURACY)).alias("m"), F.count(v).alias("n")).alias(f"_m{i}") for i, v in enumerate(values)]
    narrow = df.select(*by, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    if by:
        known = df.groupBy(*by).agg(*marks, F.count("*").alias("_rows")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(by)})
        met = _beside(narrow, known, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)])
    else:
        met = narrow.crossJoin(F.broadcast(df.agg(*marks)))  # one row
    rows = []
    for i, v in enumerate(values):
        x, n = F.col(f"_v{i}"), F.col(f"_m{i}.n")
        few = n <= 2 * ACCURACY
        row = lambda j, low, i=i, v=v, x=x, n=n: F.struct(F.lit(v).alias("field"), F.lit(j).alias("j"), n.alias("total"), low.alias("low"), F.when(~low, x).alias("value"))
        rows.append(F.when(few & x.isNotNull(), row(-1, F.lit(False))))
        for j, q in enumerate(stops):
            low = x < F.get(f"_m{i}.m", F.lit(2 * j)) if q - SLACK > 0 else F.lit(False)
            high = x > F.get(f"_m{i}.m", F.lit(2 * j + 1)) if q + SLACK < 1 else F.lit(False)
            rows.append(F.when(~few & x.isNotNull() & ~high, row(j, low)))
    keys = [*by, "field", "j", "total"]
    counts = met.select(*by, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(*by, "r.*").groupBy(*keys, "low", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("low"), "value").rowsBetween(Window.unboundedPreceding, 0))
    every = F.array(*[F.lit(j) for j in range(len(stops))])
    spots = counts.withColumn("upto", upto).where("not low").withColumn("j", F.explode(F.when(F.col("j") < 0, every).otherwise(F.array("j"))))
    at = F.get(F.array(*[F.lit(q) for q in stops]), F.col("j")) * (F.col("total") - 1)
    holds = lambda spot: (spot < F.col("upto")) & (spot >= F.col("upto") - F.col("n"))
    hit = spots.withColumn("at", at).where(holds(F.floor("at")) | holds(F.ceil("at")))
    one = hit.groupBy(*keys, "at").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    lists = one.select(*by, "field", "total", "j", value.alias("x")).groupBy(*by, "field", "total").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("xs"))
    return lists.select(*by, "field", F.transform("xs", lambda x: x["x"]).alias("p"), F.col("total").alias("n"))


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``place``, counted from 1 in each group of ``by`` in a total order, where groups are too large for a window."""
    keys = list(by)
    placed = saved(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_s"))  # a row a partition and group
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return placed.withColumn("_row", F.row_number().over(inside)).join(offsets, [*keys, "_part"]).withColumn("place", F.col("_row") + F.col("_base")).drop("_part", "_row", "_base")
