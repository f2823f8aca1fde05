"""Percentiles, breaks, robust caps and legend scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraledger.operators.ranks import percentiles

#: Scale of the median absolute deviation; stops of a nine-colour ramp.
MAD_SCALE = 1.4826
RAMP = (8, 20, 35, 50, 65, 80, 93, 99.5)


#: Height units in metres, the tallest bar, and the multipliers that a slider shows.
UNITS = (("centimeters", 0.01), ("meters", 1.0), ("kilometers", 1000.0))
CAP_METERS, RANGE_MIN, RANGE_MAX = 1000, 1, 100


def unit_score(m: Column) -> Column:
    """How badly a multiplier suits: inside the range by its distance from 10, outside by that from the range."""
    outside = F.least(F.abs(m - RANGE_MIN), F.abs(m - RANGE_MAX))
    return F.when(m.between(RANGE_MIN, RANGE_MAX), F.abs(F.log10(F.greatest(m, F.lit(1e-12))) - 1)).otherwise(outside * 1e3 + 1e6)


def break_stops(k: int, lo: float = 0, hi: float = 100) -> list[float]:
    """Percentiles of the inner breaks of k classes, 2 to 12."""
    k = max(2, min(12, k))
    return [lo + (hi - lo) * i / k for i in range(1, k)]


def rising(p: Column) -> Column:
    """Breaks in order, each once."""
    return F.array_sort(F.array_distinct(p))


def step_bin(value: Column, cuts: Column) -> Column:
    """Number of breaks at or below a value; a value on a break goes up."""
    return F.size(F.filter(cuts, lambda b: value >= b))


def mad_cap(df: DataFrame, value: str, z: float) -> DataFrame:
    """One row: the largest value whose log lies within z (2 to 15) robust deviations of the median, and how many lie beyond.

    Values under 0 count as 0 in the log; where the deviation is 0 the cap is null and nothing is an outlier.
    """
    z = min(15.0, max(2.0, z))
    v = df.where(F.col(value).isNotNull()).select(F.log1p(F.greatest(F.col(value).cast("double"), F.lit(0.0))).alias("l"), F.col(value).alias("v"))
    mid = percentiles(v, ["l"], [50]).select(F.col("p")[0].alias("mid"))
    dev = v.crossJoin(F.broadcast(mid)).withColumn("d", F.abs(F.col("l") - F.col("mid")))  # one row
    scale = percentiles(dev, ["d"], [50]).select((F.col("p")[0] * MAD_SCALE).alias("scale"))
    flat, inside = ~(F.col("scale") > 0), F.col("d") <= F.col("scale") * z
    return dev.crossJoin(F.broadcast(scale)).agg(F.max(F.when(~flat & inside, F.col("v"))).alias("cap"), F.sum(F.when(flat | inside, 0).otherwise(1)).alias("outliers"))


def nearest_rank(value: str, p: float) -> Column:
    """Aggregate over small groups: the element at floor(p * n) of the sorted values."""
    xs = F.sort_array(F.collect_list(value))
    return F.element_at(xs, F.least(F.floor(F.count(value) * p).cast("int") + 1, F.count(value).cast("int")))


def ramp(v: Column, stops: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear interpolation between (value, output) stops, clamped at both ends."""
    out = F.when(v <= stops[0][0], F.lit(float(stops[0][1])))
    for (a, p), (b, q) in zip(stops, stops[1:], strict=False):
        out = out.when(v <= b, p + (v - a) * (q - p) / (b - a))
    return out.otherwise(F.lit(float(stops[-1][1])))


def inverted_rank(value: Column, breaks: Column, bins: int) -> Column:
    """1 for values below all breaks, falling in equal steps to 0 for those at or above ``bins`` - 1 of them."""
    below = F.size(F.filter(breaks, lambda b: b <= value))
    return (F.lit(bins - 1) - below) / F.lit(bins - 1)
