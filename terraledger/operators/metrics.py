"""Derived value columns: ratios, per-area rates, area selection, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Square feet in an acre.
SQFT_PER_ACRE = 43560


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_existing(df: DataFrame, names: list[str]) -> str | None:
    """The first of ``names`` that is a column of ``df``; None if none is."""
    return next((n for n in names if n in df.columns), None)


def rect_area(x0: str, x1: str, y0: str, y1: str) -> Column:
    return (col(x1) - col(x0)) * (col(y1) - col(y0))


def safe_div(a: str | Column, b: str | Column, default: float | None = None) -> Column:
    """a / b where b is over zero; else ``default``."""
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(default).cast("double"))


def finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in which every one of ``cols`` is a finite number."""
    ok = F.lit(True)
    for c in cols:
        v = col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(ok)


def ratio_fields(df: DataFrame, land: str = "land", impr: str = "impr") -> DataFrame:
    """total, improvement/land, its percentage, improvement share and land share; a column that exists stays."""
    total = col(land) + col(impr)
    new = {
        "total": total,
        "impr_land_ratio": safe_div(impr, land),
        "impr_land_pct": safe_div(col(impr) * 100, land),
        "impr_pct_total": safe_div(col(impr) * 100, total),
        "land_pct_total": safe_div(col(land) * 100, total),
    }
    return df.withColumns({k: v for k, v in new.items() if k not in df.columns})


def per_area(value: str | Column, acres: str | Column, baked: str | Column | None = None) -> Column:
    """Value per square foot of a stated area, else the rate that is stored."""
    rate = F.when(col(acres) * SQFT_PER_ACRE > 0, col(value) / (col(acres) * SQFT_PER_ACRE))
    return rate if baked is None else F.coalesce(rate, col(baked))


def painted(num: str | Column, den: str | Column) -> Column:
    """A ratio as painted: 0 where the denominator is not over zero."""
    return safe_div(num, den, 0.0)


def plausible_area(reported: str, measured: str, lo: float = 0.5, hi: float = 2.0) -> tuple[Column, Column]:
    """(area, its source): the reported one if within lo..hi of the measured one or nothing is measured."""
    r, m = col(reported), col(measured)
    ok = (r > 0) & (m.isNull() | (r / F.nullif(m, F.lit(0))).between(lo, hi))
    ok = F.coalesce(ok, F.lit(False))
    return F.when(ok, r).otherwise(m), F.when(ok, "reported").when(m.isNotNull(), "gis")


def first_positive(*cols: str | Column) -> Column:
    return F.coalesce(*[F.when(col(c) > 0, col(c)) for c in cols])


def staged(stages: list[tuple[str, Column, Column]]) -> Column:
    """(stage, land, total) of the first stage whose total is over zero, as one struct."""
    pick = [F.when(t > 0, F.struct(F.lit(s).alias("stage"), l.alias("land"), t.alias("total"))) for s, l, t in stages]
    return F.coalesce(*pick)


def newest(values: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """First non-null of ordered valuations, and its label."""
    return F.coalesce(*[v for _, v in values]), reduce(lambda acc, x: acc.when(x[1].isNotNull(), x[0]), values[1:], F.when(values[0][1].isNotNull(), values[0][0]))


def residual(total: str | Column, land: str | Column) -> Column:
    """total - land, not under zero; null if either is."""
    d = col(total) - col(land)
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0)))


def market(levels: dict[str, float], cls: str, value: str) -> Column:
    """Assessed value over its class's level of assessment."""
    level = reduce(lambda acc, kv: acc.when(col(cls) == kv[0], kv[1]), levels.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    return col(value) / level


#: Columns that a pricing join adds to parking lots.
PRICES = ("fkey", "rate", "value", "exempt")


def without_prices(lots: DataFrame) -> DataFrame:
    return lots.drop(*PRICES)


def priced(lots: DataFrame, parcels: DataFrame, overlapping) -> DataFrame:
    """lot, fkey, rate, value, exempt: lots at the land rate of the parcel with the largest shared area (ties: smallest key).

    The rate is over the parcel's measured area.  A lot is exempt if any parcel under it is, or if
    parcels cover less than a tenth of it; without a rate its value is 0.
    """
    box = ("x0", "x1", "y0", "y1")
    right = parcels.select("fkey", "land", "area", F.col("exempt").alias("_ex"), *[F.col(c).alias("_" + c) for c in box])
    hit = overlapping(lots.select("lot", *box), right, box, tuple("_" + c for c in box))
    lead = F.max_by(F.struct("fkey", "land", "area"), F.struct("shared", -F.col("fkey"))).alias("p")
    per = hit.groupBy("lot").agg(lead, F.max("_ex").alias("_ex"), F.sum("shared").alias("covered"))
    own = rect_area(*box)
    rate = F.when(F.col("p.area") > 0, F.col("p.land") / F.col("p.area"))
    exempt = F.col("p").isNull() | (F.coalesce("_ex", F.lit(0)) == 1) | (F.col("covered") / own < 0.1)
    return lots.join(per, "lot", "left").select("lot", "p.fkey", F.round(rate, 6).alias("rate"), F.round(F.coalesce(own * rate, F.lit(0.0)), 4).alias("value"), exempt.alias("exempt"))
