"""Values of condominium units brought to the lots that are billed for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.operators.rollup import dominant, share


def to_lots(roll: DataFrame, condo: Sequence[str], block: str, kind: str, values: Sequence[str], area: str, tax: str) -> tuple[DataFrame, DataFrame]:
    """(lots, orphans) of a roll whose ``kind`` is plain, billing or unit.

    A condominium's units go to its billing lots on their own block, by the
    lots' area (alike where that sums to 0).  Units on blocks without one are
    pooled and go to all its billing lots, again by area.  Plain lots stay.  A
    billing lot takes the tax class that holds most of the last of ``values``
    among the units.  Units of a condominium without any billing lot are the
    orphans: condo..., values..., n_units.  So values of lots and orphans add up
    to the roll's.  Keys of billing lots and units are not null.
    """
    keys, places = list(condo), [*condo, block]
    units, billing = roll.where(F.col(kind) == "unit"), roll.where(F.col(kind) == "billing")
    sums = [*[F.sum(v).alias(f"_{v}") for v in values], F.count("*").alias("_n")]
    again = [*[F.sum(f"_{v}").alias(f"_p_{v}") for v in values], F.sum("_n").alias("_p_n")]
    by_block = units.groupBy(*places).agg(*sums)
    own = by_block.join(billing.select(*places), places, "left_semi")
    elsewhere = by_block.join(billing.select(*places), places, "left_anti").groupBy(*keys).agg(*again)
    classes = dominant(units, keys, tax, values[-1]).withColumnRenamed(tax, "_tax").drop("weight")
    b = billing.withColumns({"_own": share(area, places), "_all": share(area, keys)})
    b = b.join(own, places, "left").join(elsewhere, keys, "left").join(classes, keys, "left")
    part = lambda v, p, s: F.coalesce(F.col(f"{p}{v}"), F.lit(0)) * F.col(s)
    added = {v: F.col(v) + part(v, "_", "_own") + part(v, "_p_", "_all") for v in values}
    added |= {"n_units": part("n", "_", "_own") + part("n", "_p_", "_all"), tax: F.coalesce("_tax", tax)}
    plain = roll.where(F.coalesce(F.col(kind) == "plain", F.lit(True))).withColumns({v: F.col(v).cast("double") for v in values} | {"n_units": F.lit(0.0)})
    lots = plain.unionByName(b.withColumns(added).select(*plain.columns))
    lost = by_block.join(billing.select(*keys), keys, "left_anti").groupBy(*keys).agg(*[F.sum(f"_{v}").alias(v) for v in values], F.sum("_n").alias("n_units"))
    return lots, lost
