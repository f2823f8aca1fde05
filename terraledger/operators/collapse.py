"""Accounts collapsed, pass after pass, to the parcels of ground that they stand on.

Rows have id, kind, family (name shared by a development's accounts), tokens
(its words), support (whether an association or vacant land), land, impr,
area, units and the extent x0, x1, y0, y1.  Every pass finds groups, replaces
their rows by one with summed values, and leaves all others alone, so land,
impr and units add up to the same before and after each.

A group has a head.  Where several heads claim a row, heads choose in a total
order (``assign.greedy``); groups of equals are connected components.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraledger.operators.assign import greedy
from terraledger.operators.components import connected
from terraledger.operators.lineage import saved
from terraledger.operators.spatial import containing, overlapping

COLUMNS = ("id", "kind", "family", "tokens", "support", "land", "impr", "area", "units", "x0", "x1", "y0", "y1")
BOX = ("x0", "x1", "y0", "y1")
#: Kinds of rows that units were merged into.
MERGED = ("ground", "campus", "complex")


@dataclass(frozen=True)
class Rules:
    """Areas in square feet, distances in the map's units."""

    reach: float = 1.0  # how near extents must come to touch
    ground_ratio: float = 1.5  # a ground parcel's area over a unit's
    complex_ratio: float = 3.0  # a complex's area over a child's
    child: float = 15_000
    parent: float = 20_000
    complex_units: int = 6
    complex_children: int = 3
    rest: float = 12_000
    support: float = 80_000
    anchor_units: int = 4


def _near(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Pairs of rows whose extents come within ``reach``: columns a_..., b_...."""
    wide = {"x0": -reach, "x1": reach, "y0": -reach, "y1": reach}
    left = a.select(*[(F.col(c) + wide.get(c, 0) if c in wide else F.col(c)).alias(f"a_{c}") for c in COLUMNS])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in COLUMNS])
    return overlapping(left, right, tuple(f"a_{c}" for c in BOX), tuple(f"b_{c}" for c in BOX), touch=True).where("a_id <> b_id")


def merge(rows: DataFrame, groups: DataFrame, kind: str, own_area: bool) -> DataFrame:
    """``rows`` with those of each group, (member, head), as one row of ``kind`` under the head's id.

    Name and words are the head's, or, where it has none or is no row, those of
    the member with most units (ties: least id).  With ``own_area`` the area is
    the head's, else the sum.
    """
    j = rows.join(groups.select("member", "head"), rows["id"] == F.col("member"), "left")
    first = F.col("id") == F.col("head")
    order = F.struct(first, F.col("units"), -F.col("id"))
    named = lambda c, has: F.max_by(c, F.when(has, order)).alias(c)
    area = F.coalesce(F.max(F.when(first, F.col("area"))), F.sum("area")) if own_area else F.sum("area")
    one = j.where("head is not null").groupBy(F.col("head").alias("id")).agg(
        F.lit(kind).alias("kind"), named("family", F.col("family").isNotNull()), named("tokens", F.size("tokens") > 0), F.lit(False).alias("support"), F.sum("land").alias("land"), F.sum("impr").alias("impr"),
        area.alias("area"), F.sum("units").alias("units"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    one = one.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    return saved(j.where("head is null").select(*COLUMNS).unionByName(one.select(*COLUMNS)))


def _claimed(rows: DataFrame, pairs: DataFrame, enough: Column, kind: str) -> DataFrame:
    """Children (b_) of heads (a_): heads with most units around them choose first, then the largest, then the least id."""
    w = pairs.groupBy(F.col("a_id").alias("cand")).agg(F.sum("b_units").alias("w"), F.first("a_area").alias("area"))
    candidates = w.select("cand", F.struct((-F.col("w")).alias("w"), (-F.col("area")).alias("area"), F.col("cand").alias("id")).alias("rank"))
    taken = greedy(candidates, pairs.select(F.col("a_id").alias("cand"), F.col("b_id").alias("member"), F.col("b_units").alias("weight")), enough=enough)
    heads = taken.select(F.col("cand").alias("member"), F.col("cand").alias("head")).distinct()
    return merge(rows, taken.select("member", F.col("cand").alias("head")).unionByName(heads), kind, True)


def _clusters(rows: DataFrame, some: DataFrame, reach: float, kind: str) -> DataFrame:
    """Rows of one family that come near each other, directly or through others."""
    edges = _near(some, some, reach).where("a_family = b_family").select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    return merge(rows, connected(edges).select(F.col("node").alias("member"), F.col("root").alias("head")), kind, False)


def platted(rows: DataFrame, lots: DataFrame) -> DataFrame:
    """Several parcels whose middle lies on one lot of a plat (lot, x0..y1; of several the least): the lot, under the id -1 - lot, with its area."""
    mid = rows.select("id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    on = containing(mid, lots.select("lot", *[F.col(c).alias(f"l_{c}") for c in BOX]), "x", "y", tuple(f"l_{c}" for c in BOX)).groupBy("id").agg(F.min("lot").alias("lot"))
    several = on.groupBy("lot").agg(F.count("*").alias("n")).where("n > 1").select("lot")
    groups = on.join(several, "lot").select(F.col("id").alias("member"), (-1 - F.col("lot")).alias("head"))
    sized = lots.select((-1 - F.col("lot")).alias("id"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double").alias("lot_area"))
    out = merge(rows, groups, "platted", False).join(sized, "id", "left")
    return out.withColumn("area", F.when(F.col("kind") == "platted", F.coalesce("lot_area", "area")).otherwise(F.col("area"))).select(*COLUMNS)


def on_ground(rows: DataFrame, rules: Rules) -> DataFrame:
    """Units of one family on a parcel of ground that is larger by a ratio: the ground takes two at least of them, of the family with most units."""
    pairs = _near(rows.where("kind = 'parcel'"), rows.where("kind = 'condo' and family is not null"), rules.reach).where(F.col("a_area") >= F.greatest("b_area", F.lit(1.0)) * rules.ground_ratio)
    families = pairs.groupBy("a_id", "b_family").agg(F.sum("b_units").alias("w"))
    best = families.groupBy("a_id").agg(F.min_by("b_family", F.struct(-F.col("w"), F.col("b_family"))).alias("b_family"))
    return _claimed(rows, pairs.join(best, ["a_id", "b_family"]), F.col("w") >= 2, "ground")


def campuses(rows: DataFrame, rules: Rules) -> DataFrame:
    """Ground parcels of one family next to each other."""
    return _clusters(rows, rows.where("kind = 'ground' and family is not null"), rules.reach, "campus")


def _shares_words() -> Column:
    return F.arrays_overlap("a_tokens", "b_tokens")


def complexes(rows: DataFrame, rules: Rules) -> DataFrame:
    """Several small units, or merged parcels, on a large parcel with a word of their name."""
    child = (F.size("tokens") > 0) & F.col("kind").isin("condo", "platted") & F.col("area").between(1, rules.child)
    parents = rows.where(~child & (F.size("tokens") > 0) & (F.col("area") >= rules.parent))
    pairs = _near(parents, rows.where(child), rules.reach).where(_shares_words() & (F.col("a_area") >= F.col("b_area") * rules.complex_ratio))
    return _claimed(rows, pairs, (F.col("w") >= rules.complex_units) & (F.col("n") >= rules.complex_children), "complex")


def remaining(rows: DataFrame, rules: Rules) -> DataFrame:
    """Small units, or merged parcels, left beside a complex with a word of their name."""
    child = (F.size("tokens") > 0) & F.col("kind").isin("condo", "platted") & F.col("area").between(1, rules.rest)
    pairs = _near(rows.where("kind = 'complex'"), rows.where(child), rules.reach).where(_shares_words())
    return _claimed(rows, pairs, F.col("n") >= 1, "complex")


def _anchor(rules: Rules) -> Column:
    return (F.size("tokens") > 0) & (F.col("kind").isin(*MERGED) | ((F.col("kind") == "condo") & (F.col("units") >= rules.anchor_units)))


def supports(rows: DataFrame, rules: Rules) -> DataFrame:
    """Common and vacant ground beside an anchor with a word of its name."""
    support = (F.size("tokens") > 0) & ~_anchor(rules) & (F.col("support") | F.col("kind").isin("platted", "condo")) & F.col("area").between(1, rules.support)
    pairs = _near(rows.where(_anchor(rules)), rows.where(support), rules.reach).where(_shares_words())
    return _claimed(rows, pairs, F.col("n") >= 1, "complex")


def clusters(rows: DataFrame, rules: Rules) -> DataFrame:
    """Anchors of exactly one family next to each other."""
    return _clusters(rows, rows.where(_anchor(rules) & F.col("family").isNotNull()), rules.reach, "campus")


def passes(rows: DataFrame, lots: DataFrame, rules: Rules) -> list[tuple[str, DataFrame]]:
    """(name, rows after it) of the seven passes in their order."""
    out = [("platted", platted(rows.select(*COLUMNS), lots))]
    for f in (on_ground, campuses, complexes, remaining, supports, clusters):
        out.append((f.__name__, f(out[-1][1], rules)))
    return out
