"""Ordered classification rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Land shares that make a parcel underdeveloped, and signs of a parking structure.
SINGLE_FAMILY_SHARE, OTHER_SHARE = 0.67, 0.50
STRUCTURE = "(?i)Garage|Deck|Structure|Ramp"
#: State classes and categories whose parcels without improvements are not vacant land.
EXCLUDED_PREFIXES, EXCLUDED_CLASS, EXCLUDED_CATEGORIES = ("X", "J", "D"), "1D", ("Utility", "Agricultural / Rural")
#: Overlap thresholds and size gates (square feet) of the parking waterfall, and the tags it reads.
STRUCT_OVERLAP, REAL_HIGH, REAL_LOW, REAL_NONE, SIZE_GATE, FUEL_GATE = 0.30, 0.85, 0.40, 0.05, 80_000, 20_000
STRUCTURE_TAGS, STRUCTURE_BUILDINGS = ("multi-storey", "multistorey", "underground", "rooftop"), ("parking", "garage", "garages")


def first_match(rules: Sequence[tuple[Column, Column | str | None]], default: Column | str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def refined(category: Column, land: Column, impr: Column, built: Column, footprint: Column, state_class: Column) -> Column:
    """Vacant, Parking Lot, Underdeveloped or null; a later source rule outranks an earlier one.

    Without an improvement a parcel is vacant only if no building area and no
    footprint is known and its class or category is not excluded; with one, its
    land share decides.  Null values count as 0.
    """
    land, impr, built = (F.coalesce(c, F.lit(0)) for c in (land, impr, built))
    code = F.coalesce(state_class, F.lit(""))
    excluded = F.substring(code, 1, 1).isin(*EXCLUDED_PREFIXES) | (F.substring(code, 1, 2) == EXCLUDED_CLASS) | category.isin(*EXCLUDED_CATEGORIES)
    total = land + impr
    share = F.when(total > 0, land / total)
    cut = F.when(category == "Single Family", SINGLE_FAMILY_SHARE).otherwise(OTHER_SHARE)
    return first_match([
        (category.contains("Vacant"), "Vacant"),
        (category.contains("Parking") & ~category.rlike(STRUCTURE), "Parking Lot"),
        ((impr == 0) & (built == 0) & ~footprint & ~F.coalesce(excluded, F.lit(False)), "Vacant"),
        ((impr != 0) & F.coalesce(share >= cut, F.lit(False)), "Underdeveloped"),
    ])


def waterfall(fuel: Column, tag: Column, building: Column, levels: Column, struct: Column, real: Column, area: Column) -> Column:
    """(parking_type, confidence, source) of a parking polygon; null overlaps count as 0."""

    def made(kind: str, confidence: str | Column, source: str | Column) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(kind).alias("parking_type"), lit(confidence).alias("confidence"), lit(source).alias("source"))

    tag, building = F.lower(F.coalesce(tag, F.lit(""))), F.lower(F.coalesce(building, F.lit("")))
    struct, real, area = (F.coalesce(c, F.lit(0.0)) for c in (struct, real, area))
    plain = tag == "surface"
    return first_match([
        (fuel & (area <= FUEL_GATE), made("excluded", "high", "osm_fuel")),
        (tag.isin(*STRUCTURE_TAGS) | building.isin(*STRUCTURE_BUILDINGS) | F.coalesce(levels >= 2, F.lit(False)), made("structure", "high", "osm_tag")),
        (struct >= STRUCT_OVERLAP, made("structure", "high", "overture_class")),
        (real >= REAL_HIGH, made("structure", "high", "building_overlap")),
        ((real >= REAL_LOW) & (area > SIZE_GATE), made("surface", "medium", "building_overlap")),
        (real >= REAL_LOW, made("uncertain", "low", "building_overlap")),
    ], made("surface", F.when(plain | (real < REAL_NONE), "high").otherwise("medium"), F.when(plain, "osm_tag").otherwise("building_overlap")))


def status(code: Column) -> Column:
    """Error class of an HTTP status; null where there is none."""
    named = {401: "unauthorized", 403: "forbidden", 404: "not_found", 408: "timeout", 429: "rate_limited"}
    return first_match([(code >= 500, "server_error"), *[(code == k, v) for k, v in named.items()], (code >= 400, "client_error")])


def chosen(category: Column, wanted: str) -> Column:
    """Equality with a chosen category; an empty choice lets all pass."""
    return category == wanted if wanted else F.lit(True)


#: What is said of a parcel whose size does not allow a rate.
SIZE_ERRORS = {"land": "⚠ Invalid land size (≤ 0 or missing)", "negative": "⚠ Negative building size", "zero": "ℹ Building size is 0 — shown flat (not an error)"}


def size_error(mode: Column, land: Column, building: Column) -> Column:
    """The message on a rate per land or per building; null where it can be shown, and in other modes."""
    per_land = (mode == "perLand") & ~F.coalesce((land > 0) & (land < float("inf")), F.lit(False))
    built = F.coalesce(building, F.lit(0))  # a missing number counts as 0 here
    per_building = mode == "perBuilding"
    return F.when(per_land, SIZE_ERRORS["land"]).when(per_building & (built < 0), SIZE_ERRORS["negative"]).when(per_building & (built == 0), SIZE_ERRORS["zero"])


def named_defaults(values: DataFrame, by: str, name: str, order: str, defaults: Sequence[str]) -> DataFrame:
    """by, wanted, have, place: the default names that each group has, in the defaults' order, spelt as it is met first."""
    known = F.create_map(*[F.lit(v) for i, d in enumerate(defaults) for v in (d.lower(), i)])
    at = values.withColumn("_i", F.try_element_at(known, F.lower(F.trim(name)))).where("_i is not null")
    first = at.groupBy(by, "_i").agg(F.min_by(F.trim(name), order).alias("have"))
    wanted = F.get(F.array(*[F.lit(d) for d in defaults]), F.col("_i"))
    return first.select(by, wanted.alias("wanted"), "have", F.row_number().over(Window.partitionBy(by).orderBy("_i")).alias("place"))
