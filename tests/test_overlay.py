"""Overlays of polygons against membership of random places and exact areas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraledger.functions import rings as R
from terraledger.operators import overlay, roads
from terraledger.plans import shapes as plans
from terraledger.plans.registry import QUERIES
from tests.test_shapes import as_polygons, holds, polygon_frame, random_polygons

SF = "/root/testdata/sf0.001"


def cases(rng, n):
    """Subjects and for each some others: stars with holes, boxes on a coarse grid (common sides and corners), copies of the subject."""
    subjects, others = [], []
    for k in range(n):
        if k % 2:
            mine = random_polygons(rng, 1)[0][1]
            more = [p for _, p in random_polygons(rng, rng.integers(0, 4))]
        else:
            box = lambda: (lambda x, y, w, h: [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])])(*(rng.integers(0, 5, 2) * 10.0), *(rng.integers(1, 4, 2) * 10.0))
            mine, more = box(), [box() for _ in range(rng.integers(0, 4))]
        subjects.append((k, mine))
        others += [(k, p) for p in more] + ([(k, mine)] if k % 7 == 6 else [])
    return subjects, others


@pytest.mark.parametrize("rule", sorted(overlay.RULES))
def test_overlay_holds_what_the_rule_says(spark, rule):
    rng = np.random.default_rng(21)
    subjects, others = cases(rng, 40)
    got = overlay.overlay(polygon_frame(spark, subjects), polygon_frame(spark, [*others, (777, subjects[0][1])]), "k", rule).collect()
    assert all(r["k"] != 777 for r in got)
    for k, mine in subjects:
        found = as_polygons(r for r in got if r["k"] == k)
        for x, y in rng.uniform(-70, 90, (60, 2)):
            a, b = holds(mine, x, y), any(holds(p, x, y) for i, p in others if i == k)
            assert sum(holds(p, x, y) for p in found) == bool(overlay.RULES[rule](np.array(a), np.array(b)))
        for p in found:
            assert all(len({tuple(v) for v in r}) == len(r) for r in p)


def test_areas_add_up(spark):
    subjects, others = cases(np.random.default_rng(22), 30)
    a, b = polygon_frame(spark, subjects), polygon_frame(spark, others)
    size = lambda rule: overlay.overlay(a, b, "k", rule).groupBy("k").agg(F.sum(R.area(F.col("rings"))).alias("a"))
    got = {rule: {r["k"]: r["a"] for r in size(rule).collect()} for rule in ("difference", "intersection")}
    whole = {r["k"]: r["a"] for r in a.select("k", R.area(F.col("rings")).alias("a")).collect()}
    for k, area in whole.items():
        assert got["difference"].get(k, 0) + got["intersection"].get(k, 0) == pytest.approx(area, abs=1e-3)


def test_half_widths(spark):
    df = spark.createDataFrame([("primary", None), ("primary", "8"), ("track", "x"), (None, "2"), ("service", "1")], "c string, l string")
    assert [r[0] for r in df.select(roads.half_width(F.col("c"), F.col("l"))).collect()] == [11.0, 15.5, 6.0, 6.0, 3.5]


def test_roads_are_gone(spark):
    """Places of parcels: in what is left if and only if no road covers them."""
    rng = np.random.default_rng(23)
    strips = [p[0] for p in as_polygons(plans._sloped(spark, SF).collect())]
    land = {r["fkey"]: as_polygons([r])[0] for r in plans._poly(spark, SF).collect()}
    left = {}
    for r in roads.without_roads(plans._poly(spark, SF), "fkey", plans._sloped(spark, SF)).collect():
        left.setdefault(r["fkey"], []).extend(as_polygons([r]))
    some = 0
    for k, p in land.items():
        near = [s for s in strips if (s.min(0) <= p[0].max(0)).all() and (p[0].min(0) <= s.max(0)).all()]
        for x, y in rng.uniform(p[0].min(0), p[0].max(0), (12, 2)):
            covered = any(holds([s], x, y) for s in near)
            some += covered
            assert any(holds(q, x, y) for q in left.get(k, [])) == (holds(p, x, y) and not covered)
    assert some > 10


def test_queries_of_overlays(spark):
    cut = {r["fkey"]: r["area"] for r in QUERIES["sp_12_sloped_roads"](spark, SF).collect()}
    shared = {r["fkey"]: r["area"] for r in QUERIES["sp_10_zone_shares"](spark, SF).collect()}
    whole = {r["fkey"]: r["a"] for r in plans._poly(spark, SF).select("fkey", R.area(F.col("rings")).alias("a")).collect()}
    assert any(cut[k] < whole[k] for k in cut) and all(v <= whole[k] + 1e-3 for d in (cut, shared) for k, v in d.items()) and shared


def test_sides_far_from_a_subject_stay_away(spark):
    """Shapes found by place give what shapes given by key do; of those that hold a subject, or pass by it, no side moves."""
    rng = np.random.default_rng(24)
    land = random_polygons(rng, 12)
    more = [p for _, p in random_polygons(rng, 12)] + [[np.array([(-500.0, 0), (0, -500), (500, 0), (0, 500)])] for _ in range(2)]
    for others in (more[:12], more):
        keyed = polygon_frame(spark, [(k, p) for k, _ in land for p in others])
        for rule in ("intersection", "difference"):
            size = lambda df: {r["k"]: (r["n"], pytest.approx(r["a"], abs=1e-3)) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum(R.area(F.col("rings"))).alias("a")).collect()}
            got, want = size(overlay.taken(polygon_frame(spark, land), polygon_frame(spark, list(enumerate(others))).select("rings"), "k", rule)), size(overlay.overlay(polygon_frame(spark, land), keyed, "k", rule))
            shared = want if rule == "intersection" else {k: want[k] for k in want if k in shared}  # noqa: F821  what meets no other stays as it is, crossings and all
            assert {k: got[k][0] for k in shared} == {k: v[0] for k, v in shared.items()} and all(shared[k][1] == got[k][1].expected for k in shared)
    box = spark.range(1).selectExpr("0.0D x0", "10.0D x1", "0.0D y0", "10.0D y1", "array(array(struct(-300.0D x, 5.0D y), struct(5.0D x, -300.0D y), struct(300.0D x, 5.0D y), struct(5.0D x, 300.0D y))) r")
    near = box.select(overlay._within(overlay._lines(F.col("r"), 1e-6), ("x0", "x1", "y0", "y1"), 1e-6).alias("l"))
    assert near.select(F.exists("l", lambda s: s["cut"])).first()[0] is False


def test_land_beside_a_road_stays_as_it_is(spark):
    """A road whose extent reaches a parcel, but which runs past it, changes nothing, not even the order of corners; one that covers it leaves nothing."""
    corner = [(90.0, 10.0), (99.0, 1.0), (99.0, 10.0)]
    land = polygon_frame(spark, [(1, [corner]), (2, [[(300.0, 0.0), (310.0, 0.0), (310.0, 10.0)]])])
    road = spark.range(1).select(roads.strip(*[F.lit(v) for v in (0.0, 0.0, 100.0, 100.0)], F.lit(3.0)).alias("rings")).unionByName(spark.range(1).select(roads.strip(*[F.lit(v) for v in (250.0, 5.0, 350.0, 5.0)], F.lit(20.0)).alias("rings")))
    left = roads.without_roads(land, "k", road).collect()
    assert [(r["k"], [(p["x"], p["y"]) for p in r["rings"][0]]) for r in left] == [(1, corner)]
