"""Geometry on rings, overlays, parking pricing and the families that collapse units to parcels."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraledger.functions import rings, scalar
from terraledger.operators import assign, components, hexgrid, mesh, metrics, spatial, unions
from terraledger.plans import fixtures as fx
from terraledger.plans.joins import _OTHER, _pairs
from terraledger.plans.registry import query
from terraledger.sources import files

GEO, BLD, LOT = ("x0", "x1", "y0", "y1"), ("bx0", "bx1", "by0", "by1"), ("lx0", "lx1", "ly0", "ly1")
_HIT = "x0 < bx1 and bx0 < x1 and y0 < by1 and by0 < y1"

# ------------------------------------------------------------------ rings

#: L-shaped footprints, every third with a square hole, every sixth with a small triangular one too; odd keys run clockwise, rings are closed.
_POLY = """poly as (select fkey, list_concat([case when fkey % 2 = 1 then list_reverse(e) else e end], case when fkey % 3 = 0 then [[{'x': x0 + 2.0, 'y': y0 + 2.0}, {'x': x0 + 6.0, 'y': y0 + 2.0}, {'x': x0 + 6.0, 'y': y0 + 6.0}, {'x': x0 + 2.0, 'y': y0 + 6.0}, {'x': x0 + 2.0, 'y': y0 + 2.0}]] else [] end,
  case when fkey % 6 = 0 then [[{'x': x0 + 7.0, 'y': y0 + 1.0}, {'x': x0 + 9.0, 'y': y0 + 1.0}, {'x': x0 + 7.0, 'y': y0 + 3.0}, {'x': x0 + 7.0, 'y': y0 + 1.0}]] else [] end) as rings from
  (select fkey, cast(x0 as double) as x0, cast(y0 as double) as y0, [{'x': x0 + 0.0, 'y': y0 + 0.0}, {'x': x1 + 0.0, 'y': y0 + 0.0}, {'x': x1 + 0.0, 'y': y0 + 10.0}, {'x': x0 + 10.0, 'y': y0 + 10.0}, {'x': x0 + 10.0, 'y': y1 + 0.0}, {'x': x0 + 0.0, 'y': y1 + 0.0}, {'x': x0 + 0.0, 'y': y0 + 0.0}] as e from geo)),
 edge as (select fkey, r, ring[i] as a, ring[i + 1] as b from (select fkey, r, ring, unnest(range(1, len(ring))) as i from (select fkey, unnest(rings) as ring, generate_subscripts(rings, 1) as r from poly))),
 ringa as (select fkey, r, sum(a.x * b.y - b.x * a.y) / 2 as s, sum((a.x + b.x) * (a.x * b.y - b.x * a.y)) / 6 as mx, sum((a.y + b.y) * (a.x * b.y - b.x * a.y)) / 6 as my, avg(a.x) as vx, avg(a.y) as vy from edge group by 1, 2)"""


def _poly(spark, sf):
    at = lambda x, dx, y, dy: F.struct((F.col(x) + float(dx)).alias("x"), (F.col(y) + float(dy)).alias("y"))
    e = F.array(at("x0", 0, "y0", 0), at("x1", 0, "y0", 0), at("x1", 0, "y0", 10), at("x0", 10, "y0", 10), at("x0", 10, "y1", 0), at("x0", 0, "y1", 0), at("x0", 0, "y0", 0))
    inner = lambda pts: F.array(*[at("x0", x, "y0", y) for x, y in pts])
    k = F.col("fkey")
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    holes = F.concat(F.when(k % 3 == 0, F.array(inner([(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]))).otherwise(none), F.when(k % 6 == 0, F.array(inner([(7, 1), (9, 1), (7, 3), (7, 1)]))).otherwise(none))
    return fx.geo(spark, sf).select("fkey", F.concat(F.array(F.when(k % 2 == 1, F.reverse(e)).otherwise(e)), holes).alias("rings"))


@query("sp_02_planar_area", fx.sql("select fkey, max(case when r = 1 then abs(s) end) - coalesce(sum(case when r > 1 then abs(s) end), 0) as area from ringa group by fkey", "geo", more=_POLY))
def sp_02(spark, sf):
    """Area of polygons with holes."""
    return _poly(spark, sf).select("fkey", rings.area(F.col("rings")).alias("area"))


@query("sp_05_centroid", fx.sql("select fkey, round(cx, 6) as cx, round(cy, 6) as cy from (select fkey, sum(case when r = 1 then 1 else -1 end * sign(s) * mx) / sum(case when r = 1 then 1 else -1 end * abs(s)) as cx, sum(case when r = 1 then 1 else -1 end * sign(s) * my) / sum(case when r = 1 then 1 else -1 end * abs(s)) as cy from ringa group by fkey)", "geo", more=_POLY))
def sp_05(spark, sf):
    """Centres of mass, holes subtracted."""
    c = _poly(spark, sf).select("fkey", rings.centroid(F.col("rings")).alias("c"))
    return c.select("fkey", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query("sp_06_vertex_mean", fx.sql("select fkey, round(vx, 6) as vx, round(vy, 6) as vy from ringa where r = 1", "geo", more=_POLY))
def sp_06(spark, sf):
    c = _poly(spark, sf).select("fkey", rings.vertex_mean(F.element_at("rings", 1)).alias("c"))
    return c.select("fkey", F.round("c.x", 6).alias("vx"), F.round("c.y", 6).alias("vy"))


@query("sp_07_repair", fx.sql("select fkey, len(rings) as n, max(case when r = 1 then abs(s) end) - coalesce(sum(case when r > 1 then abs(s) end), 0) as area from ringa join poly using (fkey) group by fkey, rings", "geo", more=_POLY))
def sp_07(spark, sf):
    """Polygons spoilt with repeated vertices and rings without area, repaired."""
    double = lambda r: F.flatten(F.transform(r, lambda p: F.array(p, p)))
    flat = F.array(F.transform(F.slice(F.element_at("rings", 1), 1, 2), lambda p: p))
    spoilt = F.concat(F.transform("rings", double), flat)
    fixed = _poly(spark, sf).select("fkey", rings.repaired(spoilt).alias("rings"))
    return fixed.select("fkey", F.size("rings").cast("long").alias("n"), rings.area(F.col("rings")).alias("area"))


@query("sp_15_fill_holes", fx.sql("select fkey, count(*) filter (where r > 1 and abs(s) >= 10) as holes, max(case when r = 1 then abs(s) end) - coalesce(sum(case when r > 1 and abs(s) >= 10 then abs(s) end), 0) as area, max(case when r = 1 then abs(s) end) as solid from ringa group by fkey", "geo", more=_POLY))
def sp_15(spark, sf):
    """Small holes filled, and all."""
    some = rings.filled(F.col("rings"), under=10)
    return _poly(spark, sf).select("fkey", (F.size(some) - 1).cast("long").alias("holes"), rings.area(some).alias("area"), rings.area(rings.filled(F.col("rings"))).alias("solid"))


@query("sp_16_hole_count", fx.sql("select len(rings) - 1 as holes, count(*) as k from poly group by 1", "geo", more=_POLY))
def sp_16(spark, sf):
    return _poly(spark, sf).groupBy((F.size("rings") - 1).cast("long").alias("holes")).agg(F.count("*").alias("k"))


@query("sp_17_winding", fx.sql("select fkey, r - 1 as i, case when r = 1 then abs(s) else -abs(s) end as signed from ringa", "geo", more=_POLY))
def sp_17(spark, sf):
    """Exterior counter-clockwise, holes clockwise: signed areas of every ring."""
    w = _poly(spark, sf).select("fkey", F.posexplode(rings.wound(F.col("rings"))).alias("i", "ring"))
    return w.select("fkey", F.col("i").cast("long").alias("i"), rings.signed_area(F.col("ring")).alias("signed"))


@query("sp_18_rounding", fx.sql("select fkey, floor((a.x / 7 - 40) * 1000000 + 0.5) / 1000000 as lon, floor(a.y / 7 * 1000000 + 0.5) / 1000000 as lat from edge where r = 1", "geo", more=_POLY))
def sp_18(spark, sf):
    """Coordinates on six decimals, halves up."""
    scaled = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] / 7 - 40).alias("x"), (p["y"] / 7).alias("y"))))
    r = _poly(spark, sf).select("fkey", F.explode(rings.opened(F.element_at(rings.rounded(scaled), 1))).alias("p"))
    return r.select("fkey", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


@query("sp_20_shape_key", fx.sql("select n, count(*) as shapes from (select count(*) as n from (select fkey % 60 as f, x1 - x0 as w, y1 - y0 as h from geo) group by case when f % 6 = 0 then 2 when f % 3 = 0 then 1 else 0 end, w, h) group by n", "geo"))
def sp_20(spark, sf):
    """Equal shapes found by key: moved to one corner, begun at another vertex and run the other way they stay one."""
    p = _poly(spark, sf)
    least = F.array_min(F.element_at("rings", 1))
    moved = F.transform("rings", lambda r: F.transform(r, lambda v: F.struct((v["x"] - F.col("o")["x"]).alias("x"), (v["y"] - F.col("o")["y"]).alias("y"))))
    turned = F.transform(F.col("m"), lambda r: F.when(F.col("fkey") % 4 < 2, F.reverse(rings.opened(r))).otherwise(r))
    keys = p.withColumn("o", least).withColumn("m", moved).select(rings.shape_key(turned).alias("k"))
    return keys.groupBy("k").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("shapes"))


@query("sp_27_resolution", "select p_partkey, case when a <= 0 then 9 else list_position(errs, list_min(errs)) - 1 end as res from (select p_partkey, a, list_transform([4357449416078.383, 609788441794.133, 86801780398.997, 12393434655.088, 1770347654.491, 252903858.182, 36129062.164, 5161293.360, 737327.598, 105332.513, 15047.502, 2149.643, 307.092, 43.870, 6.267, 0.895], lambda h: abs(h - a)) as errs from (select p_partkey, case when p_partkey % 17 = 0 then 0.0 else p_size * pow(7.0, p_partkey % 9) end as a from part))")
def sp_27(spark, sf):
    a = F.when(F.col("p_partkey") % 17 == 0, 0.0).otherwise(F.col("p_size") * F.pow(F.lit(7.0), F.col("p_partkey") % 9))
    return fx.table(spark, sf, "part").select("p_partkey", rings.resolution(a).cast("long").alias("res"))


@query("jn_21_hole_containment", fx.sql("""select bid, p.fkey from (select bid, fkey from (select bid, bx0 + 1.5 as px, by0 + 1.5 as py from bld) b join edge e on (e.a.y > py) <> (e.b.y > py) and px < (e.b.x - e.a.x) * (py - e.a.y) / (e.b.y - e.a.y) + e.a.x group by bid, fkey having count(*) % 2 = 1) p""", "geo", "bld", more=_POLY))
def jn_21(spark, sf):
    """Points in polygons, those in holes left out: cells first, then the even-odd rule on all rings."""
    p = fx.bld(spark, sf).select("bid", (F.col("bx0") + 1.5).alias("px"), (F.col("by0") + 1.5).alias("py"))
    poly = _poly(spark, sf).join(fx.geo(spark, sf).select("fkey", *GEO), "fkey")
    return spatial.containing(p, poly, "px", "py", GEO).where(rings.holds(F.col("rings"), F.col("px"), F.col("py"))).select("bid", "fkey")


# ------------------------------------------------------------------ overlays

_GRID = "select {key}, sum((e - b) * len) as covered, count(*) as slabs from (select {key}, b, e, sum(hi - lo) as len from (select {key}, b, e, run, min(y0) as lo, max(y1) as hi from (select *, sum(new) over (partition by {key}, b order by y0, y1 rows unbounded preceding) as run from (select *, case when y0 > max(y1) over (partition by {key}, b order by y0, y1 rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from (select r.{key}, b, e, y0, y1 from {src} r join (select {key}, b, lead(b) over (partition by {key} order by b) as e from (select {key}, x0 as b from {src} union select {key}, x1 from {src})) s on r.{key} = s.{key} and x0 <= b and e <= x1))) group by {key}, b, e, run) group by {key}, b, e) group by {key}"


@query("sp_08_dissolve", fx.sql("select o_custkey, covered from (" + _GRID.format(key="o_custkey", src="wide") + ")", "geo", more="wide as (select o_custkey, x0 % 400 as x0, x0 % 400 + (x1 - x0) * 3 as x1, y0 % 160 as y0, y0 % 160 + (y1 - y0) * 3 as y1 from geo)"))
def sp_08(spark, sf):
    """One shape an owner: the area of the union of overlapping footprints."""
    wide = fx.geo(spark, sf).select("o_custkey", (F.col("x0") % 400).alias("x0"), (F.col("x0") % 400 + (F.col("x1") - F.col("x0")) * 3).alias("x1"), (F.col("y0") % 160).alias("y0"), (F.col("y0") % 160 + (F.col("y1") - F.col("y0")) * 3).alias("y1"))
    return unions.union_area(wide, ["o_custkey"])


_ROAD = """road as (select s_suppkey as road, (s_suppkey * 61 % 250) * 40 as rx0, (s_suppkey * 61 % 250) * 40 + 400 as rx1, mid - half as ry0, mid + half as ry1 from (select s_suppkey, (s_suppkey % 60) * 40 + 15.0 as mid, case when s_suppkey % 4 <> 0 then (s_suppkey % 4) * 1.75 + 1.5 when s_nationkey % 2 = 0 then 7.0 else 4.0 end as half from supplier))"""


def _road(spark, sf):
    k = F.col("s_suppkey")
    half = F.when(k % 4 != 0, k % 4 * 1.75 + 1.5).when(F.col("s_nationkey") % 2 == 0, 7.0).otherwise(4.0)
    mid = k % 60 * 40 + 15.0
    return fx.table(spark, sf, "supplier").select(k.alias("road"), ((k * 61 % 250) * 40).alias("rx0"), ((k * 61 % 250) * 40 + 400).alias("rx1"), (mid - half).alias("ry0"), (mid + half).alias("ry1"))


@query("sp_12_road_subtraction", fx.sql("select lot, (lot.x1 - lot.x0) * (lot.y1 - lot.y0) - coalesce(covered, 0) as area from lot left join (select lot as k, covered from (" + _GRID.format(key="lot", src="cutr") + ")) on lot = k", "lot", more=_ROAD + ", cutr as (select lot, greatest(x0, rx0) as x0, least(x1, rx1) as x1, greatest(y0, ry0) as y0, least(y1, ry1) as y1 from lot join road on x0 < rx1 and rx0 < x1 and y0 < ry1 and ry0 < y1)"))
def sp_12(spark, sf):
    """Lots less the roads on them, each as wide as its lanes or else its class; overlapping roads count once."""
    lot = fx.lot(spark, sf)
    hit = spatial.overlapping(lot.select("lot", *GEO), _road(spark, sf), GEO, ("rx0", "rx1", "ry0", "ry1"))
    cut = hit.select("lot", F.greatest("x0", "rx0").alias("x0"), F.least("x1", "rx1").alias("x1"), F.greatest("y0", "ry0").alias("y0"), F.least("y1", "ry1").alias("y1"))
    return lot.join(unions.union_area(cut, ["lot"]), "lot", "left").select("lot", (metrics.rect_area(*GEO) - F.coalesce("covered", F.lit(0.0))).alias("area"))


@query("sp_11_difference", fx.sql("select lot, (lot.x1 - lot.x0) * (lot.y1 - lot.y0) - coalesce(covered, 0.0) as spare from lot left join (select lot as k, covered from (" + _GRID.format(key="lot", src="inp") + ")) on lot = k where (lot.x1 - lot.x0) * (lot.y1 - lot.y0) - coalesce(covered, 0.0) > 0", "lot", "geo", more="inp as (select lot, greatest(lot.x0, geo.x0) as x0, least(lot.x1, geo.x1) as x1, greatest(lot.y0, geo.y0) as y0, least(lot.y1, geo.y1) as y1 from lot join geo on lot.x0 < geo.x1 and geo.x0 < lot.x1 and lot.y0 < geo.y1 and geo.y0 < lot.y1)"))
def sp_11(spark, sf):
    """What of a lot lies outside all parcels."""
    lot = fx.lot(spark, sf).select("lot", *GEO)
    hit = spatial.overlapping(lot, fx.geo(spark, sf).select(*[F.col(c).alias("l" + c) for c in GEO]), GEO, LOT)
    cut = hit.select("lot", F.greatest("x0", "lx0").alias("x0"), F.least("x1", "lx1").alias("x1"), F.greatest("y0", "ly0").alias("y0"), F.least("y1", "ly1").alias("y1"))
    spare = metrics.rect_area(*GEO) - F.coalesce("covered", F.lit(0.0))
    return lot.join(unions.union_area(cut, ["lot"]), "lot", "left").select("lot", spare.alias("spare")).where("spare > 0")


@query("sp_13_buffer", fx.sql("""select bid, count(*) as n from bld join geo on x0 <= bx1 + 25 and bx0 - 25 <= x1 and y0 <= by1 + 25 and by0 - 25 <= y1 and pow(greatest(bx0 - x1, x0 - bx1, 0), 2) + pow(greatest(by0 - y1, y0 - by1, 0), 2) <= 625 group by bid""", "bld", "geo"))
def sp_13(spark, sf):
    """How many parcels lie within 25 of a building: borders widened for the cells, then the distance."""
    b = fx.bld(spark, sf).select("bid", *BLD, (F.col("bx0") - 25).alias("wx0"), (F.col("bx1") + 25).alias("wx1"), (F.col("by0") - 25).alias("wy0"), (F.col("by1") + 25).alias("wy1"))
    near = spatial.overlapping(b, fx.geo(spark, sf), ("wx0", "wx1", "wy0", "wy1"), GEO, touch=True)
    dx, dy = F.greatest(F.col("bx0") - F.col("x1"), F.col("x0") - F.col("bx1"), F.lit(0)), F.greatest(F.col("by0") - F.col("y1"), F.col("y0") - F.col("by1"), F.lit(0))
    return near.where(dx * dx + dy * dy <= 625).groupBy("bid").agg(F.count("*").alias("n"))


_TOUCH = "o_custkey % 20 = gcust % 20 and fkey < gkey and x0 <= bx1 and bx0 <= x1 and y0 <= by1 and by0 <= y1"
_REACH = f"""two as (select fkey as u, gkey as v from geo join other on {_TOUCH} union select gkey, fkey from geo join other on {_TOUCH}),
 reach(node, root) as (select u, least(u, v) from two union select two.u, reach.root from two join reach on two.v = reach.node where reach.root < two.u), comp as (select node, min(root) as root from reach group by node)"""


def _touching(spark, sf):
    e = _pairs(spark, sf, touch=True).where("o_custkey % 20 = gcust % 20").select(F.col("fkey").alias("u"), F.col("gkey").alias("v"))
    return components.connected(e).withColumnRenamed("node", "fkey")


@query("sp_09_partial_union", "with recursive " + fx.sql("select root, n, covered from (select root, count(*) as n from comp group by root) join (select root as k, covered from (" + _GRID.format(key="root", src="part_") + ")) on root = k", "geo", more=_OTHER + ", " + _REACH + ", part_ as (select root, x0, x1, y0, y1 from geo join comp on fkey = node)")[5:])
def sp_09(spark, sf):
    """Only members that touch are united: components first, then one shape each."""
    m = fx.geo(spark, sf).join(_touching(spark, sf), "fkey")
    return m.groupBy("root").agg(F.count("*").alias("n")).join(unions.union_area(m, ["root"]), "root")


@query("sp_38_adjacency", "with recursive " + fx.sql("select least_n, count(*) as groups from (select root, count(*) as least_n from comp group by root) group by least_n", "geo", more=_OTHER + ", " + _REACH)[5:])
def sp_38(spark, sf):
    """Sizes of the groups that adjacency makes."""
    return _touching(spark, sf).groupBy("root").agg(F.count("*").alias("least_n")).groupBy("least_n").agg(F.count("*").alias("groups"))


# ------------------------------------------------------------------ parking pricing


@query("sp_31_tag_attach", fx.sql("select lot, bid, floors from (select lot, bid, floors, row_number() over (partition by lot order by bid) as r from lot join bld on x0 <= bx1 and bx0 <= x1 and y0 <= by1 and by0 <= y1) where r = 1", "lot", "bld"))
def sp_31(spark, sf):
    """The first tagged shape that meets a lot."""
    return spatial.first_meeting(fx.lot(spark, sf).select("lot", *GEO), fx.bld(spark, sf), GEO, BLD, "bid", ["floors"]).select("lot", "bid", "floors")


_PRICED = """select lot, fkey, round(rate, 6) as rate, round(coalesce(la * rate, 0), 4) as value, coalesce(exempt, 0) = 1 or fkey is null or covered * 1.0 / la < 0.1 as exempt from (select l.lot, la, fkey, {land} * 1.0 / area as rate, exempt, covered from
  (select lot, (x1 - x0) * (y1 - y0) as la from lot) l left join (select lot as k, arg_max(fkey, [s, -fkey]) as fkey, arg_max(land, [s, -fkey]) as land, arg_max(area, [s, -fkey]) as area, max(exempt) as exempt, sum(s) as covered from
  (select lot, fkey, land, area, exempt, (least(lot.x1, par.x1) - greatest(lot.x0, par.x0)) * (least(lot.y1, par.y1) - greatest(lot.y0, par.y0)) as s from lot join par on lot.x0 < par.x1 and par.x0 < lot.x1 and lot.y0 < par.y1 and par.y0 < lot.y1) group by lot) on l.lot = k)"""


@query("sp_32_pricing", fx.sql(_PRICED.format(land="land"), "lot", "par"))
def sp_32(spark, sf):
    """Lots priced at the land rate of the parcel that covers most of them; exempt if any part is or hardly any is covered."""
    return metrics.priced(fx.lot(spark, sf), fx.par(spark, sf), spatial.overlapping)


@query("sp_33_rejoin", fx.sql(_PRICED.format(land="(land * 3)"), "lot", "par"))
def sp_33(spark, sf):
    """Lots that carry an older price joined again on revalued parcels: the joined columns go first, the shapes stay."""
    par = fx.par(spark, sf)
    old = fx.lot(spark, sf).join(metrics.priced(fx.lot(spark, sf), par, spatial.overlapping), "lot")
    return metrics.priced(metrics.without_prices(old), par.withColumn("land", F.col("land") * 3), spatial.overlapping)


# ------------------------------------------------------------------ collapse


@query("sp_41_condo_merge", fx.sql("""select id, n, land, impr, merged from (select min(base) as id, count(*) as n, cast(sum(land) as bigint) as land, cast(sum(impr) as bigint) as impr, 1 as merged from unit where base is not null group by grp
  union all select min(fkey), count(*), cast(sum(land) as bigint), cast(sum(impr) as bigint), 1 from unit where base is null and stack > 1 group by fp
  union all select fkey, 1, land, impr, 0 from unit where base is null and stack = 1)""", "par", more="""acct as (select fkey, land, impr, o_custkey as grp, fkey % 9 = 0 as is_base, (x0 % 200) || ',' || y0 as fp, exempt from par), bases as (select grp, min(fkey) as base from acct where is_base group by grp),
  unit as (select a.fkey, a.land, a.impr, a.grp, a.fp, b.base, count(*) over (partition by case when b.base is null then a.fp else 'b' || a.fkey end) as stack from acct a left join bases b on a.grp = b.grp where exempt = 0 and not is_base)"""))  # fmt: skip
def sp_41(spark, sf):
    """Units go down to their base account; of the rest, those stacked on one footprint become one; others stay. Taxable sums are kept."""
    k = F.col("fkey")
    a = fx.par(spark, sf).select("fkey", "land", "impr", "exempt", F.col("o_custkey").alias("grp"), (k % 9 == 0).alias("is_base"), F.concat_ws(",", F.col("x0") % 200, "y0").alias("fp"))
    bases = a.where("is_base").groupBy("grp").agg(F.min("fkey").alias("base"))
    unit = a.where("exempt = 0 and not is_base").join(bases, "grp", "left")
    sums = [F.count("*").alias("n"), F.sum("land").alias("land"), F.sum("impr").alias("impr")]
    down = unit.where("base is not null").groupBy("grp").agg(F.min("base").alias("id"), *sums).drop("grp").withColumn("merged", F.lit(1))
    rest = unit.where("base is null").groupBy("fp").agg(F.min("fkey").alias("id"), *sums).drop("fp")
    return down.unionByName(rest.withColumn("merged", (F.col("n") > 1).cast("int")))


@query("sp_45_collapse_passes", "with recursive " + fx.sql("""select id, count(*) as parcels, cast(sum(land) as bigint) as land, cast(sum(total) as bigint) as total from (select case when small then 'campus ' || o_custkey else 'parcel ' || lead end as id, land, total from
  (select lead, min(o_custkey) as o_custkey, sum(area) < 2000 as small, sum(land) as land, sum(total) as total from (select coalesce(c.root, par.fkey) as lead, o_custkey % 20 as o_custkey, area, land, total from par left join comp c on par.fkey = c.node) group by lead)) group by id""", "par", more=_OTHER + ", " + _REACH)[5:])  # fmt: skip
def sp_45(spark, sf):
    """Passes one after the other: touching parcels to lots, small lots to their owner's campus; sums are kept."""
    p = fx.par(spark, sf).join(_touching(spark, sf), "fkey", "left").withColumn("lead", F.coalesce("root", "fkey"))
    lots = p.groupBy("lead").agg(F.min(F.col("o_custkey") % 20).alias("owner"), F.sum("area").alias("area"), F.sum("land").alias("land"), F.sum("total").alias("total"))
    ids = F.when(F.col("area") < 2000, F.concat(F.lit("campus "), F.col("owner").cast("string"))).otherwise(F.concat(F.lit("parcel "), F.col("lead").cast("string")))
    return lots.groupBy(ids.alias("id")).agg(F.count("*").alias("parcels"), F.sum("land").alias("land"), F.sum("total").alias("total"))


@query("sp_53_greedy_assignment", None)
def sp_53(spark, sf):
    """Lots take the parcels on them, by source, number of parcels and area; what is left must weigh two at least."""
    hit = spatial.overlapping(fx.lot(spark, sf), fx.par(spark, sf).select(F.col("fkey").alias("member"), F.col("n").alias("weight"), *[F.col(c).alias("l" + c) for c in GEO]), GEO, LOT)
    members = hit.select(F.col("lot").alias("cand"), "member", "weight")
    cands = hit.groupBy("lot", "source", *GEO).agg(F.sum("weight").alias("w"))
    rank = F.struct((F.col("source") != "osm").alias("source"), (-F.col("w")).alias("w"), (-metrics.rect_area(*GEO)).alias("area"), F.col("lot").alias("lot"))
    return assign.greedy(cands.select(F.col("lot").alias("cand"), rank.alias("rank")), members)


# ------------------------------------------------------------------ pieces, hexagons and overlays


@query("pj_02_client_fields", fx.sql("select fkey, land + impr as total, round(case when land > 0 then impr * 1.0 / land end, 6) as ratio, round(case when land + impr > 0 then land * 100.0 / (land + impr) end, 6) as land_pct from (select fkey, case when fkey % 7 = 0 then null when fkey % 7 = 1 then 'inf'::double else land end as land, impr from par) where land is not null and isfinite(land)", "par"))
def pj_02(spark, sf):
    """Derived fields of rows whose land and improvement are both finite; others are passed over."""
    k = F.col("fkey")
    p = fx.par(spark, sf).select("fkey", F.when(k % 7 == 0, None).when(k % 7 == 1, float("inf")).otherwise(F.col("land")).cast("double").alias("land"), "impr")
    r = metrics.ratio_fields(metrics.finite(p, ["land", "impr"]))
    return r.select("fkey", "total", F.round("impr_land_ratio", 6).alias("ratio"), F.round("land_pct_total", 6).alias("land_pct"))


@query("pj_10_reported_first", fx.sql("select fkey, case when case when fkey % 3 = 0 then 0 when fkey % 3 = 1 then null else 700 + fkey % 90 end > 0 then 700 + fkey % 90 else area end as area from par", "par"))
def pj_10(spark, sf):
    """The reported area if it is over zero, else the measured one."""
    k = F.col("fkey")
    reported = F.when(k % 3 == 0, 0).when(k % 3 == 1, None).otherwise(k % 90 + 700)
    return fx.par(spark, sf).select("fkey", metrics.first_positive(reported, "area").alias("area"))


@query("sp_10_pieces", fx.sql("select lot, fkey, greatest(lot.x0, geo.x0) as x0, least(lot.x1, geo.x1) as x1, greatest(lot.y0, geo.y0) as y0, least(lot.y1, geo.y1) as y1 from lot join geo on lot.x0 < geo.x1 and geo.x0 < lot.x1 and lot.y0 < geo.y1 and geo.y0 < lot.y1", "lot", "geo"))
def sp_10(spark, sf):
    """The shapes that lots and parcels share."""
    hit = spatial.overlapping(fx.lot(spark, sf).select("lot", *GEO), fx.geo(spark, sf).select("fkey", *[F.col(c).alias("l" + c) for c in GEO]), GEO, LOT)
    return hit.select("lot", "fkey", F.greatest("x0", "lx0").alias("x0"), F.least("x1", "lx1").alias("x1"), F.greatest("y0", "ly0").alias("y0"), F.least("y1", "ly1").alias("y1"))


@query("sp_21_multi_cell", fx.sql("select fkey, ix, iy from geo, unnest(generate_series(cast(floor(x0 / 30) as bigint), cast(floor(x1 / 30) as bigint))) t(ix), unnest(generate_series(cast(floor(y0 / 30) as bigint), cast(floor(y1 / 30) as bigint))) s(iy)", "geo"))
def sp_21(spark, sf):
    """Every cell that a footprint touches."""
    return spatial.cells(fx.geo(spark, sf), *GEO, 30).select("fkey", F.col("_ix").alias("ix"), F.col("_iy").alias("iy"))


@query("sp_26_hex_boundary", "select c_custkey, i, round(cx + 25 * cos(pi() / 6 + i * pi() / 3), 6) as x, round(cy + 25 * sin(pi() / 6 + i * pi() / 3), 6) as y from (select c_custkey, (q * sqrt(3) + r * (sqrt(3) / 2)) * 25 as cx, r * 1.5 * 25 as cy from (select c_custkey, c_custkey % 31 as q, c_custkey % 17 - 8 as r from customer)), range(0, 6) t(i)")
def sp_26(spark, sf):
    """Corners of hexagonal cells."""
    k = F.col("c_custkey")
    c = fx.table(spark, sf, "customer").select("c_custkey", F.posexplode(hexgrid.ring(k % 31, k % 17 - 8, 25.0)).alias("i", "p"))
    return c.select("c_custkey", F.col("i").cast("long").alias("i"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("sp_29_square_grid", fx.sql("select floor((x0 + x1) / 2 / 500.0) as ix, floor((y0 + y1) / 2 / 500.0) as iy, count(*) as n, round(avg(land), 6) as land, max(case when land > 20000 then 1 else 0 end) as dear from par group by 1, 2", "par"))
def sp_29(spark, sf):
    """Parcels by the square that holds their middle."""
    at = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / 500).cast("double")
    return fx.par(spark, sf).groupBy(at("x0", "x1").alias("ix"), at("y0", "y1").alias("iy")).agg(F.count("*").alias("n"), F.round(F.avg("land"), 6).alias("land"), F.max((F.col("land") > 20000).cast("int")).alias("dear"))


@query("sp_37_contiguity", "with recursive " + fx.sql("""select root, count(*) as n from (select node, min(root) as root from reach group by node) group by root""", "lot", more="""e as (select a.lot as u, b.lot as v from lot a join lot b on a.lot < b.lot and a.p_size % 6 = b.p_size % 6 and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1), two as (select u, v from e union select v, u from e),
 reach(node, root) as (select u, least(u, v) from two union select two.u, reach.root from two join reach on two.v = reach.node where reach.root < two.u)""")[5:])  # fmt: skip
def sp_37(spark, sf):
    """Groups of lots of one kind that touch."""
    return components.touching(fx.lot(spark, sf).select("lot", (F.col("p_size") % 6).alias("size6"), *GEO), "lot", "size6", GEO).where("n > 1")


@query("sp_47_overlay", fx.sql("select name, round(covered, 6) as covered, slabs from (" + _GRID.format(key="name", src="tidy") + ")", "par", more="tidy as (select region || ' ' || cast(floor(y0 / 400) as bigint) || '/' || cast(floor(x0 / 2000) as bigint) as name, floor(x0 / 8 + 0.5) * 8 as x0, floor(x1 / 8 + 0.5) * 8 as x1, floor(y0 / 8 + 0.5) * 8 as y0, floor(y1 / 8 + 0.5) * 8 as y1 from par)"))
def sp_47(spark, sf):
    """An overlay of named districts: footprints snapped to a precision and dissolved by name."""
    snap = lambda c: (F.floor(F.col(c) / 8 + 0.5) * 8).cast("double").alias(c)
    name = F.concat("region", F.lit(" "), F.floor(F.col("y0") / 400).cast("string"), F.lit("/"), F.floor(F.col("x0") / 2000).cast("string"))
    d = unions.dissolved(fx.par(spark, sf).select(name.alias("name"), *[snap(c) for c in GEO]), ["name"])
    w, h = F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")
    return d.groupBy("name").agg(F.round(F.sum(w * h), 6).alias("covered"), F.count_distinct("sx0").alias("slabs"))


@query("sc_28_geometry_text", fx.sql("select fkey, 1 + cast(fkey % 3 = 0 as int) as n, (x1 - x0) * (y1 - y0) - case when fkey % 3 = 0 then 4 else 0 end as area from geo where fkey % 11 <> 0", "geo"))
def sc_28(spark, sf):
    """Polygons as text, decoded; rows that are no polygon are dropped."""
    s = lambda c: F.col(c).cast("string")
    pt = lambda x, y: F.concat(x, F.lit(" "), y)
    loop = lambda *p: F.concat(F.lit("("), F.concat_ws(", ", *p, p[0]), F.lit(")"))
    a, b = (F.col("x0") + 2).cast("string"), (F.col("x0") + 4).cast("string")
    c, d = (F.col("y0") + 2).cast("string"), (F.col("y0") + 4).cast("string")
    outer, inner = loop(pt(s("x0"), s("y0")), pt(s("x1"), s("y0")), pt(s("x1"), s("y1")), pt(s("x0"), s("y1"))), loop(pt(a, c), pt(a, d), pt(b, d), pt(b, c))
    wkt = F.when(F.col("fkey") % 11 == 0, "POINT (1 2)").otherwise(F.concat(F.lit("POLYGON ("), F.when(F.col("fkey") % 3 == 0, F.concat_ws(", ", outer, inner)).otherwise(outer), F.lit(")")))
    g = fx.geo(spark, sf).select("fkey", files.decode_wkt(wkt).alias("rings")).where("rings is not null")
    return g.select("fkey", F.size("rings").alias("n"), rings.area(F.col("rings")).alias("area"))


@query("sc_03_schema", "select column_name as c from (describe select * from orders)")
def sc_03(spark, sf):
    """The columns of a table from its schema alone."""
    return files.dictionary(fx.table(spark, sf, "orders")).select(F.col("column").alias("c"))


@query("sk_08_dictionary", "select column_name as c, (select count(*) from orders) as record_count from (describe select * from orders)")
def sk_08(spark, sf):
    """The dictionary of a table with its record count."""
    o = fx.table(spark, sf, "orders")
    return files.dictionary(o).select(F.col("column").alias("c")).crossJoin(F.broadcast(o.agg(F.count("*").alias("record_count"))))  # one row


@query("sf_24_slug", "select n_nationkey, regexp_replace(lower(n_name || ' & ' || n_nationkey || '-Co.'), '[^a-z0-9]+', '', 'g') as slug from nation")
def sf_24(spark, sf):
    n = fx.table(spark, sf, "nation")
    return n.select("n_nationkey", scalar.slug(F.concat("n_name", F.lit(" & "), F.col("n_nationkey").cast("string"), F.lit("-Co."))).alias("slug"))


_CARVE = """cutr as (select a.lot, greatest(a.x0, b.x0) as x0, least(a.x1, b.x1) as x1, greatest(a.y0, b.y0) as y0, least(a.y1, b.y1) as y1 from {src} a join {src} b on a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1
  where (b.x1 - b.x0) * (b.y1 - b.y0) > (a.x1 - a.x0) * (a.y1 - a.y0) or ((b.x1 - b.x0) * (b.y1 - b.y0) = (a.x1 - a.x0) * (a.y1 - a.y0) and b.lot < a.lot))"""
_KEPT = "select lot, area, cast(area - coalesce(covered, 0) as bigint) as kept from (select lot, (x1 - x0) * (y1 - y0) as area from {src}) left join (select lot as k, covered from (" + _GRID.format(key="lot", src="cutr") + ")) on lot = k"


@query("sp_34_overlap_carve", fx.sql(_KEPT.format(src="lot"), "lot", more=_CARVE.format(src="lot")))
def sp_34(spark, sf):
    """Area that each lot keeps when larger ones that overlap it come first."""
    return mesh.carved(fx.lot(spark, sf).select("lot", *GEO))


@query("wn_09_largest_first", fx.sql(_KEPT.format(src="wide"), "lot", more="wide as (select lot, x0 % 600 as x0, x0 % 600 + (x1 - x0) * 2 as x1, y0 % 600 as y0, y0 % 600 + (y1 - y0) * 2 as y1 from lot), " + _CARVE.format(src="wide")))
def wn_09(spark, sf):
    """The same on lots that overlap many times."""
    wide = fx.lot(spark, sf).select("lot", (F.col("x0") % 600).alias("x0"), (F.col("x0") % 600 + (F.col("x1") - F.col("x0")) * 2).alias("x1"), (F.col("y0") % 600).alias("y0"), (F.col("y0") % 600 + (F.col("y1") - F.col("y0")) * 2).alias("y1"))
    return mesh.carved(wide)
