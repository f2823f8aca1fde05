"""Shapes that are no boxes: simplification, hulls, hexagon pieces, repair and differences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terraledger.functions import rings
from terraledger.operators import borders, collapse, components, condos, hexgrid, hulls, lineage, mesh, overlay, raster, regions, repair, roads, simplify, spatial, unions
from terraledger.plans import fixtures as fx
from terraledger.plans.joins import _pairs
from terraledger.plans.parcels import _POLY, GEO, LOT, _poly
from terraledger.plans.registry import query
from terraledger.sources import files, geometry, vector

# ------------------------------------------------------------------ simplification

#: A quilt of four-sided parcels: corners of a shaken lattice, sides in four parts with a shallow zigzag that neighbours share.
_NODE = "40.0 * ({i}) + (({i}) * 7 + ({j}) * 13) % 11 - 5 as x{n}, 40.0 * ({j}) + (({i}) * 5 + ({j}) * 3) % 9 - 4 as y{n}"
_QUILT = "quilt as (select k, " + ", ".join(_NODE.format(i=f"i + {a}", j=f"j + {b}", n=n) for n, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])) + " from (select o_orderkey as k, o_orderkey % 250 as i, cast(floor(o_orderkey / 250) as bigint) as j from orders))"


def _quilt(spark, sf):
    k = F.col("o_orderkey")
    node = lambda i, j: ((i * 40 + (i * 7 + j * 13) % 11 - 5).cast("double"), (j * 40 + (i * 5 + j * 3) % 9 - 4).cast("double"))
    i, j = F.col("i"), F.col("j")

    def side(a, b, level):  # from the lower or left end
        points = []
        for t, off in ((0.25, 0.3), (0.5, -0.3), (0.75, 0.3)):
            x, y = a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t
            points.append(F.struct((x if level else x + off).alias("x"), (y + off if level else y).alias("y")))
        return F.array(*points)

    p = [node(i + a, j + b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    one = lambda n: F.array(F.struct(p[n][0].alias("x"), p[n][1].alias("y")))
    ring = F.concat(one(0), side(p[0], p[1], True), one(1), side(p[1], p[2], False), one(2), F.reverse(side(p[3], p[2], True)), one(3), F.reverse(side(p[0], p[3], False)))
    cells = fx.table(spark, sf, "orders").select(k.alias("k"), (k % 250).alias("i"), F.floor(k / 250).alias("j"))
    return cells.select("k", F.array(F.when(F.col("k") % 2 == 1, F.reverse(ring)).otherwise(ring)).alias("rings"))


@query("sp_14_simplify", fx.sql("select k, 4 as corners, round(abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2, 6) as area from quilt", more=_QUILT))
def sp_14(spark, sf):
    """Parcels whose sides wander by less than the tolerance: corners stay, common sides stay common."""
    s = simplify.simplified(_quilt(spark, sf), "k", "rings", 0.5)
    return s.select("k", F.size(F.col("rings")[0]).alias("corners"), F.round(rings.area(F.col("rings")), 6).alias("area"))


# ------------------------------------------------------------------ hulls

_CORNERS = "pt as (select distinct o_custkey, x, y from (select o_custkey, unnest([x0, x1, x0, x1]) as x, unnest([y0, y0, y1, y1]) as y from geo))"


@query("sp_54_min_width", fx.sql("""select o_custkey, corners, round(area, 4) as area, round(short, 6) as short, round(greatest(0, 60 - short) / 2, 6) as pad from
  (select o_custkey, count(*) as corners, sum(ax * by_ - bx * ay) / 2.0 as area from edge group by o_custkey) join
  (select o_custkey, least(len, high) as short from (select *, row_number() over (partition by o_custkey order by least(len, high), greatest(len, high)) as r from (select *, min(len * high) over (partition by o_custkey) as best from side) where len * high <= best * (1 + 1e-9)) where r = 1) using (o_custkey)""", "geo", more=_CORNERS + """,
 edge as (select a.o_custkey, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from pt a join pt b on a.o_custkey = b.o_custkey and (a.x <> b.x or a.y <> b.y) join pt c on a.o_custkey = c.o_custkey group by all
  having bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 or ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) and (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) between 0 and (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))),
 side as (select e.o_custkey, (max(c.x * ux + c.y * uy) - min(c.x * ux + c.y * uy)) as len, max(c.y * ux - c.x * uy) - min(c.y * ux - c.x * uy) as high from
  (select *, (bx - ax) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) as ux, (by_ - ay) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) as uy from edge) e join pt c on e.o_custkey = c.o_custkey group by e.o_custkey, ax, ay, bx, by_)"""))  # fmt: skip
def sp_54(spark, sf):
    """The hull of an owner's footprints, the shorter side of its least rectangle, and how far it is widened to a least width."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    p = fx.geo(spark, sf).select("o_custkey", F.explode(F.array(*[corner(x, y) for x in ("x0", "x1") for y in ("y0", "y1")])).alias("c"))
    h = hulls.hulls(p.select("o_custkey", "c.x", "c.y"), ["o_custkey"], "x", "y", 60.0)
    return h.select("o_custkey", F.size("corners").alias("corners"), F.round(rings.signed_area(F.col("corners")), 4).alias("area"), F.round("short", 6).alias("short"), F.round("pad", 6).alias("pad"))


# ------------------------------------------------------------------ hexagons

_SIZE = 25.0
_H = math.sqrt(3) / 2 * _SIZE
#: The parts of an L-shaped parcel as strips with straight sides (sign, from y to y, left and right ends), the bands of a hexagon likewise, and what they share.
_STRIPS = f"""strip as (select fkey, 1 as sign, y0 as ya, y0 + 10 as yb, x0 as la, x0 as lb, x1 as ra, x1 as rb from geo union all select fkey, 1, y0 + 10, y1, x0, x0, x0 + 10, x0 + 10 from geo
  union all select fkey, -1, y0 + 2, y0 + 6, x0 + 2, x0 + 2, x0 + 6, x0 + 6 from geo where fkey % 3 = 0 union all select fkey, -1, y0 + 1, y0 + 3, x0 + 7, x0 + 7, x0 + 9, x0 + 7 from geo where fkey % 6 = 0),
 near as (select strip.*, q, r, (q + r / 2.0) * sqrt(3) * {_SIZE} as cx, r * 1.5 * {_SIZE} as cy from strip, unnest(generate_series(cast(floor(ya / {1.5 * _SIZE}) - 1 as bigint), cast(ceil(yb / {1.5 * _SIZE}) + 1 as bigint))) t(r), unnest(generate_series(cast(floor(la / {2 * _H} - r / 2.0) - 1 as bigint), cast(ceil(greatest(ra, rb) / {2 * _H} - r / 2.0) + 1 as bigint))) s(q)),
 band as (select *, greatest(ya, cy + lo) as lo_y, least(yb, cy + hi) as hi_y from near, (values (-{_SIZE}, -{_SIZE / 2}), (-{_SIZE / 2}, {_SIZE / 2}), ({_SIZE / 2}, {_SIZE})) b(lo, hi) where cy + lo < yb and ya < cy + hi),
 line as (select *, (lb - la) / (yb - ya) as ls, (rb - ra) / (yb - ya) as rs, case when lo < -{_SIZE / 2} then {math.sqrt(3)} when lo < 0 then 0.0 else -{math.sqrt(3)} end as ws, case when lo < -{_SIZE / 2} then {math.sqrt(3) * _SIZE} when lo < 0 then {_H} else {math.sqrt(3) * _SIZE} end as w0 from band),
 cut as (select *, unnest(list_sort(list_filter([lo_y, hi_y, (cx + w0 - ws * cy - ra + rs * ya) / nullif(rs - ws, 0), (cx - w0 + ws * cy - la + ls * ya) / nullif(ls + ws, 0), (cx + w0 - ws * cy - la + ls * ya) / nullif(ls - ws, 0), (cx - w0 + ws * cy - ra + rs * ya) / nullif(rs + ws, 0)], lambda v: v is not null and v >= lo_y and v <= hi_y))) as v, generate_subscripts([1, 2, 3, 4, 5, 6], 1) as i from line),
 seg as (select *, lead(v) over (partition by fkey, sign, ya, la, q, r, lo order by v) as w from cut where v is not null),
 share as (select fkey, q, r, sum(sign * (w - v) * greatest(0, least(ra + rs * (m - ya), cx + w0 + ws * (m - cy)) - greatest(la + ls * (m - ya), cx - w0 - ws * (m - cy)))) as piece from (select *, (v + w) / 2 as m from seg where w > v) group by fkey, q, r)"""


@query("sp_23_hex_pieces", fx.sql("select fkey, q as hq, r as hr, round(piece, 5) as piece from share where piece > 1e-7", "geo", more=_STRIPS))
def sp_23(spark, sf):
    """What each polygon shares with each hexagon, exactly; pieces add up to the polygon."""
    p = hexgrid.pieces(_poly(spark, sf), "rings", _SIZE).where("piece > 1e-7")
    return p.select("fkey", "hq", "hr", F.round("piece", 5).alias("piece"))


_FILL = 8.0
#: A point inside each polygon (middle of the widest stretch of a level line), and the hexagons whose centre it holds.
_BINNED = f"""mid as (select fkey, (min(a.y) + max(a.y)) / 2 as m from edge where r = 1 group by fkey),
 level as (select fkey, (max(a.y) filter (where a.y <= m) + min(a.y) filter (where a.y > m)) / 2 as y from edge join mid using (fkey) group by fkey),
 hit as (select fkey, y, (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x as x from edge join level using (fkey) where (a.y > y) <> (b.y > y)),
 stretch as (select fkey, y, x as lo, lead(x) over w as hi, row_number() over w as n from hit window w as (partition by fkey order by x)),
 inner_ as (select fkey, (lo + hi) / 2 as x, y from (select *, row_number() over (partition by fkey order by hi - lo desc, lo) as k from stretch where n % 2 = 1) where k = 1),
 sized as (select fkey, max(case when r = 1 then abs(s) end) - coalesce(sum(case when r > 1 then abs(s) end), 0) as area from ringa group by fkey),
 base as (select fkey, area, cast(case when dq > dr and dq > ds then -b - c else a end as bigint) as hq, cast(case when not (dq > dr and dq > ds) and dr > ds then -a - c else b end as bigint) as hr
  from (select *, abs(a - q) as dq, abs(b - r) as dr, abs(c + q + r) as ds from (select *, floor(q + 0.5) as a, floor(r + 0.5) as b, floor(-q - r + 0.5) as c from (select fkey, area, (x * (sqrt(3) / 3) - y / 3) / {_FILL} as q, y * 2 / 3 / {_FILL} as r from inner_ join sized using (fkey))))),
 near as (select fkey, area, base.hq as oq, base.hr as orr, q, r, (q + r / 2.0) * sqrt(3) * {_FILL} as cx, r * 1.5 * {_FILL} as cy from base join geo using (fkey), unnest(generate_series(cast(floor(y0 / {1.5 * _FILL}) - 1 as bigint), cast(ceil(y1 / {1.5 * _FILL}) + 1 as bigint))) t(r),
  unnest(generate_series(cast(floor(x0 / {math.sqrt(3) * _FILL} - r / 2.0) - 1 as bigint), cast(ceil(x1 / {math.sqrt(3) * _FILL} - r / 2.0) + 1 as bigint))) s(q) where area > 3 * {hexgrid.area(_FILL)}),
 fill as (select near.fkey, q, r from near join edge e on near.fkey = e.fkey and (e.a.y > cy) <> (e.b.y > cy) and cx < (e.b.x - e.a.x) * (cy - e.a.y) / (e.b.y - e.a.y) + e.a.x where q <> oq or near.r <> orr group by near.fkey, q, near.r having count(*) % 2 = 1),
 part as (select fkey, hq, hr, least(area, {hexgrid.area(_FILL)}) as piece from base union all select fkey, q, r, {hexgrid.area(_FILL)} from fill)"""
_BINNED = _BINNED.replace("select near.fkey, q, r from near", "select near.fkey, q, near.r from near")


@query("sp_24_hex_binning", fx.sql("select fkey, hq, hr, round(piece, 6) as piece from part", "geo", more=_POLY + ", " + _BINNED))
def sp_24(spark, sf):
    """Parcels in the hexagon of a point inside them; large ones also in those whose centre they hold."""
    p = hexgrid.binned_pieces(_poly(spark, sf), "rings", _FILL)
    return p.select("fkey", "hq", "hr", F.round("piece", 6).alias("piece"))


@query("st_07_binning_concat", fx.sql("select hq, hr, count(*) as n, round(sum(piece), 4) as piece, round(sum(land * piece / sized.area), 4) as land from part join sized using (fkey) join roll using (fkey) group by hq, hr", "geo", "roll", more=_POLY + ", " + _BINNED))
def st_07(spark, sf):
    """Own and filled hexagons in one frame; what a parcel is worth goes to them by area."""
    land = fx.roll(spark, sf).select("fkey", "land")
    p = hexgrid.binned_pieces(_poly(spark, sf).withColumn("area", rings.area(F.col("rings"))), "rings", _FILL).join(land, "fkey")
    return p.groupBy("hq", "hr").agg(F.count("*").alias("n"), F.round(F.sum("piece"), 4).alias("piece"), F.round(F.sum(F.col("land") * F.col("piece") / F.col("area")), 4).alias("land"))


@query("sp_05_inside_point", fx.sql("select fkey, round(x, 6) as x, round(y, 6) as y from inner_", "geo", more=_POLY + ", " + _BINNED))
def sp_05_inside(spark, sf):
    """A point that lies in the polygon, holes and dents notwithstanding."""
    p = _poly(spark, sf).select("fkey", rings.inside_point(F.col("rings")).alias("p"))
    return p.select("fkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


# ------------------------------------------------------------------ repair


def _spoilt(spark, sf):
    """Hourglasses, boxes with a spike, boxes with a hole that lies half outside, and boxes walked twice but for a corner."""
    at = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("y0") + y).cast("double").alias("y"))
    w, h, k = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("fkey") % 4
    zero = F.lit(0)
    box = [at(zero, zero), at(w, zero), at(w, h), at(zero, h)]
    hourglass = F.array(F.array(at(zero, zero), at(w, h), at(w, zero), at(zero, h), at(zero, zero)))
    spike = F.array(F.array(at(zero, zero), at(zero - 7, zero), at(zero, zero), *box[1:], box[0]))
    half_out = F.array(F.array(*box, box[0]), F.array(at(w - 5, zero + 3), at(w + 5, zero + 3), at(w + 5, zero + 9), at(w - 5, zero + 9)))
    twice = F.array(F.array(*box, *box[:3], at(zero + 4, h), at(zero, h - 4)))
    return fx.geo(spark, sf).select("fkey", F.when(k == 0, hourglass).when(k == 1, spike).when(k == 2, half_out).otherwise(twice).alias("rings"))


@query("sp_07_repair_crossings", fx.sql("""select fkey, case when k = 0 then 2 when k = 2 then 2 else 1 end as parts, case k when 0 then w * h / 2.0 when 1 then w * h when 2 then w * h else 8 end as area from (select fkey, fkey % 4 as k, x1 - x0 as w, y1 - y0 as h from geo)""", "geo"))
def sp_07_crossings(spark, sf):
    """Rings that cross, overlap or run back on themselves, repaired by the even-odd rule: parts and their whole area."""
    v = repair.valid(_spoilt(spark, sf), "fkey")
    return v.groupBy("fkey").agg(F.count("*").alias("parts"), F.round(F.sum(rings.area(F.col("rings"))), 6).alias("area"))


# ------------------------------------------------------------------ differences

#: Unit squares of each lot outside all parcels, and the border and corners that they make.
_LEFT = """cell as materialized (select lot, x, unnest(range(y0, y1)) as y from (select lot, y0, y1, unnest(range(x0, x1)) as x from lot)),
 free as materialized (select lot, x, y from cell anti join (select lot as k, x as px, y as py from (select *, x - x % 40 - dx as gx, y - y % 40 - dy as gy from cell, (values (0), (40)) a(dx), (values (0), (40)) b(dy)) join geo on geo.x0 = gx and geo.y0 = gy where x < geo.x1 and y < geo.y1) on lot = k and x = px and y = py),
 side as materialized (select lot, a, b, c, d from (select lot, unnest([x, x + 1, x, x]) as a, unnest([y, y, y, y + 1]) as b, unnest([x, x + 1, x + 1, x + 1]) as c, unnest([y + 1, y + 1, y, y + 1]) as d from free) group by all having count(*) = 1),
 knot as (select lot, x, y, count(*) as n, sum((a + c) - 2 * x) as sx, sum((b + d) - 2 * y) as sy from (select lot, unnest([a, c]) as x, unnest([b, d]) as y, a, b, c, d from side) group by lot, x, y)"""


@query("sp_11_difference_shapes", fx.sql("select lot, area, border, corners from (select lot, count(*) as area from free group by lot) join (select lot, count(*) as border from side group by lot) using (lot) join (select lot, cast(sum(case when n = 4 then 2 when sx <> 0 or sy <> 0 then 1 else 0 end) as bigint) as corners from knot group by lot) using (lot)", "lot", "geo", more=_LEFT))
def sp_11_shapes(spark, sf):
    """The shapes that lots leave outside all parcels, as rings: their area, length of border and corners."""
    lot = fx.lot(spark, sf).select("lot", *GEO)
    hit = spatial.overlapping(lot, fx.geo(spark, sf).select(*[F.col(c).alias("l" + c) for c in GEO]), GEO, LOT)
    cut = hit.select("lot", *[f(c, "l" + c).alias(c) for c, f in zip(GEO, (F.greatest, F.least, F.greatest, F.least), strict=True)])
    taken = unions.dissolved(cut, ["lot"]).select("lot", F.col("sx0").alias("x0"), F.col("sx1").alias("x1"), F.col("sy0").alias("y0"), F.col("sy1").alias("y1"), F.lit(-1).alias("w"))
    whole = lot.select("lot", *[F.col(c).cast("double").alias(c) for c in GEO], F.lit(1).alias("w"))
    left = borders.traced(borders.outlines(whole.unionByName(taken), ["lot"], weight="w"), ["lot"])
    after = lambda r: F.concat(F.slice(r, F.lit(2), F.size(r) - 1), F.slice(r, 1, 1))
    length = F.aggregate(F.flatten(F.transform("rings", lambda r: F.zip_with(r, after(r), lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])))), F.lit(0.0), lambda s, d: s + d)
    return left.groupBy("lot").agg(F.sum(rings.area(F.col("rings"))).cast("long").alias("area"), F.sum(length).cast("long").alias("border"), F.sum(F.size(F.flatten("rings"))).alias("corners"))


# ------------------------------------------------------------------ rasters

#: Probabilities where lots lie (pixels of four units), infrared from the floors of buildings; limits of mask and vegetation, radius of the opening.
LIKELY, GREEN, RADIUS = 0.5, 0.2, 3
_PIXELS = f"""prob as (select x, y, sum(0.35 + 0.1 * (p_size % 4)) as p from (select p_size, x, unnest(range(cast(floor(y0 / 4) as bigint), cast(floor((2 * y1 - y0) / 4) as bigint))) as y from (select p_size, y0, y1, unnest(range(cast(floor(x0 / 4) as bigint), cast(floor((2 * x1 - x0) / 4) as bigint))) as x from lot)) group by x, y),
 band as (select x, y, max(floors) as f from (select floors, x, unnest(range(cast(floor(by0 / 4) as bigint), cast(floor(by1 / 4) as bigint))) as y from (select floors, by0, by1, unnest(range(cast(floor(bx0 / 4) as bigint), cast(floor(bx1 / 4) as bigint))) as x from bld)) group by x, y),
 likely as materialized (select x, y, coalesce(20.0 * f / (200 + 20 * f), 0) as ndvi from prob left join band using (x, y) where round(p, 6) >= {LIKELY}), bare as materialized (select x, y from likely where ndvi <= {GREEN}),
 off as (select dx, dy from range(-{RADIUS}, {RADIUS + 1}) t(dx), range(-{RADIUS}, {RADIUS + 1}) s(dy) where dx * dx + dy * dy <= {RADIUS * RADIUS}),
 inner_ as materialized (select b.x, b.y from (select x, y, x + dx as nx, y + dy as ny from bare, off) b join bare n on n.x = nx and n.y = ny group by b.x, b.y having count(*) = {len(raster.disk(RADIUS))}), op as materialized (select distinct x + dx as x, y + dy as y from inner_, off)"""


def _likely(spark, sf):
    """(y, x, ndvi) of the pixels that are likely parking."""
    span = lambda a, b: F.explode(F.filter(F.sequence(F.floor(F.col(a) / 4), F.floor(b / 4)), lambda v: v < F.floor(b / 4)))
    lot = fx.lot(spark, sf).withColumn("x", span("x0", F.col("x1") * 2 - F.col("x0"))).withColumn("y", span("y0", F.col("y1") * 2 - F.col("y0")))
    prob = lot.groupBy("y", "x").agg(F.sum(F.lit(0.35) + F.lit(0.1) * (F.col("p_size") % 4)).alias("p"))
    bld = fx.bld(spark, sf).withColumn("x", span("bx0", F.col("bx1"))).withColumn("y", span("by0", F.col("by1"))).groupBy("y", "x").agg(F.max("floors").alias("f"))
    red, nir = F.lit(100.0), F.coalesce("f", F.lit(0)) * 20 + 100
    return prob.where(F.round("p", 6) >= LIKELY).join(bld, ["y", "x"], "left").select("y", "x", ((nir - red) / (nir + red)).alias("ndvi"))


def _mask(spark, sf):
    return raster.opened(raster.tiles(_likely(spark, sf).where(F.col("ndvi") <= GREEN)), RADIUS)


@query("sp_50_raster_mask", fx.sql("select cast(floor(y / 128) as bigint) as ty, cast(floor(x / 128) as bigint) as tx, cast(sum(a) as bigint) as likely, cast(sum(b) as bigint) as bare, cast(sum(c) as bigint) as opened from (select x, y, 1 as a, 0 as b, 0 as c from likely union all select x, y, 0, 1, 0 from bare union all select x, y, 0, 0, 1 from op) group by 1, 2", "lot", "bld", more=_PIXELS))
def sp_50_mask(spark, sf):
    """Pixels of each tile after the limit, without vegetation, and opened with a disk that reaches over the tiles' sides."""
    likely = _likely(spark, sf)
    count = lambda p, n: p.groupBy(F.floor(F.col("y") / raster.SIDE).alias("ty"), F.floor(F.col("x") / raster.SIDE).alias("tx")).agg(F.count("*").alias(n))
    first = likely.groupBy(F.floor(F.col("y") / raster.SIDE).alias("ty"), F.floor(F.col("x") / raster.SIDE).alias("tx")).agg(F.count("*").alias("likely"), F.count_if(F.col("ndvi") <= GREEN).alias("bare"))
    return first.join(count(raster.pixels(_mask(spark, sf)), "opened"), ["ty", "tx"], "left").fillna(0, ["opened"])


#: Regions of the opened mask in SQL: runs of each row of the whole image, joined to the runs above.
_REGIONS = """run as materialized (select y, min(x) as x0, max(x) + 1 as x1, y * 4294967296 + min(x) as id from (select *, x - row_number() over (partition by y order by x) as g from op) group by y, g),
 two as materialized (select a.id as u, b.id as v from run a join run b on a.y = b.y + 1 and a.x0 < b.x1 and b.x0 < a.x1 union select b.id, a.id from run a join run b on a.y = b.y + 1 and a.x0 < b.x1 and b.x0 < a.x1),
 reach(node, root) as (select u, least(u, v) from two union select two.u, reach.root from two join reach on two.v = reach.node where reach.root < two.u),
 region as (select coalesce(root, id) as label, run.* from run left join (select node, min(root) as root from reach group by node) on id = node)"""


@query("sp_51_seam_merge", "with recursive " + fx.sql("select min(x0) as x0, max(x1) as x1, min(y) as y0, max(y) + 1 as y1, cast(sum(x1 - x0) as bigint) as pixels from region group by label", "lot", "bld", more=_PIXELS + ", " + _REGIONS)[5:])
def sp_51(spark, sf):
    """Regions of the mask over all tiles: extent and pixels."""
    r = raster.labelled(_mask(spark, sf))
    return r.groupBy("label").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.sum(F.col("x1") - F.col("x0")).alias("pixels")).drop("label")


@query("sp_50_vectorised", "with recursive " + fx.sql("""select x0, y0, pixels, border from (select label, min(x0) as x0, min(y) as y0, cast(sum(x1 - x0) as bigint) as pixels from region group by label) join
  (select label, cast(count(*) as bigint) as border from (select label, a, b, c, d from (select label, unnest([x, x + 1, x, x]) as a, unnest([y, y, y, y + 1]) as b, unnest([x, x + 1, x + 1, x + 1]) as c, unnest([y + 1, y + 1, y, y + 1]) as d from (select label, y, unnest(range(x0, x1)) as x from region)) group by all having count(*) = 1) group by label) using (label)""", "lot", "bld", more=_PIXELS + ", " + _REGIONS)[5:])
def sp_50_vectorised(spark, sf):
    """Regions as polygons with holes: corner, area and length of border."""
    p = raster.regions(raster.labelled(_mask(spark, sf)))
    after = lambda r: F.concat(F.slice(r, F.lit(2), F.size(r) - 1), F.slice(r, 1, 1))
    length = F.aggregate(F.flatten(F.transform("rings", lambda r: F.zip_with(r, after(r), lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])))), F.lit(0.0), lambda s, d: s + d)
    least = lambda c: F.array_min(F.transform(F.element_at("rings", 1), lambda v: v[c])).cast("long").alias(f"{c}0")
    return p.select(least("x"), least("y"), rings.area(F.col("rings")).cast("long").alias("pixels"), length.cast("long").alias("border"))


# ------------------------------------------------------------------ meshes

_CELLS = """cell as (select a, b, h from (select cast(floor(x0 / 120) as bigint) as a, cast(floor(y0 / 120) as bigint) as b, cast(sum(o_custkey % 5) % 6 as double) as h from geo group by 1, 2) where h > 0),
 wall as (select c.a, c.b, c.h, coalesce(n.h, 0) as low, px, py, qx, qy from cell c cross join (values (1, 0, 1, 0, 1, 1), (-1, 0, 0, 1, 0, 0), (0, 1, 1, 1, 0, 1), (0, -1, 0, 0, 1, 0)) d(dx, dy, px, py, qx, qy) left join cell n on n.a = c.a + dx and n.b = c.b + dy where c.h > coalesce(n.h, 0)),
 foot as (select row_number() over () as id, a + px as x, b + py as y, low, h from wall union all select row_number() over () + 1000000000, a + qx, b + qy, low, h from wall),
 level as (select distinct a + i as x, b + j as y, h as z from cell, range(0, 2) t(i), range(0, 2) s(j)),
 seg as (select count(*) as feet, sum(n) as cuts from (select id, count(z) as n from foot left join level on foot.x = level.x and foot.y = level.y and z > low and z < h group by id))"""


@query("sp_48_heightfield", fx.sql("select cells, cells * 4 + feet + cuts as triangles, volume, 0 as open_edges from (select count(*) as cells, sum(h) as volume from cell), seg", "geo", more=_CELLS))
def sp_48(spark, sf):
    """A relief as one closed surface: walls between equal heights are gone, steps stay, no edge is open."""
    cells = fx.geo(spark, sf).groupBy(F.floor(F.col("x0") / 120).alias("a"), F.floor(F.col("y0") / 120).alias("b")).agg((F.sum(F.col("o_custkey") % 5) % 6).alias("h"))
    return mesh.closed(mesh.heightfield(cells, "a", "b", "h")).drop("thick_edges")


# ------------------------------------------------------------------ vector files

_BOX = (1000.0, 100.0, 6000.0, 900.0)


def _multi(spark, sf):
    """L-shaped parcels, every fifth with a second part, and their owners."""
    at = lambda dx, dy: F.struct((F.col("x0") + dx).cast("double").alias("x"), (F.col("y1") + dy).cast("double").alias("y"))
    second = F.array(F.array(at(0, 1), at(3, 1), at(3, 3), at(0, 3)))
    both = _poly(spark, sf).join(fx.geo(spark, sf), "fkey")
    return both.select("fkey", F.col("o_custkey").alias("owner"), F.when(F.col("fkey") % 5 == 0, F.array(F.col("rings"), second)).otherwise(F.array("rings")).alias("polygons"))


@query("sc_23_vector_scan", fx.sql(f"""select f.format, g.fkey, case when g.fkey % 5 = 0 then 2 else 1 end as parts, area + case when g.fkey % 5 = 0 then 6 else 0 end as area from (values ('shapefile'), ('geojson')) f(format), geo g join
  (select fkey, max(case when r = 1 then abs(s) end) - coalesce(sum(case when r > 1 then abs(s) end), 0) as area from ringa group by fkey) a on g.fkey = a.fkey
  where o_custkey > 40 and x0 <= {_BOX[2]} and x1 >= {_BOX[0]} and y0 <= {_BOX[3]} and y1 + case when g.fkey % 5 = 0 then 3 else 0 end >= {_BOX[1]}""", "geo", more=_POLY))
def sc_23(spark, sf):
    """Parcels written as shapefiles and as GeoJSON, and scanned by extent and attribute: parts and areas with holes."""
    vector.register(spark)
    p, shp, text = _multi(spark, sf), lineage.scratch(spark), lineage.scratch(spark)
    vector.write_shapefiles(p, shp, "polygons", {"fkey": 12, "owner": 12})
    closed = F.transform("polygons", lambda poly: F.transform(poly, lambda r: F.transform(F.concat(rings.opened(r), F.slice(r, 1, 1)), lambda v: F.array(v["x"], v["y"]))))
    files.geojson(p.select("fkey", "owner", F.struct(F.lit("MultiPolygon").alias("type"), closed.alias("coordinates")).alias("geometry")), "geometry").write.text(text)
    out = None
    for name, path in (("shapefile", shp), ("geojson", text)):
        scan = spark.read.format(name).schema(f"fkey long, owner long, polygons {vector.POLYGONS}").option("bbox", ",".join(map(str, _BOX))).load(path).where("owner > 40")
        sizes = F.aggregate(F.transform("polygons", rings.area), F.lit(0.0), lambda s, a: s + a)
        one = scan.select(F.lit(name).alias("format"), "fkey", F.size("polygons").alias("parts"), sizes.alias("area"))
        out = one if out is None else out.unionByName(one)
    return out


@query("sc_28_geometry_decode", fx.sql("""select g.fkey, case when g.fkey % 5 = 0 then 2 else 1 end as parts, area + case when g.fkey % 5 = 0 then 6 else 0 end as area from geo g join
  (select fkey, max(case when r = 1 then abs(s) end) - coalesce(sum(case when r > 1 then abs(s) end), 0) as area from ringa group by fkey) a on g.fkey = a.fkey where g.fkey % 7 <> 6""", "geo", more=_POLY))
def sc_28(spark, sf):
    """Polygons and multipolygons as text and as hexadecimal bytes of either order, decoded; rows that are none are dropped."""
    m = _multi(spark, sf).withColumn("open", F.transform("polygons", lambda p: F.transform(p, rings.opened)))
    both = geometry.encoded(geometry.encoded(m, "polygons", "little"), "polygons", "big", big=True)
    k = F.col("fkey") % 7
    form = F.when(k == 6, "POINT (1 2)").when(k % 3 == 0, geometry.as_text(F.col("open"))).when(k % 3 == 1, F.hex("little")).otherwise(F.lower(F.hex("big")))
    g = geometry.decoded(both.select("fkey", form.alias("g")), "g").where("polygons is not null")
    return g.select("fkey", F.size("polygons").alias("parts"), F.aggregate(F.transform("polygons", rings.area), F.lit(0.0), lambda s, a: s + a).alias("area"))


# ------------------------------------------------------------------ regions by layers

#: Zones are diamonds with a diamond hole, around places of suppliers; quarters are strips of nations that overlap a little.
_LAYERS = """zone as (select s_suppkey as place, s_name as name, s_suppkey * 977 % 10000 + 0.37 as cx, s_suppkey * 613 % 2400 + 0.61 as cy, 150.0 + s_suppkey % 7 * 40 as big from supplier),
 quarter as (select n_nationkey as place, n_name as name, n_nationkey * 400 - 0.41 as a, n_nationkey * 400 + 430.43 as b from nation)"""


def _layers(spark, sf):
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    cx, cy, big = s * 977 % 10000 + 0.37, s * 613 % 2400 + 0.61, s % 7 * 40 + 150.0
    diamond = lambda r: F.array(point(cx - r, cy), point(cx, cy - r), point(cx + r, cy), point(cx, cy + r))
    zone = fx.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), s.alias("place"), F.array(diamond(big), diamond(big / 3)).alias("rings"))
    a, b, low, high = n * 400 - 0.41, n * 400 + 430.43, F.lit(-1.0), F.lit(1e6)
    quarter = fx.table(spark, sf, "nation").select(F.col("n_name").alias("name"), n.alias("place"), F.array(F.array(point(a, low), point(b, low), point(b, high), point(a, high))).alias("rings"))
    return [("zone", zone, lambda c: c), ("quarter", quarter, lambda c: F.concat(F.lit("Q "), F.lower(c)))]


@query("sp_46_layer_tags", fx.sql("""select fkey, coalesce(arg_min(z.name, z.place), '(None)') as zone, coalesce(arg_min('Q ' || lower(q.name), q.place), '(None)') as quarter from inner_ p left join zone z on abs(x - cx) + abs(y - cy) < big and not abs(x - cx) + abs(y - cy) < big / 3 left join quarter q on a < x and x < b group by fkey""", "geo", more=_POLY + ", " + _BINNED + ", " + _LAYERS))
def sp_46_layers(spark, sf):
    """Parcels tagged with the zones and quarters that hold a point inside them, holes left out."""
    p = _poly(spark, sf).select("fkey", rings.inside_point(F.col("rings")).alias("p")).select("fkey", "p.x", "p.y")
    return regions.tagged(p, "fkey", "x", "y", _layers(spark, sf)).select("fkey", "zone", "quarter")


# ------------------------------------------------------------------ condominiums

_ROLLS = """r as (select fkey, l_partkey, l_linenumber, category[1] as boro, l_suppkey % 17 as condo, l_partkey % 9 as block, case when l_suppkey % 17 < 3 then 'plain' when l_linenumber = 7 and l_suppkey % 17 <> 5 and (l_partkey % 9 < 6 or l_suppkey % 17 = 6) then 'billing' else 'unit' end as kind, land, total, qty % 11 as area, category[2] as tax from rec),
 ub as (select boro, condo, block, sum(land) as land, sum(total) as total, count(*) as n from r where kind = 'unit' group by 1, 2, 3), bb as (select distinct boro, condo, block from r where kind = 'billing'), bc as (select distinct boro, condo from bb),
 pool as (select boro, condo, sum(land) as land, sum(total) as total, sum(n) as n from ub anti join bb using (boro, condo, block) group by 1, 2),
 cls as (select boro, condo, arg_min(tax, [-t, ascii(tax)]) as tax from (select boro, condo, tax, sum(total) as t from r where kind = 'unit' group by 1, 2, 3) group by 1, 2),
 bill as (select *, case when sum(area) over k > 0 then area * 1.0 / sum(area) over k else 1.0 / count(*) over k end as sk, case when sum(area) over c > 0 then area * 1.0 / sum(area) over c else 1.0 / count(*) over c end as sc from r where kind = 'billing' window k as (partition by boro, condo, block), c as (partition by boro, condo))"""


@query("sp_43_condo_lots", fx.sql("""select fkey, l_partkey, boro, condo, kind, round(land, 4) as land, round(total, 4) as total, round(n_units, 6) as n_units, tax from (
  select fkey, l_partkey, boro, condo, kind, cast(land as double) as land, cast(total as double) as total, 0.0 as n_units, tax from r where kind = 'plain'
  union all select fkey, l_partkey, b.boro, b.condo, kind, b.land + coalesce(o.land, 0) * sk + coalesce(p.land, 0) * sc, b.total + coalesce(o.total, 0) * sk + coalesce(p.total, 0) * sc, coalesce(o.n, 0) * sk + coalesce(p.n, 0) * sc, coalesce(cls.tax, b.tax) from bill b left join ub o using (boro, condo, block) left join pool p on b.boro = p.boro and b.condo = p.condo left join cls on b.boro = cls.boro and b.condo = cls.condo
  union all select null, null, boro, condo, 'orphan', sum(land), sum(total), sum(n), null from ub anti join bc using (boro, condo) group by boro, condo)""", "rec", more=_ROLLS))
def sp_43_lots(spark, sf):
    """Units' values on the lots that are billed for them: same block first, the rest over all, and what no lot takes."""
    r = fx.rec(spark, sf).withColumns({"boro": F.substring("category", 1, 1), "tax": F.substring("category", 2, 1), "condo": F.col("l_suppkey") % 17, "block": F.col("l_partkey") % 9, "area": F.col("qty") % 11})
    has_lot = (F.col("l_linenumber") == 7) & (F.col("condo") != 5) & ((F.col("block") < 6) | (F.col("condo") == 6))
    r = r.withColumn("kind", F.when(F.col("condo") < 3, "plain").when(has_lot, "billing").otherwise("unit")).select("fkey", "l_partkey", "boro", "condo", "block", "kind", "land", "total", "area", "tax")
    lots, lost = condos.to_lots(r, ["boro", "condo"], "block", "kind", ["land", "total"], "area", "tax")
    lost = lost.select(F.lit(None).cast("long").alias("fkey"), F.lit(None).cast("long").alias("l_partkey"), "boro", "condo", F.lit("orphan").alias("kind"), F.col("land").cast("double").alias("land"), F.col("total").cast("double").alias("total"), F.col("n_units").cast("double").alias("n_units"), F.lit(None).cast("string").alias("tax"))
    every = lots.select(*lost.columns).unionByName(lost)
    return every.withColumns({c: F.round(c, d) for c, d in (("land", 4), ("total", 4), ("n_units", 6))})


# ------------------------------------------------------------------ collapse

_RULES = collapse.Rules(reach=1.0, ground_ratio=1.2, complex_ratio=1.5, child=1500, parent=1600, complex_units=3, complex_children=2, rest=1300, support=2500, anchor_units=5)


def _accounts(spark, sf):
    """Footprints as accounts: kind and name from the owner, so that neighbours often share them."""
    k, c = F.col("fkey"), F.col("o_custkey")
    block = F.floor(F.col("x0") / 400) * 7 + F.floor(F.col("y0") / 80)
    family = F.when((k + block) % 5 != 4, F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w in ("OAK", "ELM", "PINE")]), (block % 3 + 1).cast("int")), F.when(c % 4 == 0, "COURT").when(c % 4 == 1, "PARK")))
    kind = F.when(c % 3 == 0, "parcel").otherwise("condo")
    p = fx.par(spark, sf).where("exempt = 0")
    return p.select(k.alias("id"), kind.alias("kind"), family.alias("family"), F.coalesce(F.split(family, " "), F.array().cast("array<string>")).alias("tokens"), (c % 6 == 0).alias("support"), "land", "impr", F.col("area").cast("double").alias("area"), F.col("n").alias("units"), *[F.col(b).cast("double").alias(b) for b in GEO])


_SUMS = "cast(sum(land) as bigint) as land, cast(sum(impr) as bigint) as impr, cast(sum(n) as bigint) as units"


@query("sp_45_seven_passes", fx.sql(f"""select pass, land, impr, units from (select {_SUMS} from par where exempt = 0), (select unnest(['platted', 'on_ground', 'campuses', 'complexes', 'remaining', 'supports', 'clusters']) as pass)""", "par"))
def sp_45_seven(spark, sf):
    """Seven passes from accounts to the ground they stand on; after each, values and units add up to what there was."""
    lots = fx.lot(spark, sf).select("lot", *GEO)
    out = None
    for name, rows in collapse.passes(_accounts(spark, sf), lots, _RULES):
        one = rows.agg(F.lit(name).alias("pass"), F.sum("land").alias("land"), F.sum("impr").alias("impr"), F.sum("units").alias("units"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ overlays of any polygons


def _sloped(spark, sf):
    """Roads in all directions: class by nation, lanes known for some."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    kinds = F.array(*[F.lit(c) for c in (*roads.HALF_WIDTHS, "track")])
    ax, ay = (k * 61 % 250 * 40).cast("double"), (k * 7 % 60 * 40 + 15).cast("double")
    bx, by = ax + 200 + k % 9 * 25, ay + (k * 13 % 17 - 8) * 22
    half = roads.half_width(F.get(kinds, (n % 13).cast("int")), F.when(k % 4 != 0, (k % 7).cast("string")).otherwise("many"))
    return fx.table(spark, sf, "supplier").select(k.alias("road"), roads.strip(ax, ay, bx, by, half).alias("rings"))


@query("sp_12_sloped_roads", None)
def sp_12_sloped(spark, sf):
    """L-shaped parcels with holes less roads of any direction, as wide as their class or lanes; parts under 5 are left out."""
    left = roads.without_roads(_poly(spark, sf), "fkey", _sloped(spark, sf), least=5.0)
    return left.groupBy("fkey").agg(F.count("*").alias("parts"), F.round(F.sum(rings.area(F.col("rings"))), 4).alias("area"))


@query("sp_10_zone_shares", None)
def sp_10_zones(spark, sf):
    """The shapes that parcels share with the zones around them (diamonds with a hole)."""
    (_, zone, _), _ = _layers(spark, sf)
    both = overlay.taken(_poly(spark, sf), zone.select("rings"), "fkey", "intersection")
    return both.groupBy("fkey").agg(F.count("*").alias("parts"), F.round(F.sum(rings.area(F.col("rings"))), 4).alias("area"))


# ------------------------------------------------------------------ groups of several kinds

@query("sp_39_mixed_components", None)
def sp_39(spark, sf):
    """Groups of units that touch, of common areas on which several lie, and of parents in whose holes groups without one lie."""
    units = _pairs(spark, sf, touch=True).where("o_custkey % 20 = gcust % 20").select(F.col("fkey").alias("u"), F.col("gkey").alias("v"))
    lots = fx.lot(spark, sf).select("lot", *[F.col(c).alias("l" + c) for c in GEO])
    areas = spatial.overlapping(fx.geo(spark, sf).select("fkey", *GEO), lots, GEO, LOT, touch=True).select(F.col("fkey").alias("unit"), F.col("lot").alias("area"))
    (_, zone, _), _ = _layers(spark, sf)
    v = lambda c: F.transform(F.col("hole"), lambda p: p[c])
    holes = zone.select("place", F.col("rings")[1].alias("hole")).select("place", "hole", *[f(v(c)).alias(f"h{c}{i}") for c in "xy" for i, f in enumerate((F.array_min, F.array_max))])
    mid = fx.geo(spark, sf).select(F.col("fkey").alias("unit"), ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    parents = spatial.containing(mid, holes, "mx", "my", ("hx0", "hx1", "hy0", "hy1")).where(rings.holds(F.array("hole"), F.col("mx"), F.col("my"))).select("unit", F.col("place").alias("parent"))
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"{kind}s")
    return components.mixed(units, areas, parents).groupBy("root").agg(count("unit"), count("area"), count("parent")).select(F.col("root.id").alias("root"), "units", "areas", "parents")
