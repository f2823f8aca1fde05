"""Percentile, break, scale, quality, parking-total and areal queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terraledger.operators import metrics, quality, ranks, regions, spatial, stats
from terraledger.operators.lineage import stored
from terraledger.plans import fixtures as fx
from terraledger.plans.registry import query

GEO, BLD, LOT = ("x0", "x1", "y0", "y1"), ("bx0", "bx1", "by0", "by1"), ("lx0", "lx1", "ly0", "ly1")


@query("sx_01_percentile", fx.sql("select round(quantile_cont(land, 0.5), 6) as p50, round(quantile_cont(land, 0.99), 6) as p99 from roll where land > 0", "roll"))
def sx_01(spark, sf):
    p = ranks.percentiles(fx.roll(spark, sf).where("land > 0"), ["land"], [50, 99])
    return p.select(F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p99"))


def _qs(ps):
    return ", ".join(str(p / 100) for p in ps)


@query("sx_02_quantile_breaks", fx.sql(f"select i, round(b, 6) as b from (select unnest(list_sort(list_distinct(q))) as b, generate_subscripts(list_sort(list_distinct(q)), 1) as i from (select quantile_cont(land, [{_qs([20, 40, 60, 80])}]) as q from roll))", "roll"))
def sx_02(spark, sf):
    b = ranks.percentiles(fx.roll(spark, sf), ["land"], stats.break_stops(5)).select(stats.rising(F.col("p")).alias("b"))
    return b.select(F.posexplode("b").alias("i", "b")).select((F.col("i") + 1).cast("long").alias("i"), F.round("b", 6).alias("b"))


@query("sx_03_ramp_breaks", fx.sql(f"select i, round(b, 6) as b from (select unnest(q) as b, generate_subscripts(q, 1) as i from (select quantile_cont(total, [0.08, 0.2, 0.35, 0.5, 0.65, 0.8, 0.93, 0.995]) as q from roll))", "roll"))
def sx_03(spark, sf):
    b = ranks.percentiles(fx.roll(spark, sf), ["total"], stats.RAMP)
    return b.select(F.posexplode("p").alias("i", "b")).select((F.col("i") + 1).cast("long").alias("i"), F.round("b", 6).alias("b"))


@query("sx_04_fallback_breaks", fx.sql("select i, round(lo + (hi - lo) * i / 5.0, 6) as b from (select min(land) as lo, max(land) as hi from roll), range(1, 5) t(i)", "roll"))
def sx_04(spark, sf):
    one = fx.roll(spark, sf).agg(F.min("land").alias("lo"), F.max("land").alias("hi"))
    return one.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("i"), "lo", "hi").select("i", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 5.0, 6).alias("b"))


@query("sx_05_log_axis", fx.sql("select i, round(exp(ln(greatest(lo, hi * 1e-3, 1e-6)) + (ln(hi) - ln(greatest(lo, hi * 1e-3, 1e-6))) * i / 4.0), 4) as b from (select min(land) as lo, max(land) as hi from roll), range(0, 5) t(i)", "roll"))
def sx_05(spark, sf):
    one = fx.roll(spark, sf).agg(F.min("land").alias("lo"), F.max("land").alias("hi"))
    lo = F.log(F.greatest(F.col("lo").cast("double"), F.col("hi") * 1e-3, F.lit(1e-6)))
    return one.select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("i")).select("i", F.round(F.exp(lo + (F.log("hi") - lo) * F.col("i") / 4.0), 4).alias("b"))


@query("sx_06_colour_domain", fx.sql("select category, round(coalesce(quantile_cont(land, 0.01), 0), 6) as lo, round(coalesce(quantile_cont(land, 0.999), max(land), 1), 6) as hi from roll group by category", "roll"))
def sx_06(spark, sf):
    p = ranks.percentiles(fx.roll(spark, sf), ["land"], [1, 99.9, 100], ["category"])
    return p.select("category", F.round(F.coalesce(F.col("p")[0], F.lit(0)), 6).alias("lo"), F.round(F.coalesce(F.col("p")[1], F.col("p")[2], F.lit(1)), 6).alias("hi"))


@query("sx_07_step_bins", fx.sql("select bin, count(*) as n from (select case when land >= 80000 then 4 when land >= 40000 then 3 when land >= 20000 then 2 when land >= 10000 then 1 else 0 end as bin from roll) group by bin", "roll"))
def sx_07(spark, sf):
    cuts = F.array(*[F.lit(x) for x in (10000, 20000, 40000, 80000)])
    return fx.roll(spark, sf).groupBy(stats.step_bin(F.col("land"), cuts).alias("bin")).agg(F.count("*").alias("n"))


@query("sx_08_ramp", fx.sql("select fkey, round(case when land <= 0 then 0 when land <= 50000 then land * 10.0 / 50000 when land <= 200000 then 10 + (land - 50000) * 90.0 / 150000 else 100 end, 6) as v from roll", "roll"))
def sx_08(spark, sf):
    return fx.roll(spark, sf).select("fkey", F.round(stats.ramp(F.col("land"), [(0, 0), (50000, 10), (200000, 100)]), 6).alias("v"))


@query("sx_09_mad_cap", fx.sql("""select max(case when s.scale > 0 and abs(l - mid) <= 3 * s.scale then v end) as cap, count(*) filter (where s.scale > 0 and abs(l - mid) > 3 * s.scale) as outliers from (select ln(1 + greatest(v, 0)) as l, v from lv) x,
  (select quantile_cont(ln(1 + greatest(v, 0)), 0.5) as mid from lv) m, (select quantile_cont(abs(ln(1 + greatest(v, 0)) - mid), 0.5) * 1.4826 as scale from lv, (select quantile_cont(ln(1 + greatest(v, 0)), 0.5) as mid from lv)) s""", "roll", more="lv as (select land - 3000 as v from roll)"))  # fmt: skip
def sx_09(spark, sf):
    return stats.mad_cap(fx.roll(spark, sf).select((F.col("land") - 3000).alias("v")), "v", 3)


@query("sx_11_height_autoscale", fx.sql("""select unit, round(m, 8) as multiplier from (select unit, 1000 / (f * p99) as m from (select quantile_cont(total, 0.99) as p99 from roll), (values ('centimeters', 0.01), ('meters', 1.0), ('kilometers', 1000.0)) t(unit, f))
  order by case when m between 1 and 100 then abs(log10(greatest(1e-12, m)) - 1) else 1000000 + least(abs(m - 1), abs(m - 100)) * 1000 end, list_position(['centimeters', 'meters', 'kilometers'], unit) limit 1""", "roll"))  # fmt: skip
def sx_11(spark, sf):
    p = ranks.percentiles(fx.roll(spark, sf), ["total"], [99]).select(F.col("p")[0].alias("p99"))
    units = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(u).alias("unit"), F.lit(f).alias("f")) for i, (u, f) in enumerate(stats.UNITS)]))
    m = p.select("p99", units.alias("u")).select("u.i", "u.unit", (F.lit(stats.CAP_METERS) / (F.col("u.f") * F.col("p99"))).alias("m"))
    return m.agg(F.min_by(F.struct("unit", "m"), F.struct(stats.unit_score(F.col("m")), "i")).alias("b")).select("b.unit", F.round("b.m", 8).alias("multiplier"))


@query("sx_12_render_percentiles", fx.sql("select field, round(p20, 6) as p20, round(p50, 6) as p50, round(p99, 6) as p99 from (" + " union all ".join(f"select '{c}' as field, quantile_cont({c}, 0.2) as p20, quantile_cont({c}, 0.5) as p50, quantile_cont({c}, 0.99) as p99 from roll" for c in ("land", "impr", "total")) + ")", "roll"))
def sx_12(spark, sf):
    p = ranks.percentiles(fx.roll(spark, sf), ["land", "impr", "total"], [20, 50, 99])
    return p.select("field", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p20", "p50", "p99"))])


@query("sx_13_category_breaks", fx.sql("select category, round(quantile_cont(impr, 0.25), 6) as q1, round(quantile_cont(impr, 0.75), 6) as q3 from roll where impr >= 0 group by category having count(*) >= 2", "roll"))
def sx_13(spark, sf):
    p = ranks.percentiles(fx.roll(spark, sf).where("impr >= 0"), ["impr"], [25, 75], ["category"]).where("n >= 2")
    return p.select("category", F.round(F.col("p")[0], 6).alias("q1"), F.round(F.col("p")[1], 6).alias("q3"))


@query("sx_14_degenerate_guard", "select r_regionkey, case when min(n_regionkey) = max(n_regionkey) then 0 else min(n_regionkey) end as lo, case when min(n_regionkey) = max(n_regionkey) then 1 else max(n_regionkey) end as hi from nation join region on n_regionkey = r_regionkey group by r_regionkey")
def sx_14(spark, sf):
    n = fx.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.min("n_regionkey").alias("a"), F.max("n_regionkey").alias("b"))
    flat = F.col("a") == F.col("b")
    return n.select("r_regionkey", F.when(flat, 0).otherwise(F.col("a")).alias("lo"), F.when(flat, 1).otherwise(F.col("b")).alias("hi"))


@query("sx_15_nearest_rank", "select user_id, list_sort(list(value))[least(cast(floor(count(value) * 0.5) as bigint) + 1, count(value))] as mid, list_sort(list(value))[least(cast(floor(count(value) * 0.95) as bigint) + 1, count(value))] as p95 from events group by user_id")
def sx_15(spark, sf):
    return fx.table(spark, sf, "events").groupBy("user_id").agg(stats.nearest_rank("value", 0.5).alias("mid"), stats.nearest_rank("value", 0.95).alias("p95"))


def _knn(who, donors, k):
    """SQL: the k nearest donors of each row of ``who``: fkey, gkey, d2; ties go to the smaller key."""
    return f"""near as (select fkey, v % 100000000 as gkey, v // 100000000 as d2 from (select fkey, unnest(vs) as v from
  (select a.fkey, min(((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)) * 100000000 + b.fkey, {k}) as vs from {who} a, {donors} b where a.fkey <> b.fkey group by a.fkey)))"""


def _neighbours(who, donors, k, value):
    """fkey, d2, r: the k nearest donors of each parcel, with their ``value``."""
    b = donors.select(F.col("fkey").alias("gkey"), F.col("x0").alias("gx"), F.col("y0").alias("gy"), value.alias("r"))
    return spatial.nearest(who.select("fkey", "x0", "y0"), b, k, "fkey", "gkey", "x0", "y0", "gx", "gy", others=True).select("fkey", "d2", "r")


@query("sx_16_knn_smoothing", fx.sql("""select p.fkey, round(case when s.v is null then p.v when p.v is null then s.v else 0.25 * p.v + 0.75 * s.v end, 4) as v from rate p left join
  (select near.fkey, sum(q.v / greatest(sqrt(d2), 10)) / sum(case when q.v is not null then 1 / greatest(sqrt(d2), 10) end) as v from near join rate q on near.gkey = q.fkey group by near.fkey) s on p.fkey = s.fkey""", "par", more="rate as (select fkey, x0, y0, case when land > 0 then land * 1.0 / area end as v from par), " + _knn("rate", "rate", 10)))  # fmt: skip
def sx_16(spark, sf):
    """Land rates drawn to the weighted mean of the ten nearest; those of unknown value are left out after the choice."""
    r = stored(fx.par(spark, sf).select("fkey", "x0", "y0", F.when(F.col("land") > 0, F.col("land") / F.col("area")).alias("v")))
    w = F.when(F.col("r").isNotNull(), F.lit(1) / F.greatest(F.sqrt("d2"), F.lit(10)))
    s = _neighbours(r, r, 10, F.col("v")).groupBy("fkey").agg((F.sum(F.col("r") * w) / F.sum(w)).alias("s"))
    v = F.when(F.col("s").isNull(), F.col("v")).when(F.col("v").isNull(), F.col("s")).otherwise(F.col("v") * 0.25 + F.col("s") * 0.75)
    return r.join(s, "fkey", "left").select("fkey", F.round(v, 4).alias("v"))


@query("sx_17_knn_impute", fx.sql("""select fkey, round(round(least(rate * area, 0.7 * total), 6)) as imputed from (select p.fkey, p.land, p.total, p.area, quantile_cont(q.land * 1.0 / q.area, 0.5) as rate from near join par p on near.fkey = p.fkey join par q on near.gkey = q.fkey group by p.fkey, p.land, p.total, p.area)
  where least(rate * area, 0.7 * total) > land""", "par", more="poor as (select * from par where land * 5 < total), donor as (select * from par where land > 0 and land * 5 >= total and area >= 500), " + _knn("poor", "donor", 15)))  # fmt: skip
def sx_17(spark, sf):
    """Land of parcels with hardly any, at the median rate of 15 donors, at most 0.7 of the total and only where it is more."""
    p = stored(fx.par(spark, sf).select("fkey", "x0", "y0", "land", "total", "area"))
    donors = p.where("land > 0 and land * 5 >= total and area >= 500")
    near = _neighbours(p.where("land * 5 < total"), donors, 15, F.col("land") / F.col("area"))
    rates = near.groupBy("fkey").agg(F.expr("percentile(r, 0.5)").alias("rate"))  # 15 values a parcel
    v = F.least(F.col("rate") * F.col("area"), F.col("total") * 0.7)
    return p.join(rates, "fkey").withColumn("v", v).where("v > land").select("fkey", F.round(F.round("v", 6)).alias("imputed"))


@query("sx_18_resplit", fx.sql("""select fkey, land as was, cast(least(round(round(mid * area, 6)), total) as bigint) as land, total - cast(least(round(round(mid * area, 6)), total) as bigint) as impr from
  (select p.fkey, p.land, p.total, p.area, quantile_cont(q.land * 1.0 / q.area, 0.5) as mid from near join par p on near.fkey = p.fkey join par q on near.gkey = q.fkey group by p.fkey, p.land, p.total, p.area) where land * 1.0 / area / mid > 3""", "par",
  more="merged as (select * from par where n >= 4), donor as (select * from par where n < 4 and land > 0 and area >= 500 and category <> 'NO'), " + _knn("merged", "donor", 15)))
def sx_18(spark, sf):
    """Merged parcels whose land rate is over three times their neighbours' median get that rate; the total stays."""
    p = stored(fx.par(spark, sf).select("fkey", "x0", "y0", "land", "total", "area", "n", "category"))
    merged, donors = p.where("n >= 4"), p.where("n < 4 and land > 0 and area >= 500 and category <> 'NO'")
    rates = _neighbours(merged, donors, 15, F.col("land") / F.col("area")).groupBy("fkey").agg(F.expr("percentile(r, 0.5)").alias("mid"))
    hot = merged.join(rates, "fkey").where(F.col("land") / F.col("area") / F.col("mid") > 3)
    new = F.least(F.round(F.round(F.col("mid") * F.col("area"), 6)), F.col("total")).cast("bigint")
    return hot.select("fkey", F.col("land").alias("was"), new.alias("land"), (F.col("total") - new).alias("impr"))


@query("sx_20_opacity", "select z, round(case when z <= 9 then 0.2 when z <= 13 then 0.2 + (z - 9) * 0.8 / 4 else 1 end, 6) as opacity from range(5, 17) t(z)")
def sx_20(spark, sf):
    return spark.range(5, 17).select(F.col("id").alias("z"), F.round(stats.ramp(F.col("id"), [(9, 0.2), (13, 1)]), 6).alias("opacity"))


@query("ag_08_land_totals", fx.sql("select case when grouping(region) = 0 then 'region' when grouping(category) = 0 then 'category' else '(all)' end as field, coalesce(region, category, '(all)') as name, cast(sum(land) as bigint) as land, cast(sum(case when exempt = 0 then land else 0 end) as bigint) as non_exempt from par group by grouping sets ((), (region), (category))", "par"))
def ag_08(spark, sf):
    return regions.land_totals(fx.par(spark, sf), ["region", "category"])


@query("ag_38_taxable_share", fx.sql("select round(sum(case when category in ('AF', 'AO') then land else 0 end) * 1.0 / sum(case when exempt = 0 then land else 0 end), 6) as share from par where region in ('FRANCE', 'CHINA')", "par"))
def ag_38(spark, sf):
    p = fx.par(spark, sf).where(F.col("region").isin("FRANCE", "CHINA"))
    parking = F.sum(F.when(F.col("category").isin("AF", "AO"), F.col("land")).otherwise(0))
    return p.agg(F.round(parking / F.sum(F.when(F.col("exempt") == 0, F.col("land")).otherwise(0)), 6).alias("share"))


@query("ag_39_scope_totals", fx.sql("select region, cast(sum(case when total <> 0 then total else land + impr end) as bigint) as value, round(sum(area) / 43560.0, 4) as acres from par where district in ('EUROPE', 'ASIA') group by region", "par"))
def ag_39(spark, sf):
    p = fx.par(spark, sf).where(F.col("district").isin("EUROPE", "ASIA"))
    return p.groupBy("region").agg(F.sum(F.when(F.col("total") != 0, F.col("total")).otherwise(F.col("land") + F.col("impr"))).alias("value"), F.round(F.sum("area") / 43560.0, 4).alias("acres"))


@query("ag_43_quality_suite", fx.sql("""select unnest(['rows', 'unique_key', 'land_filled', 'no_negative', 'total_adds_up', 'area_filled']) as name, unnest([count(*) > 100, count(distinct fkey) = count(*), avg(case when land > 0 then 1.0 else 0.0 end) >= 0.85,
  count(*) filter (where total < 0) = 0, count(*) filter (where land + impr <> total) = 0, avg(case when area > 0 then 1.0 else 0.0 end) >= 0.99]) as ok from par""", "par"))  # fmt: skip
def ag_43(spark, sf):
    c = F.col
    return quality.suite(fx.par(spark, sf), {
        "rows": F.count("*") > 100, "unique_key": F.count_distinct("fkey") == F.count("*"), "land_filled": quality.share(c("land") > 0) >= 0.85,
        "no_negative": F.count_if(c("total") < 0) == 0, "total_adds_up": F.count_if(c("land") + c("impr") != c("total")) == 0, "area_filled": quality.share(c("area") > 0) >= 0.99})


_PARK = """park as (select lot.*, (x1 - x0) * (y1 - y0) as a, case lot % 5 when 0 then 'structure' when 1 then 'uncertain' when 2 then 'excluded' else 'surface' end as kind, p_size * 10 as rate, lot % 4 = 0 as is_exempt from lot)"""


def _park(spark, sf):
    k = F.col("lot")
    kind = F.when(k % 5 == 0, "structure").when(k % 5 == 1, "uncertain").when(k % 5 == 2, "excluded").otherwise("surface")
    return fx.lot(spark, sf).withColumns({"a": metrics.rect_area(*GEO), "kind": kind, "rate": F.col("p_size") * 10, "is_exempt": k % 4 == 0})


@query("ag_35_parking_totals", fx.sql("select cast(sum(a) as bigint) as area, cast(sum(a * rate) as bigint) as value, cast(sum(case when not is_exempt then a * rate else 0 end) as bigint) as taxable, round(avg(case when not is_exempt and rate > 0 then rate end), 6) as mean_rate from park", "lot", more=_PARK))
def ag_35(spark, sf):
    v = F.col("a") * F.col("rate")
    return _park(spark, sf).agg(F.sum("a").alias("area"), F.sum(v).alias("value"), F.sum(F.when(~F.col("is_exempt"), v).otherwise(0)).alias("taxable"), F.round(F.avg(F.when(~F.col("is_exempt") & (F.col("rate") > 0), F.col("rate"))), 6).alias("mean_rate"))


@query("ag_36_by_type", fx.sql("select t.kind, count(p.lot) as n, cast(coalesce(sum(p.a), 0) as bigint) as area from (values ('surface'), ('structure'), ('uncertain'), ('excluded'), ('unknown')) t(kind) left join park p on t.kind = p.kind group by t.kind", "lot", more=_PARK))
def ag_36(spark, sf):
    spine = spark.createDataFrame([(k,) for k in ("surface", "structure", "uncertain", "excluded", "unknown")], "kind string")
    g = _park(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.sum("a").alias("area"))
    return F.broadcast(spine).join(g, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("area", F.lit(0)).alias("area"))


@query("cs_10_context", fx.sql("""select lot, case when util and f < 0.5 then 'low' when f < 0.15 then 'low' else 'high' end as context from (select p.lot, p.lot % 3 = 0 as util, coalesce(sum(case when g.fkey is not null then (least(p.x1, g.x1) - greatest(p.x0, g.x0)) * (least(p.y1, g.y1) - greatest(p.y0, g.y0)) end), 0) * 1.0 / p.a as f
  from park p left join geo g on p.x0 < g.x1 and g.x0 < p.x1 and p.y0 < g.y1 and g.y0 < p.y1 group by p.lot, p.a)""", "lot", "geo", more=_PARK))  # fmt: skip
def cs_10(spark, sf):
    p = _park(spark, sf)
    g = fx.geo(spark, sf).select("fkey", F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), F.col("y0").alias("ly0"), F.col("y1").alias("ly1"))
    s = spatial.overlapping(p.select("lot", *GEO), g, GEO, LOT).groupBy("lot").agg(F.sum("shared").alias("s"))
    f = F.coalesce("s", F.lit(0)) / F.col("a")
    return p.join(s, "lot", "left").select("lot", F.when(((F.col("lot") % 3 == 0) & (f < 0.5)) | (f < 0.15), "low").otherwise("high").alias("context"))


@query("sp_35_effective_surface", fx.sql("select lot, round(case when kind in ('structure', 'excluded') then 0 else a * (1 - least(greatest(lot % 13 / 10.0, 0), 1)) end, 4) as surface from park", "lot", more=_PARK))
def sp_35(spark, sf):
    real = F.least(F.greatest(F.col("lot") % 13 / 10.0, F.lit(0)), F.lit(1))
    return _park(spark, sf).select("lot", F.round(F.when(F.col("kind").isin("structure", "excluded"), 0).otherwise(F.col("a") * (1 - real)), 4).alias("surface"))


@query("sp_01_shoelace", fx.sql("select fkey, round((x1 - x0) * (y1 - y0) * 1.0, 4) as area from geo", "geo"))
def sp_01(spark, sf):
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))
    return fx.geo(spark, sf).select("fkey", F.round(spatial.ring_area(ring), 4).alias("area"))


_LL = "select c_custkey, -120 + c_custkey % 100 / 10.0 as lon, 20 + c_custkey % 50 as lat from customer"


def _points(spark, sf):
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select("c_custkey", (k % 100 / 10.0 - 120).alias("lon"), (k % 50 + 20).alias("lat"))


@query("sp_03_reproject", f"""select c_custkey, round(radians(lon) * 6378137.0, 3) as mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) as my,
  round((1 - e * e) * (s / (1 - e * e * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) * 6378137.0 / (2 * (cos(radians(30)) / sqrt(1 - e * e * 0.25))), 3) as ey from (select *, sin(radians(lat)) as s, 0.0818191908426215::double as e from ({_LL}))""")
def sp_03(spark, sf):
    p = _points(spark, sf)
    mx, my = spatial.mercator(F.col("lon"), F.col("lat"))
    _, ey = spatial.equal_area(F.col("lon"), F.col("lat"))
    return p.select("c_custkey", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"), F.round(ey, 3).alias("ey"))


@query("sp_28_tile", f"select c_custkey, cast(floor((lon + 180) / 360 * 4096) as bigint) as tx, cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) as bigint) as ty from ({_LL})")
def sp_28(spark, sf):
    x, y = spatial.tile(F.col("lon"), F.col("lat"), 12)
    return _points(spark, sf).select("c_custkey", x.cast("long").alias("tx"), y.cast("long").alias("ty"))


@query("sp_19_footprint_key", fx.sql("select fkey, cast(cast(floor((x0 + x1) / 2.0) as bigint) as varchar) || ',' || cast(cast(floor((y0 + y1) / 2.0) as bigint) as varchar) as k, md5(x0 || ' ' || y0 || ' ' || x1 || ' ' || y1) as h from geo", "geo"))
def sp_19(spark, sf):
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("string")
    return fx.geo(spark, sf).select("fkey", F.concat_ws(",", mid("x0", "x1"), mid("y0", "y1")).alias("k"), F.md5(F.concat_ws(" ", "x0", "y0", "x1", "y1").cast("binary")).alias("h"))


@query("sp_42_plat_gate", fx.sql("select l_suppkey, count(*) as n from rec where total > 0 group by l_suppkey having count(*) filter (where qty <= 30) * 10 >= count(*) * 6 and count(*) filter (where qty <= 30) >= 2 and bool_or(l_linenumber = 7)", "rec"))
def sp_42(spark, sf):
    stub = F.count_if(F.col("qty") <= 30)
    g = fx.rec(spark, sf).where("total > 0").groupBy("l_suppkey").agg(F.count("*").alias("n"), stub.alias("stubs"), F.bool_or(F.col("l_linenumber") == 7).alias("common"))
    return g.where("stubs * 10 >= n * 6 and stubs >= 2 and common").select("l_suppkey", "n")


@query("sp_44_split_membership", fx.sql("select m, cast(sum(floor(total / k)) as bigint) as v from (select fkey, total, k, (fkey + i) % 100 as m from (select *, 1 + fkey % 3 as k from roll), range(0, 3) t(i) where i < k) group by m", "roll"))
def sp_44(spark, sf):
    r = fx.roll(spark, sf).withColumn("k", F.col("fkey") % 3 + 1)
    e = r.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return e.groupBy(((F.col("fkey") + F.col("i")) % 100).alias("m")).agg(F.sum(F.floor(F.col("total") / F.col("k"))).alias("v"))


@query("sp_46_region_tags", fx.sql("select region, district, count(*) as n, cast(sum(land) as bigint) as land from (select coalesce(case when fkey % 31 <> 0 then region end, '(None)') as region, district, land from par) group by region, district", "par"))
def sp_46(spark, sf):
    p = fx.par(spark, sf).withColumn("region", F.coalesce(F.when(F.col("fkey") % 31 != 0, F.col("region")), F.lit("(None)")))
    return p.groupBy("region", "district").agg(F.count("*").alias("n"), F.sum("land").alias("land"))
