"""The rest of the inventory: smaller variants that reuse the operators of the other plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terraledger.functions import scalar
from terraledger.operators import classify, hexgrid, mesh, metrics, ranks, rollup, spatial, stats
from terraledger.plans import fixtures as fx
from terraledger.plans.registry import query

GEO, BLD = ("x0", "x1", "y0", "y1"), ("bx0", "bx1", "by0", "by1")
_HIT = "x0 < bx1 and bx0 < x1 and y0 < by1 and by0 < y1"


def T(spark, sf, name):
    return fx.table(spark, sf, name)


@query("ag_13_stacked_sum", fx.sql("select floor(x0 / 120) as cx, floor(y0 / 120) as cy, cast(sum(land) as bigint) as land, min_by(category, fkey) as category, count(*) as n from par group by 1, 2", "par"))
def ag_13(spark, sf):
    return fx.par(spark, sf).groupBy(F.floor(F.col("x0") / 120).cast("double").alias("cx"), F.floor(F.col("y0") / 120).cast("double").alias("cy")).agg(F.sum("land").alias("land"), F.min_by("category", "fkey").alias("category"), F.count("*").alias("n"))


@query("ag_16_dominant_by_area", fx.sql("select region, category, weight from (select region, category, cast(sum(area) as bigint) as weight, row_number() over (partition by region order by sum(area) desc, category) as r from par group by 1, 2) where r = 1", "par"))
def ag_16(spark, sf):
    return rollup.dominant(fx.par(spark, sf), ["region"], "category", "area")


@query("ag_18_common_text", "select user_id, event_type from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as r from events group by 1, 2) where r = 1")
def ag_18(spark, sf):
    per = T(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("event_type"))


@query("ag_19_text_by_weight", "select user_id, event_type from (select user_id, event_type, row_number() over (partition by user_id order by value desc, event_type, event_id) as r from events) where r = 1")
def ag_19(spark, sf):
    return T(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("value"), "event_type", "event_id")).alias("event_type"))


@query("ag_21_first_clean", "select user_id, arg_min(case when event_type <> 'view' then event_type end, event_id) filter (where event_type <> 'view') as first from events group by user_id")
def ag_21(spark, sf):
    e = T(spark, sf, "events").withColumn("t", F.when(F.col("event_type") != "view", F.col("event_type")))
    return e.groupBy("user_id").agg(rollup.first_value("t", ["event_id"]).alias("first"))


@query("ag_25_counts", "select event_type, count(*) as n, count(distinct user_id) as users, count(case when value > 50 then 1 end) as high from events group by 1")
def ag_25(spark, sf):
    return T(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"))


@query("ag_28_apportioned", fx.sql(f"select bid, round(sum(land * 1.0 * (least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0)) / area), 4) as land from par join bld on {_HIT} group by bid", "par", "bld"))
def ag_28(spark, sf):
    hit = spatial.overlapping(fx.par(spark, sf), fx.bld(spark, sf), GEO, BLD)
    return hit.groupBy("bid").agg(F.round(F.sum(F.col("land") * F.col("shared") / F.col("area")), 4).alias("land"))


@query("ag_29_area_share", fx.sql("select district, round(100.0 * sum(case when exempt = 1 then area else 0 end) / sum(area), 6) as pct from par group by district", "par"))
def ag_29(spark, sf):
    return fx.par(spark, sf).groupBy("district").agg(F.round(F.sum(F.when(F.col("exempt") == 1, F.col("area")).otherwise(0)) * 100 / F.sum("area"), 6).alias("pct"))


@query("ag_37_category_stats", fx.sql("select category, cast(sum(area) as bigint) as area, cast(sum(case when exempt = 0 then total else 0 end) as bigint) as taxable, round(avg(case when land > 0 then land * 1.0 / area end), 6) as mean_rate from par group by category", "par"))
def ag_37(spark, sf):
    return fx.par(spark, sf).groupBy("category").agg(F.sum("area").alias("area"), F.sum(F.when(F.col("exempt") == 0, F.col("total")).otherwise(0)).alias("taxable"), F.round(F.avg(F.when(F.col("land") > 0, F.col("land") / F.col("area"))), 6).alias("mean_rate"))


@query("ag_40_conservation", fx.sql("select (select cast(sum(total) as bigint) from rec) as before, (select cast(sum(total) as bigint) from roll) as after, abs((select sum(total) from rec) - (select sum(total) from roll)) <= 1 as kept", "roll"))
def ag_40(spark, sf):
    a, b = fx.rec(spark, sf).agg(F.sum("total").alias("before")), fx.roll(spark, sf).agg(F.sum("total").alias("after"))
    return a.crossJoin(b).withColumn("kept", F.abs(F.col("before") - F.col("after")) <= 1)  # one row each


@query("ag_47_rollup", fx.sql("select coalesce(district, '(all)') as district, coalesce(region, '(all)') as region, count(*) as n from par group by rollup (district, region)", "par"))
def ag_47(spark, sf):
    return fx.par(spark, sf).rollup("district", "region").agg(F.count("*").alias("n")).select(F.coalesce("district", F.lit("(all)")).alias("district"), F.coalesce("region", F.lit("(all)")).alias("region"), "n")


@query("ag_49_type_histogram", "select coalesce(t, 'null') as kind, count(*) as n from (select case o_orderkey % 4 when 0 then 'Polygon' when 1 then 'MultiPolygon' when 2 then 'Point' end as t from orders) group by 1")
def ag_49(spark, sf):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, "Polygon").when(k == 1, "MultiPolygon").when(k == 2, "Point")
    return T(spark, sf, "orders").groupBy(F.coalesce(t, F.lit("null")).alias("kind")).agg(F.count("*").alias("n"))


@query("ag_50_fill_scorecard", "select p_brand, sum(case when p_size > 25 then 2 else 0 end + case when p_type like '%STEEL' then 3 else 0 end)::bigint as points, case when avg(case when p_size > 25 then 1.0 else 0.0 end) >= 0.5 then 'good' else 'poor' end as verdict from part group by 1")
def ag_50(spark, sf):
    pts = F.when(F.col("p_size") > 25, 2).otherwise(0) + F.when(F.col("p_type").endswith("STEEL"), 3).otherwise(0)
    fill = F.avg(F.when(F.col("p_size") > 25, 1.0).otherwise(0.0))
    return T(spark, sf, "part").groupBy("p_brand").agg(F.sum(pts).alias("points"), F.when(fill >= 0.5, "good").otherwise("poor").alias("verdict"))


@query("ag_52_duplicate_sum", fx.sql("select fkey, l_linenumber, cast(sum(total) as bigint) as total, min(category) as category from rec group by 1, 2", "rec"))
def ag_52(spark, sf):
    return fx.rec(spark, sf).groupBy("fkey", "l_linenumber").agg(F.sum("total").alias("total"), F.min("category").alias("category"))


@query("wn_04_first_row", "select user_id, event_id from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r = 1")
def wn_04(spark, sf):
    return rollup.first_by(T(spark, sf, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_id")


@query("wn_08_value_counts", "select p_partkey, count(*) over (partition by p_type) as n from part")
def wn_08(spark, sf):
    return T(spark, sf, "part").select("p_partkey", F.count("*").over(Window.partitionBy("p_type")).alias("n"))


@query("so_04_top_of_map", fx.sql("select region, land from (select region, cast(sum(land) as bigint) as land from par group by region) order by land desc, region limit 3", "par"))
def so_04(spark, sf):
    return fx.par(spark, sf).groupBy("region").agg(F.sum("land").alias("land")).orderBy(F.desc("land"), "region").limit(3)


@query("so_06_custom_order", fx.sql("select region, n, row_number() over (order by case when region = '(None)' then 2 when region = 'FRANCE' then 0 else 1 end, n desc, region) as place from (select case when fkey % 31 = 0 then '(None)' else region end as region, count(*) as n from par group by 1)", "par"))
def so_06(spark, sf):
    """One name first, the nameless last, the others by size; a row a region, so one window holds them all."""
    region = F.when(F.col("fkey") % 31 == 0, "(None)").otherwise(F.col("region"))
    first = F.when(F.col("region") == "(None)", 2).when(F.col("region") == "FRANCE", 0).otherwise(1)
    n = fx.par(spark, sf).groupBy(region.alias("region")).agg(F.count("*").alias("n"))
    return n.select("region", "n", F.row_number().over(Window.orderBy(first, F.desc("n"), "region")).cast("long").alias("place"))


@query("so_08_argmin_score", "select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by abs(p_size - 20), p_partkey) as r from part) where r = 1")
def so_08(spark, sf):
    return T(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.abs(F.col("p_size") - 20), "p_partkey")).alias("p_partkey"))


@query("st_06_gap_fill", fx.sql(f"""select bid from (select bid, (bx1 - bx0) * (by1 - by0) as a, coalesce(sum(case when fkey is not null then (least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0)) end), 0) as s
  from bld left join geo on {_HIT} group by bid, bx0, bx1, by0, by1) where s < 0.05 * a""", "bld", "geo"))  # fmt: skip
def st_06(spark, sf):
    b = fx.bld(spark, sf)
    s = spatial.overlapping(fx.geo(spark, sf), b.select("bid", *BLD), GEO, BLD).groupBy("bid").agg(F.sum("shared").alias("s"))
    return b.join(s, "bid", "left").where(F.coalesce("s", F.lit(0)) < metrics.rect_area(*BLD) * 0.05).select("bid")


@query("fl_01_polygons_only", "select o_orderkey from orders where regexp_matches(case o_orderkey % 3 when 0 then 'Polygon' when 1 then 'MultiPolygon' else 'Point' end, 'polygon', 'i')")
def fl_01(spark, sf):
    k = F.col("o_orderkey") % 3
    return T(spark, sf, "orders").where(F.when(k == 0, "Polygon").when(k == 1, "MultiPolygon").otherwise("Point").rlike("(?i)polygon")).select("o_orderkey")


@query("fl_03_explicit_allow_list", fx.sql("select category, count(*) as n from roll where category in ('AF', 'RF') group by category", "roll"))
def fl_03(spark, sf):
    return fx.roll(spark, sf).where(F.col("category").isin("AF", "RF")).groupBy("category").agg(F.count("*").alias("n"))


@query("fl_09_parking_filter", fx.sql("select lot from lot where coalesce(case when lot % 3 = 0 then 'structure' when lot % 3 = 1 then 'uncertain' end, 'surface') in ('surface', 'structure') and lot % 7 <> 0 and lot % 2 = 0", "lot"))
def fl_09(spark, sf):
    k = F.col("lot")
    kind = F.coalesce(F.when(k % 3 == 0, "structure").when(k % 3 == 1, "uncertain"), F.lit("surface"))
    return fx.lot(spark, sf).where(kind.isin("surface", "structure") & (k % 7 != 0) & (k % 2 == 0)).select("lot")


@query("fl_10_under_subset", "select doc_id from documents where trim(case when doc_id % 4 = 0 then 'nan' when doc_id % 4 = 1 then ' ' else lang end) <> '' and lower(trim(case when doc_id % 4 = 0 then 'nan' when doc_id % 4 = 1 then ' ' else lang end)) <> 'nan'")
def fl_10(spark, sf):
    d = F.col("doc_id") % 4
    return T(spark, sf, "documents").where(scalar.folded(F.when(d == 0, "nan").when(d == 1, " ").otherwise(F.col("lang"))).isNotNull()).select("doc_id")


@query("fl_13_fully_exempt", fx.sql("select fkey from (select *, case when exempt = 1 then total else 0 end as ex from roll) where (ex >= total and total > 0) or (total = 0 and land = 0)", "roll"))
def fl_13(spark, sf):
    ex = F.when(F.col("exempt") == 1, F.col("total")).otherwise(0)
    return fx.roll(spark, sf).where(((ex >= F.col("total")) & (F.col("total") > 0)) | ((F.col("total") == 0) & (F.col("land") == 0))).select("fkey")


@query("fl_15_id_length", "select o_orderkey from orders where length(cast(o_orderkey as varchar)) = 4")
def fl_15(spark, sf):
    return T(spark, sf, "orders").where(F.length(F.col("o_orderkey").cast("string")) == 4).select("o_orderkey")


@query("fl_21_plausible_source", "select n_nationkey, case when n < 5 then -3 when n > 90 then -2 else 0 end + case when n_name like '%A%' then 1 else 0 end as score from (select n_nationkey, n_name, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by 1, 2)")
def fl_21(spark, sf):
    c = T(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    n = T(spark, sf, "nation").join(c, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.select("n_nationkey", (F.when(F.col("n") < 5, -3).when(F.col("n") > 90, -2).otherwise(0) + F.when(F.col("n_name").contains("A"), 1).otherwise(0)).alias("score"))


@query("fl_22_fuel_exclusion", fx.sql(f"select distinct fkey from geo join bld on {_HIT} where bclass = 'garage' and (x1 - x0) * (y1 - y0) <= 1500", "geo", "bld"))
def fl_22(spark, sf):
    g = fx.geo(spark, sf).where(metrics.rect_area(*GEO) <= 1500)
    return spatial.overlapping(g, fx.bld(spark, sf).where("bclass = 'garage'"), GEO, BLD).select("fkey").distinct()


@query("fl_23_filtered_scale", fx.sql("select round(quantile_cont(land, 0.99), 6) as p99, count(*) as n from roll where category = 'NO'", "roll"))
def fl_23(spark, sf):
    p = ranks.percentiles(fx.roll(spark, sf).where("category = 'NO'"), ["land"], [99])
    return p.select(F.round(F.col("p")[0], 6).alias("p99"), "n")


@query("fl_25_polygon_only_rows", fx.sql("select fkey from roll where not (category like 'A%' and land = 0 and n = 1)", "roll"))
def fl_25(spark, sf):
    return fx.roll(spark, sf).where(~(F.col("category").startswith("A") & (F.col("land") == 0) & (F.col("n") == 1))).select("fkey")


@query("pj_16_alias_columns", fx.sql("select fkey, coalesce(case when fkey % 2 = 0 then land end, land + 1) as land_value, total as full_market_value from roll", "roll"))
def pj_16(spark, sf):
    return fx.roll(spark, sf).select("fkey", F.coalesce(F.when(F.col("fkey") % 2 == 0, F.col("land")), F.col("land") + 1).alias("land_value"), F.col("total").alias("full_market_value"))


@query("pj_21_decode_ids", fx.sql("select fkey, list_extract(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], cast(fkey % 7 as int) + 1) as name from geo", "geo"))
def pj_21(spark, sf):
    names = F.array(*[F.lit(x) for x in ("AF", "AO", "NF", "NO", "RF", "RO")])
    return fx.geo(spark, sf).select("fkey", F.get(names, (F.col("fkey") % 7).cast("int")).alias("name"))


@query("pj_23_first_number", "select event_id, coalesce(try_cast(case when event_id % 3 = 0 then '' else 'n/a' end as double), try_cast(case when event_id % 2 = 0 then cast(value as varchar) end as double), 0) as v from events")
def pj_23(spark, sf):
    e = F.col("event_id")
    return T(spark, sf, "events").select("event_id", F.coalesce(F.when(e % 3 == 0, "").otherwise("n/a").try_cast("double"), F.when(e % 2 == 0, F.col("value").cast("string")).try_cast("double"), F.lit(0.0)).alias("v"))


@query("pj_25_complement_range", fx.sql("select round(100 - max(p), 6) as lo, round(100 - min(p), 6) as hi from (select impr * 100.0 / total as p from roll where total > 0)", "roll"))
def pj_25(spark, sf):
    p = fx.roll(spark, sf).select(metrics.safe_div(F.col("impr") * 100, "total").alias("p"))
    return p.agg(F.round(100 - F.max("p"), 6).alias("lo"), F.round(100 - F.min("p"), 6).alias("hi"))


@query("pj_27_labels_once", "select lower(event_type) as label, min(event_id) as first from events group by 1")
def pj_27(spark, sf):
    return T(spark, sf, "events").groupBy(F.lower("event_type").alias("label")).agg(F.min("event_id").alias("first"))


@query("pj_29_display_area", fx.sql("select lot, case when lot % 5 = 0 then a else coalesce(case when lot % 3 <> 0 then a * 0.5 end, a * 1.0) end as area from (select lot, (x1 - x0) * (y1 - y0) as a from lot)", "lot"))
def pj_29(spark, sf):
    k, a = F.col("lot"), metrics.rect_area(*GEO)
    return fx.lot(spark, sf).select("lot", F.when(k % 5 == 0, a.cast("double")).otherwise(F.coalesce(F.when(k % 3 != 0, a * 0.5), a * 1.0)).alias("area"))


@query("cs_02_structure_label", "select p_partkey, regexp_matches(p_type, 'garage|deck|structure|ramp|brass', 'i') as structure from part")
def cs_02(spark, sf):
    return T(spark, sf, "part").select("p_partkey", F.col("p_type").rlike(classify.STRUCTURE + "|brass").alias("structure"))


@query("cs_03_playbook", fx.sql("select fkey, case when impr < 0.5 * (land + impr) then 'Underdeveloped' end as refined from roll", "roll"))
def cs_03(spark, sf):
    return fx.roll(spark, sf).select("fkey", F.when(F.col("impr") < (F.col("land") + F.col("impr")) * 0.5, "Underdeveloped").alias("refined"))


@query("cs_07_map_with_fallback", "select p_partkey, coalesce(case p_type when 'PROMO STEEL' then 'promo' when 'SMALL BRASS' then 'small' end, case left(p_type, 2) when 'ST' then 'std' when 'EC' then 'eco' end, 'other') as kind from part")
def cs_07(spark, sf):
    lookup = lambda c, kv: F.try_element_at(F.create_map(*[F.lit(x) for p in kv for x in p]), c)
    t = F.col("p_type")
    return T(spark, sf, "part").select("p_partkey", F.coalesce(lookup(t, [("PROMO STEEL", "promo"), ("SMALL BRASS", "small")]), lookup(F.substring(t, 1, 2), [("ST", "std"), ("EC", "eco")]), F.lit("other")).alias("kind"))


@query("cs_09_building_bucket", fx.sql("select bid, case when bclass in ('parking', 'garage') then 'struct' when bclass in ('roof', 'carport', 'canopy') then 'canopy' else 'real' end as bcat from bld", "bld"))
def cs_09(spark, sf):
    c = F.col("bclass")
    return fx.bld(spark, sf).select("bid", classify.first_match([(c.isin("parking", "garage"), "struct"), (c.isin("roof", "carport", "canopy"), "canopy")], "real").alias("bcat"))


@query("cs_12_dominant_retag", fx.sql(f"""select fkey from (select fkey, area, land, total, sum((least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0))) as s from par join bld on {_HIT} where bclass = 'parking' group by 1, 2, 3, 4)
  where s * 5 >= area and coalesce(land * 1.0 / nullif(total, 0), 1) >= 0.5""", "par", "bld"))  # fmt: skip
def cs_12(spark, sf):
    hit = spatial.overlapping(fx.par(spark, sf), fx.bld(spark, sf).where("bclass = 'parking'"), GEO, BLD).groupBy("fkey", "area", "land", "total").agg(F.sum("shared").alias("s"))
    return hit.where((F.col("s") * 5 >= F.col("area")) & (F.coalesce(F.try_divide("land", "total"), F.lit(1.0)) >= 0.5)).select("fkey")


@query("cs_14_exempt_lot", fx.sql("""select lot.lot, coalesce(bool_or(exempt = 1), true) as is_exempt from lot left join par on lot.x0 < par.x1 and par.x0 < lot.x1 and lot.y0 < par.y1 and par.y0 < lot.y1 group by lot.lot""", "lot", "par"))
def cs_14(spark, sf):
    p = fx.par(spark, sf).select("exempt", *[F.col(c).alias("b" + c) for c in GEO])
    hit = spatial.overlapping(fx.lot(spark, sf).select("lot", *GEO), p, GEO, BLD).groupBy("lot").agg(F.bool_or(F.col("exempt") == 1).alias("e"))
    return fx.lot(spark, sf).select("lot").join(hit, "lot", "left").select("lot", F.coalesce("e", F.lit(True)).alias("is_exempt"))


@query("cs_15_coverage_type", fx.sql("select p_brand, case when list_sort(list(distinct s) filter (where s is not null)) = ['ml_segmentation'] then 'ml_segmentation' when len(list(distinct s) filter (where s is not null)) > 0 and list_sort(list(distinct s) filter (where s is not null)) = ['osm', 'osm_supplement'] or list_sort(list(distinct s) filter (where s is not null)) = ['osm'] then 'osm_only' when count(distinct s) > 1 then 'mixed' else 'unknown' end as coverage from (select p_brand, case when lot % 5 = 4 then null when p_brand like '%1' then 'osm' when p_brand like '%2' then case lot % 2 when 0 then 'osm' else 'osm_supplement' end when p_brand like '%3' then 'ml_segmentation' when p_brand like '%4' then 'osm_supplement' else source end as s from lot) where s is not null or p_brand is not null group by p_brand", "lot"))
def cs_15(spark, sf):
    """What a brand's lots come from; the two OSM sources, or the first alone, are OSM only, the second alone is not."""
    k, brand = F.col("lot"), F.col("p_brand")
    even = F.when(k % 2 == 0, "osm").otherwise("osm_supplement")
    s = F.when(k % 5 == 4, None).when(brand.endswith("1"), "osm").when(brand.endswith("2"), even).when(brand.endswith("3"), "ml_segmentation").when(brand.endswith("4"), "osm_supplement").otherwise(F.col("source"))
    have = F.sort_array(F.collect_set("s"))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    label = F.when(have == lit("ml_segmentation"), "ml_segmentation").when((have == lit("osm", "osm_supplement")) | (have == lit("osm")), "osm_only").when(F.size(have) > 1, "mixed").otherwise("unknown")
    return fx.lot(spark, sf).select("p_brand", s.alias("s")).groupBy("p_brand").agg(label.alias("coverage"))


@query("cs_23_merge_gate", fx.sql("select fkey, count(*) as n from rec group by fkey having count(*) > 1 and (bool_or(l_linenumber = 7) or (quantile_cont(qty, 0.5) < 20 and bool_and(category <> 'NO')))", "rec"))
def cs_23(spark, sf):
    g = fx.rec(spark, sf).groupBy("fkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_linenumber") == 7).alias("c"), F.expr("percentile(qty, 0.5)").alias("m"), F.bool_and(F.col("category") != "NO").alias("k"))
    return g.where("n > 1 and (c or (m < 20 and k))").select("fkey", "n")


@query("sx_10_smoothing_cap", fx.sql("select s, round(p99 + (top - p99) * s, 4) as cap from (select quantile_cont(total, 0.99) as p99, max(total) as top from roll), (values (0.0), (0.25), (1.0)) t(s)", "roll"))
def sx_10(spark, sf):
    one = ranks.percentiles(fx.roll(spark, sf), ["total"], [99, 100]).select(F.col("p")[0].alias("p99"), F.col("p")[1].alias("top"))
    return one.select("p99", "top", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(1.0))).alias("s")).select("s", F.round(F.col("p99") + (F.col("top") - F.col("p99")) * F.col("s"), 4).alias("cap"))


@query("sp_04_crs_override", fx.sql("select case when max(x1) > 180 or max(y1) > 90 then 3857 else 4326 end as srid from geo", "geo"))
def sp_04(spark, sf):
    return fx.geo(spark, sf).agg(F.when((F.max("x1") > 180) | (F.max("y1") > 90), 3857).otherwise(4326).alias("srid"))


@query("sp_49_mesh_check", fx.sql("select count(*) as cells, count(*) * 12 as triangles, 0 as open_edges, cast(sum(h) as double) as volume from (select floor(x0 / 400) as a, floor(y0 / 400) as b, 1 + count(*) as h from geo group by 1, 2)", "geo"))
def sp_49(spark, sf):
    cells = fx.geo(spark, sf).groupBy(F.floor(F.col("x0") / 400).alias("a"), F.floor(F.col("y0") / 400).alias("b")).agg((F.count("*") + 1).alias("h"))
    return mesh.checked(mesh.prisms(cells, "a", "b", "h"))


@query("sp_50_raster_index", "select cast(floor(l_extendedprice / 20000) as bigint) as band, count(*) as n, count(*) filter (where (nir - red) * 1.0 / (nir + red) > 0.2) as green from (select l_extendedprice, 1 + l_partkey % 255 as nir, 1 + l_suppkey % 200 as red from lineitem) group by 1")
def sp_50(spark, sf):
    l = T(spark, sf, "lineitem").select(F.floor(F.col("l_extendedprice") / 20000).alias("band"), (F.col("l_partkey") % 255 + 1).alias("nir"), (F.col("l_suppkey") % 200 + 1).alias("red"))
    return l.groupBy("band").agg(F.count("*").alias("n"), F.count_if((F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red")) > 0.2).alias("green"))


@query("sp_52_local_millimetres", fx.sql("select fkey, round((x0 - w) * 100.0 / greatest(e - w, n - s), 6) as x, round((y0 - s) * 100.0 / greatest(e - w, n - s), 6) as y from geo, (select min(x0) as w, max(x1) as e, min(y0) as s, max(y1) as n from geo)", "geo"))
def sp_52(spark, sf):
    b = fx.geo(spark, sf).agg(F.min("x0").alias("w"), F.max("x1").alias("e"), F.min("y0").alias("s"), F.max("y1").alias("n"))
    size = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"))
    return fx.geo(spark, sf).crossJoin(F.broadcast(b)).select("fkey", F.round((F.col("x0") - F.col("w")) * 100.0 / size, 6).alias("x"), F.round((F.col("y0") - F.col("s")) * 100.0 / size, 6).alias("y"))  # one row broadcast


@query("sf_08_token_sets", "select p_partkey, array_to_string(list_sort(list_filter(list_distinct(string_split(lower(p_type), ' ')), lambda x: x not in ('steel', 'brass'))), ' ') as t from part")
def sf_08(spark, sf):
    w = F.array_except(F.array_distinct(F.split(F.lower("p_type"), " ")), F.array(F.lit("steel"), F.lit("brass")))
    return T(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(w), " ").alias("t"))


@query("sf_09_owner_names", "select c_custkey, trim(regexp_replace(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g'), '\\b(UNIT|STE)\\b', '', 'g')) as owner from customer")
def sf_09(spark, sf):
    return T(spark, sf, "customer").select("c_custkey", F.trim(F.regexp_replace(F.regexp_replace(F.upper("c_name"), "[^A-Z0-9]+", " "), r"\b(UNIT|STE)\b", "")).alias("owner"))


@query("sf_12_concat_columns", "select c_custkey, concat_ws(' ', c_name, c_mktsegment, cast(c_nationkey as varchar)) as s from customer")
def sf_12(spark, sf):
    return T(spark, sf, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("s"))


@query("sf_17_guarded_divide", fx.sql("select fkey, round(coalesce(land * 1.0 / nullif(impr * (fkey % 2), 0), 0), 6) as v from roll", "roll"))
def sf_17(spark, sf):
    return fx.roll(spark, sf).select("fkey", F.round(F.coalesce(F.try_divide(F.col("land"), F.col("impr") * (F.col("fkey") % 2)), F.lit(0.0)), 6).alias("v"))


@query("sf_20_arrays", "select conv_id, len(list_distinct(list(role))) as roles, count(*) as turns from conversations group by conv_id")
def sf_20(spark, sf):
    return T(spark, sf, "conversations").groupBy("conv_id").agg(F.size(F.array_distinct(F.collect_list("role"))).cast("long").alias("roles"), F.count("*").alias("turns"))


@query("sf_25_alias_resolution", "select event_id, coalesce(case when event_type in ('view', 'click') then 'look' when event_type in ('purchase', 'cart') then 'buy' end, 'other') as k from events")
def sf_25(spark, sf):
    table = spark.createDataFrame([("look", ["view", "click"]), ("buy", ["purchase", "cart"])], "k string, aliases array<string>").select("k", F.explode("aliases").alias("event_type"))
    return T(spark, sf, "events").join(F.broadcast(table), "event_type", "left").select("event_id", F.coalesce("k", F.lit("other")).alias("k"))


@query("sf_30_units", fx.sql("select fkey, round(area / 10.763910416709722, 6) as m2, round(area / 43560.0, 6) as acres, round(area / 43560.0 / 2.4710538, 6) as ha from par", "par"))
def sf_30(spark, sf):
    a = F.col("area")
    return fx.par(spark, sf).select("fkey", F.round(a / 10.763910416709722, 6).alias("m2"), F.round(a / 43560.0, 6).alias("acres"), F.round(a / 43560.0 / 2.4710538, 6).alias("ha"))


@query("jn_09_key_backfill", "select o_orderkey, coalesce(case when o_orderkey % 3 <> 0 then o_custkey end, s) as k from orders left join (select l_orderkey, min(l_suppkey) as s from lineitem group by 1) on l_orderkey = o_orderkey")
def jn_09(spark, sf):
    l = T(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s"))
    return T(spark, sf, "orders").join(l, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")), "s").alias("k"))


@query("sx_19_broken_denominator", fx.sql("select fkey, round(total * 1.0 / area / m, 6) as times from par join (select district as d, quantile_cont(total * 1.0 / area, 0.5) as m from par group by 1) on district = d where total * 1.0 / area > 4 * m", "par"))
def sx_19(spark, sf):
    p = fx.par(spark, sf).withColumn("v", F.col("total") / F.col("area"))
    m = ranks.percentiles(p, ["v"], [50], ["district"]).select("district", F.col("p")[0].alias("m"))
    return p.join(m, "district").where(F.col("v") > F.col("m") * 4).select("fkey", F.round(F.col("v") / F.col("m"), 6).alias("times"))
