"""Roll-up, aggregation, window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terraledger.operators import classify, metrics, ranks, rollup, spatial
from terraledger.plans import fixtures as fx
from terraledger.plans.registry import query


@query("ag_14_rollup_footprint", fx.sql("select fkey, land, total, impr, n, exempt, category, x0, y0, x1, y1 from roll join geo using (fkey)", "roll", "geo"))
def ag_14(spark, sf):
    return fx.roll(spark, sf).join(fx.geo(spark, sf), "fkey").select("fkey", "land", "total", "impr", "n", "exempt", "category", "x0", "y0", "x1", "y1")


_NAMED = """case category when 'AF' then 'Vacant Land' when 'AO' then 'Parking Lot' when 'NF' then 'Single Family'
 when 'NO' then 'Parking Garage' when 'RF' then 'Commercial' when 'RO' then 'Utility' else 'Industrial' end"""


def _named(c="category"):
    names = {"AF": "Vacant Land", "AO": "Parking Lot", "NF": "Single Family", "NO": "Parking Garage", "RF": "Commercial", "RO": "Utility"}
    return classify.first_match([(F.col(c) == k, v) for k, v in names.items()], "Industrial")


@query("cs_01_refined_class", fx.sql(f"""select fkey, cat, case when cat like '%Vacant%' then 'Vacant'
  when cat like '%Parking%' and not regexp_matches(cat, 'Garage|Deck|Structure|Ramp', 'i') then 'Parking Lot'
  when impr = 0 and built = 0 and not foot and not (left(code, 1) in ('X', 'J', 'D') or left(code, 2) = '1D' or cat in ('Utility', 'Agricultural / Rural')) then 'Vacant'
  when impr <> 0 and land + impr > 0 and land * 1.0 / (land + impr) >= case when cat = 'Single Family' then 0.67 else 0.5 end then 'Underdeveloped' end as refined
  from (select roll.fkey, {_NAMED} as cat, land, case when roll.fkey % 3 = 0 then 0 else impr end as impr, case when roll.fkey % 5 = 0 then 900 else 0 end as built, case roll.fkey % 8 when 0 then 'X1' when 1 then '1D' when 2 then 'F2' else '' end as code,
   hit.fkey is not null as foot from roll left join (select distinct fkey from geo join bld on x0 < bx1 and bx0 < x1 and y0 < by1 and by0 < y1) hit on roll.fkey = hit.fkey)""", "roll", "geo", "bld"))  # fmt: skip
def cs_01(spark, sf):
    """Classes from category, values, building area, footprints and state class; footprints are asked for where no improvement is known."""
    k = F.col("fkey")
    r = fx.roll(spark, sf).select("fkey", _named().alias("cat"), "land", F.when(k % 3 == 0, 0).otherwise(F.col("impr")).alias("impr"), F.when(k % 5 == 0, 900).otherwise(0).alias("built"),
                                  classify.first_match([(k % 8 == 0, "X1"), (k % 8 == 1, "1D"), (k % 8 == 2, "F2")], "").alias("code"))
    hit = spatial.overlapping(fx.geo(spark, sf), fx.bld(spark, sf), ("x0", "x1", "y0", "y1"), ("bx0", "bx1", "by0", "by1")).select("fkey").distinct().withColumn("foot", F.lit(True))
    seen = r.where("impr = 0").join(hit, "fkey", "left").unionByName(r.where("impr <> 0 or impr is null").withColumn("foot", F.lit(False)))
    return seen.select("fkey", "cat", classify.refined(F.col("cat"), F.col("land"), F.col("impr"), F.col("built"), F.coalesce("foot", F.lit(False)), F.col("code")).alias("refined"))


@query("ag_01_min_max", fx.sql("""select unnest(['land','total','impr']) as field, unnest([min(land), min(total), min(impr)]) as lo,
  unnest([max(land), max(total), max(impr)]) as hi from roll""", "roll"))  # fmt: skip
def ag_01(spark, sf):
    cols = ["land", "total", "impr"]
    one = fx.roll(spark, sf).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    return one.select(F.expr("stack(3, {})".format(", ".join(f"'{c}', lo_{c}, hi_{c}" for c in cols))).alias("field", "lo", "hi"))


@query("ag_02_distinct_categories", fx.sql("select distinct category from rec where trim(category) <> '' order by category", "rec"))
def ag_02(spark, sf):
    return fx.rec(spark, sf).where(F.trim("category") != "").select("category").distinct().orderBy("category")


@query("ag_03_conditional_sums", fx.sql("""select cast(sum(case when category = 'AF' and exempt = 0 then land else 0 end) as bigint) as vacant,
  cast(sum(case when category = 'AO' and exempt = 0 then land else 0 end) as bigint) as parking, cast(sum(case when exempt = 0 then land else 0 end) as bigint) as all_land from roll""", "roll"))  # fmt: skip
def ag_03(spark, sf):
    free = F.col("exempt") == 0
    land = lambda cond: F.sum(F.when(cond, F.col("land")).otherwise(0))
    return fx.roll(spark, sf).agg(land(free & (F.col("category") == "AF")).alias("vacant"), land(free & (F.col("category") == "AO")).alias("parking"), land(free).alias("all_land"))


@query("ag_04_under_buckets", fx.sql("""select b as bucket, count(*) as n, cast(sum(land) as bigint) as land from
  (select land, case when p >= 0 and p < 10 then '0-10' when p >= 10 and p < 25 then '10-25' when p >= 25 and p < 101 then '25-100' end as b
   from (select land, 100.0 * impr / total as p from roll where total > 0)) where b is not null group by b""", "roll"))  # fmt: skip
def ag_04(spark, sf):
    p = F.col("impr") * 100 / F.col("total")
    b = classify.first_match([((p >= 0) & (p < 10), "0-10"), ((p >= 10) & (p < 25), "10-25"), ((p >= 25) & (p < 101), "25-100")])
    return fx.roll(spark, sf).where("total > 0").withColumn("bucket", b).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("land").alias("land"))


@query("ag_05_under_totals", fx.sql("""select category, count(*) as n, cast(sum(land) as bigint) as land, round(avg(case when area > 0 then land / area end), 6) as mean_rate,
  cast(sum(case when exempt = 1 then land else 0 end) as bigint) as exempt_land from par where impr * 2 < total group by category""", "par"))  # fmt: skip
def ag_05(spark, sf):
    p = fx.par(spark, sf).where("impr * 2 < total")
    return p.groupBy("category").agg(F.count("*").alias("n"), F.sum("land").alias("land"), F.round(F.avg(metrics.safe_div("land", "area")), 6).alias("mean_rate"), F.sum(F.when(F.col("exempt") == 1, F.col("land")).otherwise(0)).alias("exempt_land"))


@query("ag_06_city_totals", fx.sql("""select round(sum(area) / 43560.0, 1) as acres, cast(sum(land) as bigint) as land, cast(sum(impr) as bigint) as impr, cast(sum(total) as bigint) as total from par""", "par"))
def ag_06(spark, sf):
    return fx.par(spark, sf).agg(F.round(F.sum("area") / 43560.0, 1).alias("acres"), F.sum("land").alias("land"), F.sum("impr").alias("impr"), F.sum("total").alias("total"))


@query("ag_07_region_totals", fx.sql("""select case when grouping(region) = 0 then 'region' when grouping(district) = 0 then 'district' else '(all)' end as field,
  coalesce(region, district, '(all)') as name, count(*) as n, cast(sum(land) as bigint) as land, cast(sum(case when exempt = 0 then land else 0 end) as bigint) as taxable
  from par group by grouping sets ((), (region), (district))""", "par"))  # fmt: skip
def ag_07(spark, sf):
    aggs = [F.count("*").alias("n"), F.sum("land").alias("land"), F.sum(F.when(F.col("exempt") == 0, F.col("land")).otherwise(0)).alias("taxable")]
    return rollup.sums(fx.par(spark, sf), ["region", "district"], aggs)


@query("ag_09_region_counts", fx.sql("""select region, n from (select case when fkey % 97 = 0 then null else region end as r0, coalesce(case when fkey % 97 = 0 then null else region end, '(None)') as region,
  count(*) as n from par group by 1, 2) order by case when region = '(None)' then 1 else 0 end, n desc, region""", "par"))  # fmt: skip
def ag_09(spark, sf):
    p = fx.par(spark, sf).withColumn("region", F.coalesce(F.when(F.col("fkey") % 97 != 0, F.col("region")), F.lit("(None)")))
    return p.groupBy("region").agg(F.count("*").alias("n")).orderBy((F.col("region") == "(None)").cast("int"), F.desc("n"), "region")


@query("ag_10_broadcast_dedupe", fx.sql("""select fkey, total, category, cast(qty as bigint) as qty from (select *, row_number() over
  (partition by fkey order by total desc, category, l_partkey, l_suppkey, l_linenumber, qty) as r from rec) where r = 1""", "rec"))  # fmt: skip
def ag_10(spark, sf):
    order = [F.desc("total"), *[F.asc(c) for c in ("category", "l_partkey", "l_suppkey", "l_linenumber", "qty")]]
    return rollup.first_by(fx.rec(spark, sf), ["fkey"], order).select("fkey", "total", "category", "qty")


@query("ag_11_dedupe_guard", fx.sql("select fkey, count(distinct category) as kinds, count(*) as n from rec group by fkey having count(distinct category) > 1", "rec"))
def ag_11(spark, sf):
    return fx.rec(spark, sf).groupBy("fkey").agg(F.count_distinct("category").alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


@query("ag_12_latest_per_key", "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def ag_12(spark, sf):
    return rollup.first_by(fx.table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("ag_15_dominant_category", fx.sql("""select fkey, category, weight from (select fkey, category, cast(sum(total) as bigint) as weight,
  row_number() over (partition by fkey order by sum(total) desc, category) as r from rec group by fkey, category) where r = 1""", "rec"))  # fmt: skip
def ag_15(spark, sf):
    return rollup.dominant(fx.rec(spark, sf), ["fkey"], "category", "total")


@query("ag_17_mode", fx.sql("""select l_suppkey, category from (select l_suppkey, category, row_number() over (partition by l_suppkey order by count(*) desc, category) as r from rec group by 1, 2) where r = 1""", "rec"))
def ag_17(spark, sf):
    return fx.rec(spark, sf).groupBy("l_suppkey").agg(F.expr("mode() within group (order by category)").alias("category"))


@query("ag_20_string_aggs", """select conv_id, string_agg(role, ' | ' order by turn) as roles, count(*) as n,
  min_by(role, turn) || case when count(*) > 1 then ' (+' || cast(count(*) - 1 as varchar) || ' more)' else '' end as label from conversations group by conv_id""")
def ag_20(spark, sf):
    c = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"), F.count("*").alias("n"))
    first = F.element_at("x", 1)["role"]
    return c.select("conv_id", F.array_join(F.transform("x", lambda s: s["role"]), " | ").alias("roles"), "n", F.concat(first, F.when(F.col("n") > 1, F.concat(F.lit(" (+"), (F.col("n") - 1).cast("string"), F.lit(" more)"))).otherwise("")).alias("label"))


@query("ag_22_min_count_sum", fx.sql("""select l_suppkey, cast(sum(nullif(land, 0)) as bigint) as bare, cast(coalesce(sum(nullif(land, 0)), 0) as bigint) as zero from (select l_suppkey, case when l_suppkey % 3 = 0 then 0 else land end as land from rec) group by 1""", "rec"))
def ag_22(spark, sf):
    v = F.sum(F.nullif(F.col("land"), F.lit(0)))
    r = fx.rec(spark, sf).select("l_suppkey", F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("land")).alias("land"))
    return r.groupBy("l_suppkey").agg(v.alias("bare"), F.coalesce(v, F.lit(0)).alias("zero"))


@query("ag_23_all_or_nothing", fx.sql("select fkey, case when bool_or(land = 0) then null else cast(sum(land) as bigint) end as land from rec group by fkey", "rec"))
def ag_23(spark, sf):
    return fx.rec(spark, sf).groupBy("fkey").agg(F.when(~F.bool_or(F.col("land") == 0), F.sum("land")).alias("land"))


@query("ag_24_any_all", fx.sql("select l_suppkey, bool_or(exempt = 1) as any_exempt, bool_and(exempt = 0) as none_exempt, count(distinct category) as kinds from rec group by 1", "rec"))
def ag_24(spark, sf):
    e = F.col("exempt")
    return fx.rec(spark, sf).groupBy("l_suppkey").agg(F.bool_or(e == 1).alias("any_exempt"), F.bool_and(e == 0).alias("none_exempt"), F.count_distinct("category").alias("kinds"))


@query("ag_26_quantiles", fx.sql("select category, round(quantile_cont(land, 0.5), 6) as p50, round(quantile_cont(land, 0.9), 6) as p90, count(*) as n from roll group by category", "roll"))
def ag_26(spark, sf):
    p = ranks.percentiles(fx.roll(spark, sf), ["land"], [50, 90], ["category"])
    return p.select("category", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p90"), "n")


@query("ag_27_weighted_mean", fx.sql("select region, round(sum(land * 1.0 / area * area) / sum(area), 6) as rate from par group by region", "par"))
def ag_27(spark, sf):
    return fx.par(spark, sf).groupBy("region").agg(F.round(F.sum(F.col("land") / F.col("area") * F.col("area")) / F.sum("area"), 6).alias("rate"))


@query("ag_30_named_aggs", "select o_custkey, min(o_orderdate) as first_date, max(o_orderdate) as last_date, round(quantile_cont(o_totalprice, 0.5), 4) as mid from orders group by o_custkey")
def ag_30(spark, sf):
    return fx.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.round(F.expr("percentile(o_totalprice, 0.5)"), 4).alias("mid"))


@query("ag_31_category_sets", fx.sql("""select fkey, case when bool_or(category like 'A%') and bool_or(category not like 'A%') then 'Mixed Use' else min(category) end as use,
  string_agg(distinct category, ',' order by category) as kinds from rec group by fkey""", "rec"))  # fmt: skip
def ag_31(spark, sf):
    s = fx.rec(spark, sf).groupBy("fkey").agg(F.sort_array(F.collect_set("category")).alias("s"))
    mixed = F.exists("s", lambda x: x.startswith("A")) & F.exists("s", lambda x: ~x.startswith("A"))
    return s.select("fkey", F.when(mixed, "Mixed Use").otherwise(F.element_at("s", 1)).alias("use"), F.array_join("s", ",").alias("kinds"))


_CUTS = [0, 50_000, 100_000, 200_000, 400_000]


@query("ag_32_cut_bins", fx.sql("select bin, count(*) as n, round(quantile_cont(land, 0.5), 6) as mid from (select land, case " + " ".join(f"when total > {a} and total <= {b} then '({a},{b}]'" for a, b in zip(_CUTS, _CUTS[1:])) + " end as bin from roll) where bin is not null group by bin", "roll"))
def ag_32(spark, sf):
    t = F.col("total")
    b = classify.first_match([((t > a) & (t <= z), f"({a},{z}]") for a, z in zip(_CUTS, _CUTS[1:], strict=False)])
    return fx.roll(spark, sf).withColumn("bin", b).where("bin is not null").transform(lambda d: ranks.percentiles(d, ["land"], [50], ["bin"])).select("bin", "n", F.round(F.col("p")[0], 6).alias("mid"))


@query("ag_33_min_positive", fx.sql("select category, min(case when land > 0 then land end) as least, max(greatest(land, total - land)) as most from rec group by category", "rec"))
def ag_33(spark, sf):
    return fx.rec(spark, sf).groupBy("category").agg(F.min(F.when(F.col("land") > 0, F.col("land"))).alias("least"), F.max(F.greatest(F.col("land"), F.col("total") - F.col("land"))).alias("most"))


@query("ag_41_area_agreement", fx.sql("select round(quantile_cont(r, 0.5), 6) as mid, count(*) filter (where abs(r - 1) > 0.1) as off from (select (area + fkey % 300) * 1.0 / area as r from par)", "par"))
def ag_41(spark, sf):
    p = fx.par(spark, sf).select(((F.col("area") + F.col("fkey") % 300) / F.col("area")).alias("r"))
    mid = ranks.percentiles(p, ["r"], [50]).select(F.round(F.col("p")[0], 6).alias("mid"))
    return mid.crossJoin(p.agg(F.count_if(F.abs(F.col("r") - 1) > 0.1).alias("off")))  # one row each


@query("ag_42_formula_test", fx.sql("""select r.category, count(*) as n, round(m.mid, 6) as mid, round(avg(case when abs(r.s - m.mid) <= 0.005 then 1.0 else 0.0 end), 6) as near, count(distinct round(r.s, 3)) as kinds
  from (select category, land * 1.0 / total as s from roll where total > 0) r join (select category, quantile_cont(land * 1.0 / total, 0.5) as mid from roll where total > 0 group by category) m on r.category = m.category group by r.category, m.mid""", "roll"))  # fmt: skip
def ag_42(spark, sf):
    r = fx.roll(spark, sf).where("total > 0").select("category", (F.col("land") / F.col("total")).alias("s"))
    m = ranks.percentiles(r, ["s"], [50], ["category"]).select("category", F.col("p")[0].alias("mid"))
    near = F.avg(F.when(F.abs(F.col("s") - F.col("mid")) <= 0.005, 1.0).otherwise(0.0))
    return r.join(m, "category").groupBy("category", "mid").agg(F.count("*").alias("n"), F.round(near, 6).alias("near"), F.count_distinct(F.round("s", 3)).alias("kinds")).withColumn("mid", F.round("mid", 6))


@query("ag_44_stacked_clusters", fx.sql("select k as stacked, count(*) as clusters from (select floor(x0 / 200) as a, floor(y0 / 200) as b, count(*) as k from geo group by 1, 2) where k > 1 group by k", "geo"))
def ag_44(spark, sf):
    g = fx.geo(spark, sf).groupBy(F.floor(F.col("x0") / 200).alias("a"), F.floor(F.col("y0") / 200).alias("b")).agg(F.count("*").alias("stacked"))
    return g.where("stacked > 1").groupBy("stacked").agg(F.count("*").alias("clusters"))


@query("ag_45_grid_median", fx.sql("select floor(x0 / 400) as ix, floor(y0 / 400) as iy, count(*) as feature_count, round(quantile_cont(land, 0.5), 6) as land, round(quantile_cont(impr, 0.5), 6) as impr from par group by 1, 2", "par"))
def ag_45(spark, sf):
    p = fx.par(spark, sf)
    med = lambda c: F.round(F.expr(f"percentile({c}, 0.5)"), 6).alias(c)
    return p.groupBy(F.floor(F.col("x0") / 400).cast("double").alias("ix"), F.floor(F.col("y0") / 400).cast("double").alias("iy")).agg(F.count("*").alias("feature_count"), med("land"), med("impr"))


@query("ag_48_bounds", fx.sql("select min(x0) as west, min(y0) as south, max(x1) as east, max(y1) as north from geo", "geo"))
def ag_48(spark, sf):
    return fx.geo(spark, sf).agg(F.min("x0").alias("west"), F.min("y0").alias("south"), F.max("x1").alias("east"), F.max("y1").alias("north"))


@query("ag_51_mixed_dedupe", fx.sql("""select l_suppkey, fkey, cast(sum(qty) as bigint) as qty, min_by(total, total * 100000 + l_partkey) as total from rec group by 1, 2""", "rec"))
def ag_51(spark, sf):
    return fx.rec(spark, sf).groupBy("l_suppkey", "fkey").agg(F.sum("qty").alias("qty"), rollup.first_value("total", ["total", "l_partkey"]).alias("total"))


@query("wn_01_group_share", fx.sql("select fkey, l_partkey, l_suppkey, total, round(case when sum(land) over w <> 0 then land * 1.0 / sum(land) over w else 1.0 / count(*) over w end, 6) as share from rec window w as (partition by fkey)", "rec"))
def wn_01(spark, sf):
    return fx.rec(spark, sf).select("fkey", "l_partkey", "l_suppkey", "total", F.round(rollup.share("land", ["fkey"]), 6).alias("share"))


@query("wn_02_group_size", fx.sql("select fkey, l_partkey, l_suppkey, total, count(*) over (partition by fkey) as n, count(*) over (partition by category) as same from rec", "rec"))
def wn_02(spark, sf):
    """Few categories hold all rows: their sizes are counted and joined; keys of a few rows go through a window."""
    r = fx.rec(spark, sf)
    same = r.groupBy("category").agg(F.count("*").alias("same"))  # a row a category
    return r.join(same, "category").select("fkey", "l_partkey", "l_suppkey", "total", F.count("*").over(Window.partitionBy("fkey")).alias("n"), "same")


@query("wn_03_group_median_outlier", fx.sql("""select fkey, round(p.land * 1.0 / p.area / m.mid, 6) as times from par p join (select region, quantile_cont(land * 1.0 / area, 0.5) as mid from par where land > 0 group by region) m on p.region = m.region
  where p.land * 1.0 / p.area / m.mid > 3 and p.area < 2000""", "par"))  # fmt: skip
def wn_03(spark, sf):
    p = fx.par(spark, sf).withColumn("rate", F.col("land") / F.col("area"))
    m = ranks.percentiles(p.where("land > 0"), ["rate"], [50], ["region"]).select("region", F.col("p")[0].alias("mid"))
    times = F.col("rate") / F.col("mid")
    return p.join(m, "region").where((times > 3) & (F.col("area") < 2000)).select("fkey", F.round(times, 6).alias("times"))


@query("wn_05_last_row", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as r from orders) where r = 1")
def wn_05(spark, sf):
    return rollup.first_by(fx.table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("wn_06_composite_rank", fx.sql("select l_suppkey, fkey, total, exempt from (select *, row_number() over (partition by l_suppkey order by exempt, total desc, fkey, l_partkey) as r from rec) where r <= 3", "rec"))
def wn_06(spark, sf):
    return rollup.first_by(fx.rec(spark, sf), ["l_suppkey"], [F.asc("exempt"), F.desc("total"), F.asc("fkey"), F.asc("l_partkey")], 3).select("l_suppkey", "fkey", "total", "exempt")


@query("wn_07_duplicate_marker", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice, count(*) over (partition by l_orderkey, l_linenumber) > 1 as dup from lineitem")
def wn_07(spark, sf):
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber")) > 1).alias("dup"))


@query("wn_10_ordered_prefix", fx.sql("select region, fkey, row_number() over (partition by region order by area desc, fkey) as place from par", "par"))
def wn_10(spark, sf):
    """Few regions hold all rows, so places come from a range-partitioned order rather than a window a region."""
    p = fx.par(spark, sf).select("region", (-F.col("area")).alias("down"), "fkey")
    return ranks.positions(p, ["region"], ["down", "fkey"]).select("region", "fkey", "place")


@query("wn_11_inverted_rank", fx.sql("select fkey, round((5 - 1 - b) / 4.0, 6) as height from (select fkey, case when land < 20000 then 0 when land < 40000 then 1 when land < 60000 then 2 when land < 80000 then 3 else 4 end as b from roll)", "roll"))
def wn_11(spark, sf):
    b = F.size(F.filter(F.array(*[F.lit(x) for x in (20000, 40000, 60000, 80000)]), lambda x: F.col("land") >= x))
    return fx.roll(spark, sf).select("fkey", F.round((F.lit(4) - b) / 4.0, 6).alias("height"))


@query("wn_13_rows_frame", "select event_id, count(*) over w as held, round(sum(value) over w, 4) as total from events window w as (partition by user_id order by ts, event_id rows between 23 preceding and current row)")
def wn_13(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-23, 0)
    return fx.table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("held"), F.round(F.sum("value").over(w), 4).alias("total"))


@query("so_01_multi_key_sort", fx.sql("select category, total, fkey from roll order by category, total desc, fkey", "roll"))
def so_01(spark, sf):
    return fx.roll(spark, sf).select("category", "total", "fkey").orderBy("category", F.desc("total"), "fkey")


@query("so_02_top_n", fx.sql("select fkey, total from roll order by total desc, fkey limit 25", "roll"))
def so_02(spark, sf):
    return fx.roll(spark, sf).select("fkey", "total").orderBy(F.desc("total"), "fkey").limit(25)


@query("so_03_top_counts", fx.sql("select category, count(*) as n from rec group by category order by n desc, category limit 3", "rec"))
def so_03(spark, sf):
    return fx.rec(spark, sf).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(3)


@query("so_05_paging", fx.sql("select fkey, total from roll order by fkey limit 100 offset 200", "roll"))
def so_05(spark, sf):
    return fx.roll(spark, sf).select("fkey", "total").orderBy("fkey").offset(200).limit(100)


@query("so_07_grouped_lists", "select r_name, string_agg(n_name, ', ' order by n_name) as names from nation join region on n_regionkey = r_regionkey group by r_name")
def so_07(spark, sf):
    n, r = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"))


@query("st_01_union_adapters", fx.sql("select fkey, total, land, null as exempt from rec where l_linenumber <= 3 union all by name select fkey, total, cast(null as bigint) as land, exempt from rec where l_linenumber > 3", "rec"))
def st_01(spark, sf):
    r = fx.rec(spark, sf)
    return r.where("l_linenumber <= 3").select("fkey", "total", "land").unionByName(r.where("l_linenumber > 3").select("fkey", "total", "exempt"), allowMissingColumns=True)


@query("st_02_untouched_and_merged", fx.sql("select fkey, total, 0 as merged from rec where fkey not in (select fkey from rec group by fkey having count(*) > 1) union all select fkey, cast(sum(total) as bigint), 1 from rec group by fkey having count(*) > 1", "rec"))
def st_02(spark, sf):
    g = fx.rec(spark, sf).groupBy("fkey").agg(F.sum("total").alias("total"), F.count("*").alias("n"))
    return g.select("fkey", "total", (F.col("n") > 1).cast("int").alias("merged"))


@query("st_03_exact_duplicates", "select distinct l_orderkey, l_linenumber, l_returnflag from lineitem")
def st_03(spark, sf):
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()


@query("st_04_key_sets", "select 'both' as kind, count(*) as n from (select o_orderkey from orders intersect select l_orderkey from lineitem) union all select 'only', count(*) from (select o_orderkey from orders except select l_orderkey from lineitem)")
def st_04(spark, sf):
    o, l = fx.table(spark, sf, "orders").select("o_orderkey"), fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(o.intersect(l), "both").unionByName(n(o.subtract(l), "only"))
