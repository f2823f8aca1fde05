"""Projection, filter, classification and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraledger.functions import scalar
from terraledger.operators import classify, metrics
from terraledger.plans import fixtures as fx
from terraledger.plans.registry import query


@query("pj_01_ratio_fields", fx.sql("""select fkey, total, round(case when land > 0 then impr * 1.0 / land end, 6) as impr_land_ratio, round(case when land > 0 then impr * 100.0 / land end, 6) as impr_land_pct,
  round(case when land + impr > 0 then impr * 100.0 / (land + impr) end, 6) as impr_pct_total, round(case when land + impr > 0 then land * 100.0 / (land + impr) end, 6) as land_pct_total from roll""", "roll"))  # fmt: skip
def pj_01(spark, sf):
    r = metrics.ratio_fields(fx.roll(spark, sf))
    return r.select("fkey", "total", *[F.round(c, 6).alias(c) for c in ("impr_land_ratio", "impr_land_pct", "impr_pct_total", "land_pct_total")])


@query("pj_03_guarded_rate", fx.sql("select fkey, round(coalesce(case when a > 0 then land / (a * 43560) end, total / 1000.0), 6) as rate from (select *, case when fkey % 7 = 0 then 0 when fkey % 11 = 0 then null else area / 43560.0 end as a from par)", "par"))
def pj_03(spark, sf):
    a = F.when(F.col("fkey") % 7 == 0, 0.0).when(F.col("fkey") % 11 != 0, F.col("area") / 43560.0)
    return fx.par(spark, sf).withColumn("a", a).select("fkey", F.round(metrics.per_area("land", "a", F.col("total") / 1000.0), 6).alias("rate"))


@query("pj_04_etl_rate", fx.sql("select fkey, round(land * 1.0 / nullif(case when fkey % 5 = 0 then 0 else area end, 0), 6) as rate from par", "par"))
def pj_04(spark, sf):
    a = F.when(F.col("fkey") % 5 == 0, 0).otherwise(F.col("area"))
    return fx.par(spark, sf).select("fkey", F.round(F.try_divide(F.col("land"), a), 6).alias("rate"))


@query("pj_05_painted_metric", fx.sql("select fkey, round(case when land > 0 then impr * 1.0 / land else 0 end, 6) as painted, round(case when fkey % 3 = 0 then 0 else land * 1.0 / area end, 6) as per_land from par", "par"))
def pj_05(spark, sf):
    den = F.when(F.col("fkey") % 3 == 0, 0).otherwise(F.col("area"))
    return fx.par(spark, sf).select("fkey", F.round(metrics.painted("impr", "land"), 6).alias("painted"), F.round(metrics.painted("land", den), 6).alias("per_land"))


@query("pj_06_stats_metric", fx.sql("select fkey, round(impr * 1.0 / land, 6) as v from roll where land > 0", "roll"))
def pj_06(spark, sf):
    return fx.roll(spark, sf).select("fkey", F.round(metrics.safe_div("impr", "land"), 6).alias("v")).where("v is not null")


@query("pj_07_displayed_metric", fx.sql("select fkey, round(case when total > 0 then land * 100.0 / total end, 6) as v, land > 100000 as large from roll", "roll"))
def pj_07(spark, sf):
    return fx.roll(spark, sf).select("fkey", F.round(metrics.safe_div(F.col("land") * 100, "total"), 6).alias("v"), (F.col("land") > 100000).alias("large"))


@query("pj_08_height", fx.sql("select fkey, round(least(land / 1000.0 * 1.5, 100), 6) as height, round(100 - least(land * 100.0 / greatest(total, 1), 100), 6) as inverted from roll", "roll"))
def pj_08(spark, sf):
    return fx.roll(spark, sf).select("fkey", F.round(F.least(F.col("land") / 1000.0 * 1.5, F.lit(100)), 6).alias("height"), F.round(100 - F.least(F.col("land") * 100.0 / F.greatest("total", F.lit(1)), F.lit(100)), 6).alias("inverted"))


_AREA = "(select *, case when fkey % 4 = 0 then area * 3 when fkey % 4 = 1 then null else area end as reported, case when fkey % 9 = 0 then null else area end as geom from par)"


@query("pj_09_plausible_area", fx.sql(f"select fkey, case when ok then reported else geom end as area, case when ok then 'reported' when geom is not null then 'gis' end as area_source from (select *, coalesce(reported > 0 and (geom is null or reported * 1.0 / geom between 0.5 and 2.0), false) as ok from {_AREA})", "par"))
def pj_09(spark, sf):
    k, a = F.col("fkey"), F.col("area")
    p = fx.par(spark, sf).withColumns({"reported": F.when(k % 4 == 0, a * 3).when(k % 4 != 1, a), "geom": F.when(k % 9 != 0, a)})
    area, source = metrics.plausible_area("reported", "geom")
    return p.select("fkey", area.alias("area"), source.alias("area_source"))


@query("pj_11_area_chain", fx.sql("select fkey, coalesce(case when a > 0 then a end, case when b > 0 then b end, c) as area from (select fkey, case when fkey % 3 = 0 then 0 else area end as a, case when fkey % 2 = 0 then -1 else area * 2 end as b, area * 5 as c from par)", "par"))
def pj_11(spark, sf):
    k, a = F.col("fkey"), F.col("area")
    return fx.par(spark, sf).select("fkey", F.coalesce(metrics.first_positive(F.when(k % 3 == 0, 0).otherwise(a), F.when(k % 2 == 0, -1).otherwise(a * 2)), a * 5).alias("area"))


@query("pj_12_value_stage", fx.sql("select fkey, case when c > 0 then 'certified' when b > 0 then 'board' when m > 0 then 'mailed' end as stage, case when c > 0 then c when b > 0 then b when m > 0 then m end as total from (select fkey, case when fkey % 3 = 0 then 0 else total end as c, case when fkey % 2 = 0 then 0 else total + 1 end as b, total + 2 as m from roll)", "roll"))
def pj_12(spark, sf):
    k, t, l = F.col("fkey"), F.col("total"), F.col("land")
    pick = metrics.staged([("certified", l, F.when(k % 3 == 0, 0).otherwise(t)), ("board", l, F.when(k % 2 == 0, 0).otherwise(t + 1)), ("mailed", l, t + 2)])
    return fx.roll(spark, sf).select("fkey", pick["stage"].alias("stage"), pick["total"].alias("total"))


@query("pj_13_newest_value", fx.sql("select fkey, coalesce(nullif(fkey % 4, 0), nullif(fkey % 3, 0), 9) as value, case when fkey % 4 <> 0 then 'y2024' when fkey % 3 <> 0 then 'y2022' else 'y2020' end as label from geo", "geo"))
def pj_13(spark, sf):
    k = F.col("fkey")
    value, label = metrics.newest([("y2024", F.nullif(k % 4, F.lit(0))), ("y2022", F.nullif(k % 3, F.lit(0))), ("y2020", F.lit(9))])
    return fx.geo(spark, sf).select("fkey", value.alias("value"), label.alias("label"))


@query("pj_14_market_scaling", fx.sql("select fkey, round(sum(total / case category when 'AF' then 0.1 when 'NO' then 0.25 else 1.0 end), 4) as market from rec group by fkey", "rec"))
def pj_14(spark, sf):
    return fx.rec(spark, sf).groupBy("fkey").agg(F.round(F.sum(metrics.market({"AF": 0.1, "NO": 0.25}, "category", "total")), 4).alias("market"))


@query("pj_15_residual", fx.sql("select fkey, l_partkey, l_suppkey, total, case when l is not null then greatest(total - l, 0) end as impr from (select *, case when l_linenumber = 1 then total + 5 when l_linenumber = 2 then null else land end as l from rec)", "rec"))
def pj_15(spark, sf):
    n = F.col("l_linenumber")
    l = F.when(n == 1, F.col("total") + 5).when(n != 2, F.col("land"))
    return fx.rec(spark, sf).select("fkey", "l_partkey", "l_suppkey", "total", metrics.residual("total", l).alias("impr"))


@query("pj_19_missing_columns", fx.sql("select fkey, total, cast(null as double) as land_area_acres, cast(null as varchar) as link from roll", "roll"))
def pj_19(spark, sf):
    r = fx.roll(spark, sf).select("fkey", "total")
    return r.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("land_area_acres", "double"), ("link", "string")) if c not in r.columns])


@query("pj_20_encode_categoricals", fx.sql("""select fkey, coalesce(id, -1) as id from (select fkey, case when fkey % 50 = 0 then null else category end as c from roll) a left join
  (select c as value, row_number() over (order by count(*) desc, c) - 1 as id from (select case when fkey % 50 = 0 then null else category end as c from roll) where c is not null group by c) b on a.c = b.value""", "roll"))  # fmt: skip
def pj_20(spark, sf):
    from terraledger.operators import rollup

    r = fx.roll(spark, sf).select("fkey", F.when(F.col("fkey") % 50 != 0, F.col("category")).alias("value"))
    ids = rollup.encode(r, "value").select("value", F.col("id").cast("long").alias("id"))
    return r.join(ids, "value", "left").select("fkey", F.coalesce("id", F.lit(-1).cast("long")).alias("id"))


@query("pj_22_link", "select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, 'https://example.org/p/' || page_id as link from pages")
def pj_22(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.concat(F.lit("https://example.org/p/"), F.col("page_id").cast("string")).alias("link"))


@query("pj_28_base_year", "select o_custkey, min(year(o_orderdate)) || '-' || max(year(o_orderdate)) || ' (' || count(*) || ' units, median ' || cast(floor(quantile_cont(year(o_orderdate), 0.5)) as bigint) || ')' as label from orders group by o_custkey")
def pj_28(spark, sf):
    y = F.year("o_orderdate")
    mid = F.floor(F.percentile(y, F.lit(0.5)))
    return fx.table(spark, sf, "orders").groupBy("o_custkey").agg(F.concat(F.min(y).cast("string"), F.lit("-"), F.max(y).cast("string"), F.lit(" ("), F.count("*").cast("string"), F.lit(" units, median "), mid.cast("string"), F.lit(")")).alias("label"))


@query("pj_30_denominator", fx.sql("select fkey, case when n > 1 then greatest(area, n * 700) else area end as area from par", "par"))
def pj_30(spark, sf):
    return fx.par(spark, sf).select("fkey", F.when(F.col("n") > 1, F.greatest(F.col("area"), F.col("n") * 700)).otherwise(F.col("area")).alias("area"))


@query("pj_31_market_fallback", fx.sql("select fkey, mv, case when l is not null then greatest(mv - l, 0) end as impr from (select fkey, coalesce(case when fkey % 3 <> 0 then total end, 2 * (total - land)) as mv, case when fkey % 5 <> 0 then land end as l from roll)", "roll"))
def pj_31(spark, sf):
    k = F.col("fkey")
    mv = F.coalesce(F.when(k % 3 != 0, F.col("total")), (F.col("total") - F.col("land")) * 2)
    return fx.roll(spark, sf).select("fkey", mv.alias("mv"), metrics.residual(mv, F.when(k % 5 != 0, F.col("land"))).alias("impr"))


@query("pj_32_finalize", fx.sql("""select fkey, tot as total, round(a / 43560.0, 6) as acres, case when a < 700 then 1 else 0 end as likely_remnant, round(land / a, 6) as rate from (select fkey, land, coalesce(case when fkey % 8 <> 0 then total end, land + impr) as tot,
  coalesce(case when fkey % 3 = 0 then 0.5 else area end >= 1, false) as stated, case when fkey % 3 = 0 then area * 1.1 else area * 1.0 end as a from par where exempt = 0)""", "par"))  # fmt: skip
def pj_32(spark, sf):
    k = F.col("fkey")
    p = fx.par(spark, sf).where("exempt = 0").withColumn("total", F.coalesce(F.when(k % 8 != 0, F.col("total")), F.col("land") + F.col("impr")))
    stated = F.when(k % 3 == 0, 0.5).otherwise(F.col("area").cast("double"))
    a = F.when(stated >= 1, stated).otherwise(F.col("area") * 1.1)
    return p.withColumn("a", a).select("fkey", "total", F.round(F.col("a") / 43560.0, 6).alias("acres"), F.when(F.col("a") < 700, 1).otherwise(0).alias("likely_remnant"), F.round(F.col("land") / F.col("a"), 6).alias("rate"))


@query("fl_02_allow_lists", fx.sql("select 'some' as list, count(*) filter (where category in ('AF', 'NO')) as n from roll union all select 'none', count(*) from roll union all select 'under none', 0", "roll"))
def fl_02(spark, sf):
    def allowed(chosen, all_, strict):
        if strict:
            return F.col("category").isin(chosen) if chosen else F.lit(False)
        return F.col("category").isin(chosen) if 0 < len(chosen) < all_ else F.lit(True)

    n = lambda c: F.count_if(c)
    one = fx.roll(spark, sf).agg(n(allowed(["AF", "NO"], 6, False)).alias("a"), n(allowed([], 6, False)).alias("b"), n(allowed([], 6, True)).alias("c"))
    return one.select(F.expr("stack(3, 'some', a, 'none', b, 'under none', c)").alias("list", "n"))


@query("fl_05_remnants", fx.sql("select fkey from (select fkey, case when fkey % 3 = 0 then 1 when fkey % 3 = 1 then 0 end as r from geo) where coalesce(r, 0) <> 1", "geo"))
def fl_05(spark, sf):
    r = F.when(F.col("fkey") % 3 == 0, 1).when(F.col("fkey") % 3 == 1, 0)
    return fx.geo(spark, sf).where(F.coalesce(r, F.lit(0)) != 1).select("fkey")


@query("fl_07_visible_region_scope", fx.sql("select count(*) as n, cast(sum(land) as bigint) as land, round(sum(area) / 43560.0, 4) as acres from par where region in ('FRANCE', 'CHINA', 'INDIA')", "par"))
def fl_07(spark, sf):
    p = fx.par(spark, sf).where(F.col("region").isin("FRANCE", "CHINA", "INDIA"))
    return p.agg(F.count("*").alias("n"), F.sum("land").alias("land"), F.round(F.sum("area") / 43560.0, 4).alias("acres"))


@query("fl_08_conjunction", fx.sql("select fkey from par where category in ('NO', 'RF') and fkey % 3 <> 0 and district <> 'ASIA'", "par"))
def fl_08(spark, sf):
    return fx.par(spark, sf).where(F.col("category").isin("NO", "RF") & (F.col("fkey") % 3 != 0) & (F.col("district") != "ASIA")).select("fkey")


@query("fl_11_exempt_any", "select s_suppkey from supplier where s_nationkey in (1, 5, 9) or s_name like '%7' or regexp_matches(s_name, '0[13]$')")
def fl_11(spark, sf):
    return fx.table(spark, sf, "supplier").where(F.col("s_nationkey").isin(1, 5, 9) | F.col("s_name").endswith("7") | F.col("s_name").rlike("0[13]$")).select("s_suppkey")


@query("fl_12_exempt_reason", fx.sql("select fkey, case when exempt = 1 and land * 2 >= total then 'share' when total = 0 then 'no value' when n > 5 then 'units' end as reason from roll", "roll"))
def fl_12(spark, sf):
    rules = [((F.col("exempt") == 1) & (F.col("land") * 2 >= F.col("total")), "share"), (F.col("total") == 0, "no value"), (F.col("n") > 5, "units")]
    return fx.roll(spark, sf).select("fkey", classify.first_match(rules).alias("reason"))


@query("fl_14_template_rows", "select doc_id from documents where regexp_matches(source, '^src1?[0-4]$') and trim(lang) <> '' and length(text) between 200 and 900")
def fl_14(spark, sf):
    return fx.table(spark, sf, "documents").where(F.col("source").rlike("^src1?[0-4]$") & (F.trim("lang") != "") & F.length("text").between(200, 900)).select("doc_id")


@query("fl_16_area_range", fx.sql("select fkey from par where area between 500 and 1200", "par"))
def fl_16(spark, sf):
    return fx.par(spark, sf).where(F.col("area").between(500, 1200)).select("fkey")


@query("fl_18_negligible", fx.sql("select ix, iy, acres from (select floor(x0 / 200) as ix, floor(y0 / 200) as iy, round_even(sum(area) / 435600.0, 2) as acres from par group by 1, 2) where acres > 0.01", "par"))
def fl_18(spark, sf):
    g = fx.par(spark, sf).groupBy(F.floor(F.col("x0") / 200).alias("ix"), F.floor(F.col("y0") / 200).alias("iy")).agg(F.bround(F.sum("area") / 435600.0, 2).alias("acres"))
    return g.where("acres > 0.01")


@query("fl_20_anti_membership", fx.sql("select fkey from roll where category not in ('AF', 'AO') and fkey not in (select l_orderkey from lineitem where l_linenumber = 1)", "roll"))
def fl_20(spark, sf):
    used = fx.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("fkey"))
    return fx.roll(spark, sf).where(~F.col("category").isin("AF", "AO")).join(used, "fkey", "left_anti").select("fkey")


@query("fl_24_retired_rows", "select o_orderkey from orders where o_orderdate is null or year(o_orderdate) < 1997")
def fl_24(spark, sf):
    return fx.table(spark, sf, "orders").where(F.col("o_orderdate").isNull() | (F.year("o_orderdate") < 1997)).select("o_orderkey")


@query("cs_04_share_rules", fx.sql("select fkey, case when impr = 0 then 'Vacant' when land >= case when category like 'N%' then 0.67 else 0.5 end * total then 'Underdeveloped' end as kind from roll", "roll"))
def cs_04(spark, sf):
    cut = F.when(F.col("category").startswith("N"), 0.67).otherwise(0.5)
    return fx.roll(spark, sf).select("fkey", classify.first_match([(F.col("impr") == 0, "Vacant"), (F.col("land") >= cut * F.col("total"), "Underdeveloped")]).alias("kind"))


@query("cs_05_keywords", "select p_partkey, case when p_type like '%BRASS%' then 'brass' when p_type like '%STEEL%' then 'steel' when p_type like 'PROMO%' then 'promo' else 'other' end as kind from part")
def cs_05(spark, sf):
    t = F.col("p_type")
    return fx.table(spark, sf, "part").select("p_partkey", classify.first_match([(t.contains("BRASS"), "brass"), (t.contains("STEEL"), "steel"), (t.startswith("PROMO"), "promo")], "other").alias("kind"))


@query("cs_06_code_ranges", "select p_partkey, case when p_size between 1 and 9 then 'small' when p_size between 10 and 29 then 'medium' when p_size >= 30 then 'large' end as kind from part")
def cs_06(spark, sf):
    s = F.col("p_size")
    return fx.table(spark, sf, "part").select("p_partkey", classify.first_match([(s.between(1, 9), "small"), (s.between(10, 29), "medium"), (s >= 30, "large")]).alias("kind"))


@query("cs_11_remnant_variants", fx.sql("select fkey, case when area < 500 then 1 when area < 1000 and land >= 100 * area then 1 else 0 end as likely_remnant from par", "par"))
def cs_11(spark, sf):
    a = F.col("area")
    return fx.par(spark, sf).select("fkey", F.when(a < 500, 1).when((a < 1000) & (F.col("land") >= a * 100), 1).otherwise(0).alias("likely_remnant"))


@query("cs_16_two_basis_share", fx.sql("select fkey, round(coalesce(a, b), 6) as share, case when a is not null then 'current' when b is not null then 'legacy' end as basis from (select fkey, case when fkey % 4 <> 0 and total > 0 then land * 1.0 / total end as a, case when fkey % 3 <> 0 and total > 0 then land * 0.9 / total end as b from roll)", "roll"))
def cs_16(spark, sf):
    k = F.col("fkey")
    value, basis = metrics.newest([("current", F.when((k % 4 != 0) & (F.col("total") > 0), F.col("land") / F.col("total"))), ("legacy", F.when((k % 3 != 0) & (F.col("total") > 0), F.col("land") * 0.9 / F.col("total")))])
    return fx.roll(spark, sf).select("fkey", F.round(value, 6).alias("share"), basis.alias("basis"))


@query("cs_20_status_class", "select event_id, case when s >= 500 then 'server_error' when s = 401 then 'unauthorized' when s = 403 then 'forbidden' when s = 404 then 'not_found' when s = 408 then 'timeout' when s = 429 then 'rate_limited' when s >= 400 then 'client_error' end as kind from (select event_id, [200, 301, 400, 401, 403, 404, 408, 418, 429, 500, 503][event_id % 11 + 1] as s from events)")
def cs_20(spark, sf):
    codes = F.array(*[F.lit(s) for s in (200, 301, 400, 401, 403, 404, 408, 418, 429, 500, 503)])
    e = fx.table(spark, sf, "events").select("event_id", F.element_at(codes, (F.col("event_id") % 11 + 1).cast("int")).alias("s"))
    return e.select("event_id", classify.status(F.col("s")).alias("kind"))


@query("cs_24_prefix_letters", "select p_partkey, case when starts_with(p_type, 'ST') then 'standard' when left(p_type, 1) = 'S' then 'small' when left(p_type, 1) = 'E' then 'economy' else 'rest' end as kind from part")
def cs_24(spark, sf):
    t = F.col("p_type")
    return fx.table(spark, sf, "part").select("p_partkey", classify.first_match([(t.startswith("ST"), "standard"), (t.startswith("S"), "small"), (t.startswith("E"), "economy")], "rest").alias("kind"))


@query("sf_01_to_numeric", "select event_id, try_cast(case when event_id % 3 = 0 then 'x' || event_id else cast(event_id as varchar) end as double) as v from events")
def sf_01(spark, sf):
    e = F.col("event_id")
    return fx.table(spark, sf, "events").select("event_id", scalar.number(F.when(e % 3 == 0, F.concat(F.lit("x"), e.cast("string"))).otherwise(e.cast("string"))).alias("v"))


@query("sf_02_currency", "select event_id, coalesce(cast(try_cast(regexp_replace(regexp_replace(s, '[$,\\s]', '', 'g'), '^\\((.*)\\)$', '-\\1') as double) as varchar), s) as kept, try_cast(regexp_replace(regexp_replace(s, '[$,\\s]', '', 'g'), '^\\((.*)\\)$', '-\\1') as double) as v from (select event_id, case event_id % 4 when 0 then '($1,' || (100 + event_id % 900) || ')' when 1 then '$ ' || event_id when 2 then '12 Main' else '' end as s from events)")
def sf_02(spark, sf):
    e = F.col("event_id")
    s = F.when(e % 4 == 0, F.concat(F.lit("($1,"), (e % 900 + 100).cast("string"), F.lit(")"))).when(e % 4 == 1, F.concat(F.lit("$ "), e.cast("string"))).when(e % 4 == 2, "12 Main").otherwise("")
    return fx.table(spark, sf, "events").select("event_id", scalar.currency_or_text(s).alias("kept"), scalar.currency(s).alias("v"))


@query("sf_03_loose_number", "select event_id, case when s is null or trim(s) = '' then 0.0 else try_cast(s as double) end as v from (select event_id, case event_id % 4 when 0 then null when 1 then ' ' when 2 then 'a' else '7.5' end as s from events)")
def sf_03(spark, sf):
    e = F.col("event_id")
    return fx.table(spark, sf, "events").select("event_id", scalar.loose_number(F.when(e % 4 == 1, " ").when(e % 4 == 2, "a").when(e % 4 == 3, "7.5")).alias("v"))


@query("sf_04_normalise_keys", "select doc_id, replace(replace(upper(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')), 'ß', 'SS'), 'ẞ', 'SS') as k, regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') as slug from documents")
def sf_04(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", scalar.squeezed(F.col("text")).alias("k"), scalar.slug(F.col("source")).alias("slug"))


@query("sf_05_placeholders", "select doc_id, case when lower(trim(s)) not in ('', 'nan', 'none', 'null') then trim(s) end as s from (select doc_id, case doc_id % 5 when 0 then 'NaN' when 1 then ' ' when 2 then 'None' else source end as s from documents)")
def sf_05(spark, sf):
    d = F.col("doc_id")
    return fx.table(spark, sf, "documents").select("doc_id", scalar.folded(F.when(d % 5 == 0, "NaN").when(d % 5 == 1, " ").when(d % 5 == 2, "None").otherwise(F.col("source"))).alias("s"))


@query("sf_06_assemble_ids", "select o_orderkey, lpad(cast(o_custkey as varchar), 6, '0') || '-' || lpad(cast(o_orderkey % 1000 as varchar), 4, '0') as pin, o_custkey * 1000000 + o_orderkey as bbl from orders")
def sf_06(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0")).alias("pin"), (F.col("o_custkey") * 1000000 + F.col("o_orderkey")).alias("bbl"))


@query("sf_07_split_parts", "select p_partkey, split_part(p_type, ' ', 1) as head, array_to_string(string_split(p_type, ' ')[1:2], '-') as two, substr(p_type, 1, 5) as five from part")
def sf_07(spark, sf):
    w = F.split("p_type", " ")
    return fx.table(spark, sf, "part").select("p_partkey", w[0].alias("head"), F.array_join(F.slice(w, 1, 2), "-").alias("two"), F.substring("p_type", 1, 5).alias("five"))


@query("sf_10_title_case", "select n_name, array_to_string(list_transform(string_split('ST ' || n_name || ' OF AND', ' '), lambda x: case when upper(x) = 'ST' then 'St.' when upper(x) in ('AND', 'OF') then lower(x) else upper(left(x, 1)) || lower(substr(x, 2)) end), ' ') as t from nation")
def sf_10(spark, sf):
    return fx.table(spark, sf, "nation").select("n_name", scalar.titled(F.concat(F.lit("ST "), F.col("n_name"), F.lit(" OF AND"))).alias("t"))


@query("sf_13_tokenise", "select page_id, len(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda x: x <> '')) as n, array_to_string(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda x: x <> ''), '|') as t from pages")
def sf_13(spark, sf):
    t = scalar.tokens(F.col("url"))
    return fx.table(spark, sf, "pages").select("page_id", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("t"))


@query("sf_14_compact_money", fx.sql("""select fkey, '$' || case when abs(v) >= 1e9 then printf('%.1f', round(v / 1e9, 1)) || 'B' when abs(v) >= 1e6 then printf('%.1f', round(v / 1e6, 1)) || 'M' when abs(v) >= 1e3 then cast(floor(v / 1e3 + 0.5) as bigint) || 'K' else cast(v as varchar) end as label
  from (select fkey, (total * case fkey % 4 when 0 then 10000 when 1 then 100 when 2 then 1 else 0 end + fkey % 500) * case when fkey % 3 = 0 then -1 else 1 end as v from roll)""", "roll"))  # fmt: skip
def sf_14(spark, sf):
    k = F.col("fkey")
    v = (F.col("total") * F.when(k % 4 == 0, 10000).when(k % 4 == 1, 100).when(k % 4 == 2, 1).otherwise(0) + k % 500) * F.when(k % 3 == 0, -1).otherwise(1)
    return fx.roll(spark, sf).select("fkey", scalar.compact(v).alias("label"))


@query("sf_15_math", fx.sql("select fkey, round(ln(1 + land), 6) as a, round(exp(least(n, 5)), 6) as b, abs(land - impr) as c, cast(ceil(land / 7.0) as bigint) as d, cast(floor(impr / 7.0) as bigint) as e from roll", "roll"))
def sf_15(spark, sf):
    l, i = F.col("land"), F.col("impr")
    return fx.roll(spark, sf).select("fkey", F.round(F.log1p(l), 6).alias("a"), F.round(F.exp(F.least(F.col("n"), F.lit(5))), 6).alias("b"), F.abs(l - i).alias("c"), F.ceil(l / 7.0).alias("d"), F.floor(i / 7.0).alias("e"))


@query("sf_16_clip", fx.sql("select fkey, case when s is not null then least(greatest(s, 0.1), 0.6) end as v from (select fkey, case when total > 0 and fkey % 6 <> 0 then round(land * 1.0 / total, 4) end as s from roll)", "roll"))
def sf_16(spark, sf):
    s = F.when((F.col("total") > 0) & (F.col("fkey") % 6 != 0), F.round(F.col("land") / F.col("total"), 4))
    return fx.roll(spark, sf).select("fkey", scalar.clip(s, 0.1, 0.6).alias("v"))


@query("sf_19_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, year(o_orderdate) * 12 + month(o_orderdate) as m, datediff('day', o_orderdate, timestamp '1999-01-01') as days from orders")
def sf_19(spark, sf):
    d = F.col("o_orderdate")
    return fx.table(spark, sf, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM").alias("month"), (F.year(d) * 12 + F.month(d)).alias("m"), F.datediff(F.lit("1999-01-01").cast("date"), d).alias("days"))


@query("sf_22_json_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' as doc from events")
def sf_22(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return fx.table(spark, sf, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query("sf_23_hash", "select doc_id, md5(text) as h from documents")
def sf_23(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("sf_26_url_predicates", "select page_id, regexp_matches(url, '^https?://[A-Za-z0-9./_-]+$') as safe, contains(url, '?') as versioned from pages")
def sf_26(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", F.col("url").rlike("^https?://[A-Za-z0-9./_-]+$").alias("safe"), F.col("url").contains("?").alias("versioned"))
