"""Queries over field names, filters, joins and small sources of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terraledger.functions import fields
from terraledger.operators import classify, metrics, ranks, rollup, spatial
from terraledger.plans import fixtures as fx
from terraledger.plans.registry import query
from terraledger.sources import files

GEO, BLD, LOT = ("x0", "x1", "y0", "y1"), ("bx0", "bx1", "by0", "by1"), ("lx0", "lx1", "ly0", "ly1")
_HIT = "x0 < bx1 and bx0 < x1 and y0 < by1 and by0 < y1"


def T(spark, sf, name):
    return fx.table(spark, sf, name)


# ------------------------------------------------------------------ field picking


@query("pj_17_candidate_pick", "select o_orderkey, cast(o_totalprice as double) as value from orders")
def pj_17(spark, sf):
    """The first of several names that the table has."""
    o = T(spark, sf, "orders")
    name = metrics.first_existing(o, ["full_market_value", "total_value", "o_totalprice", "o_custkey"])
    return o.select("o_orderkey", F.col(name).cast("double").alias("value"))


@query("pj_18_property_trim", "select c_custkey, c_name, c_acctbal from customer")
def pj_18(spark, sf):
    """Only the columns that a dictionary names, and the system's own; others never reach the scan."""
    c = T(spark, sf, "customer")
    keep = {"c_name", "c_acctbal", "not_there"} | {"c_custkey"}
    return c.select(*[x for x in c.columns if x in keep])


@query("pj_24_popup_rates", fx.sql("""select fkey, case when acres is null or acres <= 0 then land_rate else coalesce(land_rate, land / (acres * 43560.0)) end as land_rate,
  case when acres is null or acres <= 0 then null else total / (acres * 43560.0) end as total_rate from (select fkey, land, total, case when fkey % 5 = 0 then null when fkey % 5 = 1 then 0.0 else area / 43560.0 end as acres, case when fkey % 3 = 0 then land * 2.0 end as land_rate from par)""", "par"))  # fmt: skip
def pj_24(spark, sf):
    """Rates per square foot, made only where none is stored and an area over zero is known."""
    k = F.col("fkey")
    p = fx.par(spark, sf).select("fkey", "land", "total", F.when(k % 5 == 0, None).when(k % 5 == 1, 0.0).otherwise(F.col("area") / 43560.0).alias("acres"), F.when(k % 3 == 0, F.col("land") * 2.0).alias("land_rate"))
    known = F.coalesce(F.col("acres") > 0, F.lit(False))
    rate = lambda v: F.when(known, F.col(v) / (F.col("acres") * 43560.0))
    return p.select("fkey", F.coalesce("land_rate", rate("land")).alias("land_rate"), rate("total").alias("total_rate"))


# ------------------------------------------------------------------ filters and joins


@query("fl_04_original_category", fx.sql("select fkey from par where category = 'NO'", "par"))
def fl_04(spark, sf):
    """Equality with a chosen category; an empty choice lets all pass."""
    return fx.par(spark, sf).where(classify.chosen(F.col("category"), "NO")).select("fkey")


@query("fl_06_drop_remnants", fx.sql("select fkey from par where coalesce(case when fkey % 9 = 0 then null else fkey % 4 end, 0) <> 1", "par"))
def fl_06(spark, sf):
    """Rows not flagged as remnants; a null flag is none."""
    flag = F.when(F.col("fkey") % 9 != 0, F.col("fkey") % 4)
    return fx.par(spark, sf).where(F.coalesce(flag.cast("int"), F.lit(0)) != 1).select("fkey")


@query("fl_17_valid_geometry", fx.sql("select fkey from (select fkey, case when fkey % 7 = 0 then null when fkey % 7 = 1 then x0 else x1 end as x1, x0, y0, y1 from geo) where x1 is not null and x1 > x0 and y1 > y0", "geo"))
def fl_17(spark, sf):
    """Geometry that is there and not empty."""
    k = F.col("fkey")
    g = fx.geo(spark, sf).withColumn("x1", F.when(k % 7 == 0, None).when(k % 7 == 1, F.col("x0")).otherwise(F.col("x1")))
    return g.where("x1 is not null and x1 > x0 and y1 > y0").select("fkey")


@query("jn_02_inner_join", fx.sql("select geo.fkey, land, total, x0, y0 from geo join roll on geo.fkey = roll.fkey", "geo", "roll"))
def jn_02(spark, sf):
    return fx.geo(spark, sf).select("fkey", "x0", "y0").join(fx.roll(spark, sf).select("fkey", "land", "total"), "fkey")


@query("jn_06_suffixes", "select o_orderkey as key, o.o_comment_len as len_order, l.n as lines, l.len as len_line from (select o_orderkey, length(o_orderstatus || o_orderpriority) as o_comment_len from orders) o join (select l_orderkey, count(*) as n, max(length(l_returnflag || l_linestatus)) as len from lineitem group by 1) l on o_orderkey = l_orderkey")
def jn_06(spark, sf):
    """Keys of different names, and a column of one name on both sides told apart by suffixes."""
    o = T(spark, sf, "orders").select("o_orderkey", F.length(F.concat("o_orderstatus", "o_orderpriority")).alias("len")).alias("a")
    l = T(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.max(F.length(F.concat("l_returnflag", "l_linestatus"))).alias("len")).alias("b")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("key"), F.col("a.len").alias("len_order"), "lines", F.col("b.len").alias("len_line"))


@query("jn_33_centroid_clip", "select c_custkey from (select c_custkey, -180 + c_custkey % 360 as lon, -80 + c_custkey % 160 as lat from customer) where lon between -100 and 20 and degrees(2 * atan(exp(ln(tan(pi() / 4 + radians(lat) / 2)))) - pi() / 2) between -40 and 55")
def jn_33(spark, sf):
    """Points projected, taken as centroids there, brought back and kept within a boundary."""
    lon, lat = F.col("c_custkey") % 360 - 180, F.col("c_custkey") % 160 - 80
    x, y = spatial.mercator(lon, lat)
    back_lon, back_lat = spatial.unmercator(x, y)
    return T(spark, sf, "customer").where(F.round(back_lon, 9).between(-100, 20) & back_lat.between(-40, 55)).select("c_custkey")


@query("jn_32_staged_attach", fx.sql("""select lot, min(g) as g, min(how) as how from (
    select a.lot, arg_max(u.g, [u.n, -u.g]) as g, 'name' as how from ca a join (select fkey % 50 as name, g, max(n) as n from unit group by 1, 2) u on a.name = u.name group by a.lot
    union all select a.lot, arg_max(t.g, [t.n, -t.g]), 'touch' from (select * from ca where lot not in (select a.lot from ca a join unit u on a.name = u.fkey % 50)) a join unit t on a.x0 <= t.x1 and t.x0 <= a.x1 and a.y0 <= t.y1 and t.y0 <= a.y1 where t.g not in (select g from named) group by a.lot) group by lot""",
    "geo", "lot", more="""unit as (select fkey, o_custkey % 40 as g, count(*) over (partition by o_custkey % 40) as n, x0, x1, y0, y1 from geo where fkey % 50 < 30),
    ca as (select lot, case when lot % 4 = 0 then lot % 100 else -1 end as name, x0, x1, y0, y1 from lot),
    named as (select distinct g from (select a.lot, arg_max(u.g, [u.n, -u.g]) as g from ca a join (select fkey % 50 as name, g, max(n) as n from unit group by 1, 2) u on a.name = u.name group by a.lot))"""))  # fmt: skip
def jn_32(spark, sf):
    """Common areas go to the largest unit group of their name; the others by touch, only to groups that got none by name."""
    g = fx.geo(spark, sf).where("fkey % 50 < 30").select("fkey", (F.col("o_custkey") % 40).alias("g"), (F.col("fkey") % 50).alias("name"), *GEO)
    size = g.groupBy("g").agg(F.count("*").alias("n"))
    unit = g.join(size, "g")
    k = F.col("lot")
    ca = fx.lot(spark, sf).select("lot", F.when(k % 4 == 0, k % 100).otherwise(-1).alias("name"), *[F.col(c).alias("l" + c) for c in GEO])
    best = F.max_by("g", F.struct("n", -F.col("g"))).alias("g")
    names = unit.groupBy("name", "g").agg(F.max("n").alias("n"))
    by_name = ca.join(names, "name").groupBy("lot").agg(best).withColumn("how", F.lit("name"))
    free = unit.join(by_name.select("g").distinct(), "g", "left_anti")
    touch = spatial.overlapping(ca.join(by_name, "lot", "left_anti").drop("name"), free, ("lx0", "lx1", "ly0", "ly1"), GEO, touch=True)
    return by_name.unionByName(touch.groupBy("lot").agg(best).withColumn("how", F.lit("touch")))


@query("ag_34_row_max", fx.sql("select fkey, greatest(land, case when fkey % 4 = 0 then null else impr end) as most from par", "par"))
def ag_34(spark, sf):
    """The larger of two columns; a null is passed over."""
    return fx.par(spark, sf).select("fkey", F.greatest("land", F.when(F.col("fkey") % 4 != 0, F.col("impr"))).alias("most"))


@query("st_05_source_union", fx.sql("""select lot, source from lot where source = 'ml' union all select lot, source from lot o where source = 'osm' and
  (select coalesce(sum((least(o.x1, m.x1) - greatest(o.x0, m.x0)) * (least(o.y1, m.y1) - greatest(o.y0, m.y0))), 0) from lot m where m.source = 'ml' and o.x0 < m.x1 and m.x0 < o.x1 and o.y0 < m.y1 and m.y0 < o.y1) < 0.5 * (x1 - x0) * (y1 - y0)""", "lot"))  # fmt: skip
def st_05(spark, sf):
    """One source whole, and of the other what the first does not cover by half."""
    l = fx.lot(spark, sf)
    o, m = l.where("source = 'osm'").select("lot", *GEO), l.where("source = 'ml'")
    over = spatial.overlapping(o, m.select(*[F.col(c).alias("l" + c) for c in GEO]), GEO, LOT).groupBy("lot").agg(F.sum("shared").alias("s"))
    rest = o.join(over, "lot", "left").where(F.coalesce("s", F.lit(0)) < metrics.rect_area(*GEO) * 0.5)
    return m.select("lot", "source").unionByName(rest.select("lot", F.lit("osm").alias("source")))


# ------------------------------------------------------------------ text and expressions

_ADDRESS = "case c_custkey % 8 when 0 then c_custkey || ' Main St Apt 4' when 1 then c_custkey || '  Oak  Ave #12' when 2 then 'None' when 3 then c_custkey || ' Elm St A12-3' when 4 then c_custkey || ' Pine Rd 7B' when 5 then c_custkey || ' Elm St (+3 more)' when 6 then '' else c_custkey || ' High St' end"


@query("sf_11_base_address", f"""select c_custkey, case when t is null or t in ('', 'NONE') then null else t end as base from (select c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\s+\\(\\+\\d+\\s+MORE\\)$', ''), '\\s+(APT|UNIT|STE|SUITE|BLDG|BUILDING|#)\\s*.*$', ''), '\\s+[A-Z]\\d+[A-Z0-9-]*$', ''), '\\s+\\d+[A-Z]?$', ''), '\\s+', ' ', 'g')) as t
  from (select c_custkey, upper(trim(regexp_replace({_ADDRESS}, '\\s+', ' ', 'g'))) as t from customer) where true)""")  # fmt: skip
def sf_11(spark, sf):
    k = F.col("c_custkey")
    s = k.cast("string")
    made = classify.first_match([(k % 8 == i, F.concat(s, F.lit(x)) if x.startswith(" ") else F.lit(x)) for i, x in enumerate((" Main St Apt 4", "  Oak  Ave #12", "None", " Elm St A12-3", " Pine Rd 7B", " Elm St (+3 more)", ""))], F.concat(s, F.lit(" High St")))
    return T(spark, sf, "customer").select("c_custkey", fields.base_address(made).alias("base"))


@query("sf_18_where_mask", fx.sql("select fkey, case when land > 20000 then land end as kept, case when land > 20000 then 0 else land end as masked, coalesce(nullif(land, 0), impr, 0) as filled from par", "par"))
def sf_18(spark, sf):
    big = F.col("land") > 20000
    return fx.par(spark, sf).select("fkey", F.when(big, F.col("land")).alias("kept"), F.when(big, 0).otherwise(F.col("land")).alias("masked"), F.coalesce(F.nullif("land", F.lit(0)), "impr", F.lit(0)).alias("filled"))


@query("sf_21_map_functions", fx.sql("select district, region, n, row_number() over (partition by district order by n desc, region) as place from (select district, region, count(*) as n from par group by 1, 2)", "par"))
def sf_21(spark, sf):
    """Region counts of a district as a map, its items sorted, and looked up again."""
    per = fx.par(spark, sf).groupBy("district", "region").agg(F.count("*").alias("n"))
    m = per.groupBy("district").agg(F.map_from_entries(F.collect_list(F.struct("region", "n"))).alias("m"))  # a few regions a district
    items = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct((-e["value"]).alias("down"), e["key"].alias("region"))))
    return m.select("district", "m", F.posexplode(items).alias("i", "e")).select("district", "e.region", F.element_at("m", F.col("e.region")).alias("n"), (F.col("i") + 1).cast("long").alias("place"))


_STYLE = ["case", ["all", ["==", ["get", "category"], "NO"], [">", ["to-number", ["get", "land"]], 20000]], ["interpolate", ["linear"], ["to-number", ["get", "land"]], 20000, 1, 100000, 5],
          ["any", ["in", ["get", "region"], ["literal", ["FRANCE", "CHINA"]]], ["!", ["boolean", ["get", "big"]]]], ["step", ["/", ["*", ["get", "land"], 100], ["max", ["get", "total"], 1]], 0, 25, 1, 50, 2, 75, 3],
          ["match", ["get", "category"], ["AF", "RF"], ["+", ["zoom"], 1], "RO", ["coalesce", ["feature-state", "hover"], -1], 9]]


@query("sf_28_expression", fx.sql("""select fkey, round(case when category = 'NO' and land > 20000 then case when land <= 20000 then 1 when land <= 100000 then 1 + 4.0 * (land - 20000) / 80000 else 5 end
  when region in ('FRANCE', 'CHINA') or not (area > 900) then case when land * 100.0 / greatest(total, 1) >= 75 then 3 when land * 100.0 / greatest(total, 1) >= 50 then 2 when land * 100.0 / greatest(total, 1) >= 25 then 1 else 0 end
  when category in ('AF', 'RF') then 13 when category = 'RO' then -1 else 9 end, 6) as v from par""", "par"))  # fmt: skip
def sf_28(spark, sf):
    """A nested style expression over parcels."""
    p = fx.par(spark, sf).withColumn("big", F.col("area") > 900)
    return p.select("fkey", F.round(fields.expression(_STYLE, zoom=12).cast("double"), 6).alias("v"))


@query("sf_29_metadata_parse", "select page_id, 'k' || page_id as city_key, 'Name ' || page_id as display_name, page_id % 2 = 0 as pmtiles from pages")
def sf_29(spark, sf):
    """Cells beside bold labels of a markdown table."""
    k = F.col("page_id").cast("string")
    doc = F.concat(F.lit("# City\n| **City key** | `k"), k, F.lit("` |\n| **Display name** | Name "), k, F.lit(" |\n| **PMTiles recommended** | "), F.when(F.col("page_id") % 2 == 0, "Yes, large").otherwise("no"), F.lit(" |\n"))
    p = T(spark, sf, "pages").select("page_id", doc.alias("d"))
    return p.select("page_id", fields.metadata_field(F.col("d"), "City key").alias("city_key"), fields.metadata_field(F.col("d"), "Display name").alias("display_name"), F.lower(fields.metadata_field(F.col("d"), "PMTiles recommended")).contains("yes").alias("pmtiles"))


# ------------------------------------------------------------------ classes


@query("cs_18_condo_eligible", fx.sql("select fkey, n > 3 and total > 0 and (total - land) * 1.0 / total >= 0.5 as condo, n > 3 and total > 0 and (total - land) * 1.0 / total >= 0.5 and exempt = 1 as leasehold, n > 3 and total > 0 and (total - land) * 1.0 / total >= 0.5 and exempt = 0 as eligible from par", "par"))
def cs_18(spark, sf):
    """A regime whose unsplit records carry most value; on exempt land it is a leasehold and keeps its zero."""
    share = metrics.safe_div(F.col("total") - F.col("land"), "total", 0.0)
    condo = (F.col("n") > 3) & (share >= 0.5)
    return fx.par(spark, sf).select("fkey", condo.alias("condo"), (condo & (F.col("exempt") == 1)).alias("leasehold"), (condo & (F.col("exempt") != 1)).alias("eligible"))


@query("cs_22_stub_mask", fx.sql("select fkey, stub, stub and land <= 0 as dropped from (select fkey, land, area < 1000 and (dev is not null or (impr > 0 and case when stated > 0 then stated else area end < 600)) as stub from (select fkey, land, impr, area, case when o_custkey % 4 = 0 then 'D' || o_custkey end as dev, case when fkey % 3 = 0 then 0.0 else (fkey % 40) / 1000.0 * 43560 end as stated from (select fkey, impr, area, o_custkey, case when fkey % 6 = 0 then 0 else land end as land from par)))", "par"))
def cs_22(spark, sf):
    """Placeholder units: a tiny footprint that belongs to a plat or has a building on hardly any land; those without land value go."""
    k = F.col("fkey")
    p = fx.par(spark, sf).select("fkey", "impr", "area", F.when(k % 6 == 0, 0).otherwise(F.col("land")).alias("land"), F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("D"), F.col("o_custkey").cast("string"))).alias("dev"), F.when(k % 3 == 0, 0.0).otherwise(k % 40 / 1000.0 * 43560).alias("stated"))
    own = F.when(F.col("stated") > 0, F.col("stated")).otherwise(F.col("area"))
    stub = (F.col("area") < 1000) & (F.col("dev").isNotNull() | ((F.col("impr") > 0) & (own < 600)))
    return p.select("fkey", stub.alias("stub"), (stub & (F.col("land") <= 0)).alias("dropped"))


@query("cs_17_units_and_tracts", fx.sql("""select fkey, unit, (tract or max(case when tract then 1 else 0 end) over (partition by pin) = 1) and not unit as tract from (select *, not unit and pin <> '' and (tax = '' or (starts_with(tax, '0') and area > 1500 and land <= 30000 and coalesce(sum(case when unit then 1 else 0 end) over (partition by root), 0) >= 2)) as tract from
  (select *, cand and (strc = 'T' or strc like '%CONDO%' or tax in ('1112') or (strc = '' and stack > 1)) as unit from (select *, sum(case when cand then 1 else 0 end) over (partition by pt) as stack from (select *, tax <> '' and pin <> '' and lgl <= 0 as cand from acct))))""", "par",
  more="""acct as (select fkey, land, area, case fkey % 5 when 0 then '' when 1 then '0100' when 2 then '1112' else '2112' end as tax, case when fkey % 23 = 0 then '' else 'P' || (fkey % 1700) end as pin, fkey % 3 as lgl, case fkey % 7 when 0 then 'T' when 1 then 'LOW CONDO' when 2 then '' else 'H' end as strc, x0 || ',' || (y0 % 80) as pt, o_custkey % 200 as root from par)"""))
def cs_17(spark, sf):
    """Units (classed accounts without ground of their own that are attached or stacked) and the ground tracts they stand on.

    A tract's account is blank, or vacant land of a nominal value under a plan with several units; all rows of its number count.
    """
    k = F.col("fkey")
    a = fx.par(spark, sf).select(
        "fkey", "land", "area", classify.first_match([(k % 5 == 0, ""), (k % 5 == 1, "0100"), (k % 5 == 2, "1112")], "2112").alias("tax"), F.when(k % 23 == 0, "").otherwise(F.concat(F.lit("P"), (k % 1700).cast("string"))).alias("pin"),
        (k % 3).alias("lgl"), classify.first_match([(k % 7 == 0, "T"), (k % 7 == 1, "LOW CONDO"), (k % 7 == 2, "")], "H").alias("strc"), F.concat_ws(",", "x0", F.col("y0") % 80).alias("pt"), (F.col("o_custkey") % 200).alias("root"))
    cand = (F.col("tax") != "") & (F.col("pin") != "") & (F.col("lgl") <= 0)
    count = lambda c, key: F.count_if(c).over(Window.partitionBy(key))
    a = a.withColumn("stack", count(cand, "pt"))
    unit = cand & ((F.col("strc") == "T") | F.col("strc").contains("CONDO") | F.col("tax").isin("1112") | ((F.col("strc") == "") & (F.col("stack") > 1)))
    a = a.withColumn("unit", unit).withColumn("in_root", count(F.col("unit"), "root"))
    nominal = F.col("tax").startswith("0") & (F.col("area") > 1500) & (F.col("land") <= 30000) & (F.col("in_root") >= 2)
    a = a.withColumn("tract", ~F.col("unit") & (F.col("pin") != "") & ((F.col("tax") == "") | nominal))
    return a.select("fkey", "unit", ((F.col("tract") | F.bool_or("tract").over(Window.partitionBy("pin"))) & ~F.col("unit")).alias("tract"))


@query("cs_13_footprint_retag", fx.sql(f"""select fkey, coalesce(v, 0) as parking_value, coalesce(a, 0) as parking_area, case when coalesce(v, 0) > 0 then 'Parking Lot' when refined <> 'Parking Lot' then refined end as refined from
  (select fkey, case fkey % 4 when 0 then 'Parking Lot' when 1 then 'Vacant' end as refined from par) p left join (select fkey as k, sum(shared * 1.0 * land / area) as v, cast(sum(shared) as bigint) as a from (select fkey, land, area, (least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0)) as shared from par join bld on {_HIT} where bclass = 'parking') group by 1) on fkey = k""", "par", "bld"))  # fmt: skip
def cs_13(spark, sf):
    """Parcels with any surface parking are parking lots; the tag is reset first, so a second run gives the same."""
    p = fx.par(spark, sf)
    k = F.col("fkey")
    base = p.select("fkey", F.when(k % 4 == 0, "Parking Lot").when(k % 4 == 1, "Vacant").alias("refined"))
    hit = spatial.overlapping(p.select("fkey", "land", "area", *GEO), fx.bld(spark, sf).where("bclass = 'parking'"), GEO, BLD)
    per = hit.groupBy("fkey").agg(F.sum(F.col("shared") * F.col("land") / F.col("area")).alias("v"), F.sum("shared").alias("a"))
    value = F.coalesce("v", F.lit(0))
    kept = F.when(F.col("refined") != "Parking Lot", F.col("refined"))
    return base.join(per, "fkey", "left").select("fkey", value.alias("parking_value"), F.coalesce("a", F.lit(0)).alias("parking_area"), F.when(value > 0, "Parking Lot").otherwise(kept).alias("refined"))


# ------------------------------------------------------------------ scans and sinks


@query("sc_04_column_median", fx.sql("select round(quantile_cont(land, 0.5), 6) as mid, count(*) as n from par where land > 0", "par"))
def sc_04(spark, sf):
    """The median of one column, read alone and whole rather than from a few row groups."""
    p = ranks.percentiles(fx.par(spark, sf).where("land > 0"), ["land"], [50])
    return p.select(F.round(F.col("p")[0], 6).alias("mid"), "n")


#: Tile column and row at zoom 6, for points and for the corners of a box alike.
_TX, _TY = "cast(floor(({} + 180) / 360 * 64) as bigint)", "cast(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * 64) as bigint)"


@query("sc_08_tile_scan", f"select c_custkey, {_TX.format('lon')} as x, {_TY.format('lat')} as y from (select c_custkey, c_custkey % 360 - 180 + 0.5 as lon, c_custkey % 160 - 80 + 0.5 as lat from customer) where {_TX.format('lon')} between {_TX.format('-100')} and {_TX.format('44')} and {_TY.format('lat')} between {_TY.format('55.7')} and {_TY.format('-30')}")
def sc_08(spark, sf):
    """Points as tiles of one zoom, and those tiles that a box touches."""
    lon, lat = F.col("c_custkey") % 360 - 180 + 0.5, F.col("c_custkey") % 160 - 80 + 0.5
    x, y = spatial.tile(lon, lat, 6)
    t = T(spark, sf, "customer").select("c_custkey", F.lit(6).alias("z"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    return files.tile_range(t, (-100, -30, 44, 55.7), 6).select("c_custkey", "x", "y")


@query("sc_24_nested_bbox", fx.sql("select fkey from geo where x0 between 1000 and 6000 and y1 between 100 and 1500", "geo"))
def sc_24(spark, sf):
    """A predicate on the fields of a nested box."""
    g = fx.geo(spark, sf).select("fkey", F.struct(F.col("x0").alias("xmin"), F.col("y1").alias("ymax")).alias("bbox"))
    return g.where(F.col("bbox.xmin").between(1000, 6000) & F.col("bbox.ymax").between(100, 1500)).select("fkey")


@query("sk_04_metadata", fx.sql("select '{\"record_count\":' || count(*) || ',\"statistics\":{\"land\":{\"min\":' || min(land) || ',\"max\":' || max(land) || '},\"total\":{\"min\":' || min(total) || ',\"max\":' || max(total) || '}},\"categories\":{\"category\":[' || (select string_agg('\"' || category || '\"', ',' order by category) from (select distinct category from par)) || ']}}' as value from par", "par"))
def sk_04(spark, sf):
    """The metadata document of a table."""
    return files.metadata(fx.par(spark, sf), ["land", "total"], ["category"])


@query("ud_04_layer_transforms", fx.sql("select fkey, upper(region) as region_key, substr(district, 1, 2) as zone from par", "par"))
def ud_04(spark, sf):
    """Columns made by a list of (source, target, rule)."""
    rules = [("region", "region_key", F.upper), ("district", "zone", lambda c: F.substring(c, 1, 2))]
    return fx.par(spark, sf).select("fkey", *[rule(F.col(src)).alias(dst) for src, dst, rule in rules])


@query("sm_04_bounded_state", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 24")
def sm_04(spark, sf):
    """A history of bounded length: the newest 24 of a key, limited before the shuffle."""
    return rollup.first_by(T(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 24).select("user_id", "event_id")
