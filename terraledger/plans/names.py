"""Names and what they tell: of fields, categories, developments and columns that must not be published; limits that follow from a table's own numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraledger.functions import fields, rings
from terraledger.operators import classify, hexgrid, ranks, spatial, stats
from terraledger.plans import fixtures as fx
from terraledger.plans.parcels import _POLY, _poly
from terraledger.plans.registry import query


def _pick(values, at):
    """One of a few texts by a number, in Spark."""
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _sql(values):
    """A list of texts in SQL."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ------------------------------------------------------------------ fields

_KIND = ("LAND", "Market", "total", "bldg", "improved", "other", "impr lot")
_FIELD = f"concat_ws('_', ({_sql(_KIND)})[1 + p_partkey % {len(_KIND)}], lower(p_type), case when p_partkey % 3 = 0 then 'Value' when p_partkey % 3 = 1 then 'valuation ' || p_name end)"


@query("pj_26_value_field_score", f"""select p_brand, arg_min(name, [score, p_partkey]) as name, min(score) as score from (select p_brand, p_partkey, name, round(case when list_contains(t, 'land') then 0 when len(list_intersect(t, ['property', 'market', 'total'])) > 0 then 100 when len(list_intersect(t, ['building', 'bldg'])) > 0 or len(list_filter(t, lambda x: starts_with(x, 'impr'))) > 0 then 200 else 300 end
  - case when contains(lower(name), 'valu') then 20 else 0 end + len(t) * 0.5 + least(20.0, length(name) / 50.0), 6) as score from (select *, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '') as t from (select p_brand, p_partkey, {_FIELD} as name from part))) group by p_brand""")
def pj_26(spark, sf):
    """The field to show first, of those that a brand's parts name."""
    k = F.col("p_partkey")
    name = F.concat_ws("_", _pick(_KIND, k % len(_KIND)), F.lower("p_type"), F.when(k % 3 == 0, "Value").when(k % 3 == 1, F.concat(F.lit("valuation "), F.col("p_name"))))
    p = fx.table(spark, sf, "part").select("p_brand", "p_partkey", name.alias("name")).withColumn("score", F.round(fields.value_score(F.col("name")), 6))
    return p.groupBy("p_brand").agg(F.min_by("name", F.struct("score", "p_partkey")).alias("name"), F.min("score").alias("score"))


_COLUMN = ("PIN", "LANDVAL", "tot_mktlnd", "Impr_Val", "ClassCode", "parcelid", "o_custkey", "Lu_Type", "totalLAND_VALUE")
_ROLES = ", ".join(f"('{r}', {_sql(p)})" for r, p in fields.SUGGESTIONS.items())


@query("sf_27_field_suggestion", f"""select p_brand, role, arg_min(name, [i, p_partkey]) as name from (select p_brand, p_partkey, name, role, list_position(pats, list_filter(pats, lambda p: contains(lower(t), p))[1]) as i from
  (select *, name || ' ' || p_name as t from (select p_brand, p_partkey, p_name, ({_sql(_COLUMN)})[1 + p_partkey % {len(_COLUMN)}] || p_size as name from part)), (values {_ROLES}) r(role, pats)) where i > 0 group by p_brand, role""")
def sf_27(spark, sf):
    """For each role the field whose name or alias contains its earliest pattern; of several, the first."""
    name = F.concat(_pick(_COLUMN, F.col("p_partkey") % len(_COLUMN)), F.col("p_size").cast("string"))
    f = fx.table(spark, sf, "part").select("p_brand", "p_partkey", name.alias("name"), F.concat_ws(" ", name, "p_name").alias("t"))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), fields.suggestion(r, F.col("t")).alias("i")) for r in fields.SUGGESTIONS])
    hits = f.select("p_brand", "p_partkey", "name", F.explode(roles).alias("r")).where("r.i is not null")
    return hits.groupBy("p_brand", "r.role").agg(F.min_by("name", F.struct("r.i", "p_partkey")).alias("name"))


_CATEGORY = (" VACANT ", "vacant", "", "parking LOT", "Industrial", "Under developed", "underDeveloped", "Vacant Lot", "Parking lot ")


@query("cs_21_under_categories", f"""select nation, wanted, have, row_number() over (partition by nation order by i) as place from (select c_nationkey as nation, d.name as wanted, d.i, arg_min(trim(v), c_custkey) as have from
  (select c_nationkey, c_custkey, ({_sql(_CATEGORY)})[1 + (c_custkey * 5 + c_nationkey) % {len(_CATEGORY)}] as v from customer where true) join (values {", ".join(f"({i}, '{n}')" for i, n in enumerate(fields.UNDERUSED))}) d(i, name) on lower(trim(v)) = lower(d.name) group by 1, 2, 3)""")
def cs_21(spark, sf):
    """The default categories that a place has, in the defaults' order and the place's own spelling, met first."""
    k = F.col("c_custkey")
    have = fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), k.alias("k"), F.trim(_pick(_CATEGORY, (k * 5 + F.col("c_nationkey")) % len(_CATEGORY))).alias("name"))
    return classify.named_defaults(have, "nation", "name", "k", fields.UNDERUSED)


_SCREEN = ("owner", "OWNER_NAME", "name", "tnt_name", "senior_exem", "Stars", "mail_name", "street", "taxpayer", "site_owner")


@query("fl_19_sensitive_columns", f"""select p_partkey, c, regexp_matches(c, '((^|_)(owner|ownername|owner_name|parcel_owner|mail_name|taxpayer)($|_)|^name$)', 'i') or regexp_matches(c, '^(senior_exe|vet_exempt|stars?|starc|amtdelinqu|yrsdelinqu)', 'i') as hit
  from (select p_partkey, ({_sql(_SCREEN)})[1 + p_partkey % {len(_SCREEN)}] || case when p_partkey % 4 = 0 then '' when p_partkey % 4 = 1 then '_' || lower(p_type) else 'x' end as c from part)""")
def fl_19(spark, sf):
    """Column names of a dictionary that tell who owns, or how a household fares."""
    k = F.col("p_partkey")
    c = F.concat(_pick(_SCREEN, k % len(_SCREEN)), F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("_"), F.lower("p_type"))).otherwise("x"))
    return fx.table(spark, sf, "part").select("p_partkey", c.alias("c")).withColumn("hit", F.col("c").rlike(fields.PERSONAL) | F.col("c").rlike(fields.SENSITIVE))


# ------------------------------------------------------------------ places

_TAIL = ("Condos Unit", "PUD", "Second Phase", "2nd Filing", "C Block A", "Amended", "at the Lake 77")
_PLACE = f"p_name || ' at ' || p_type || ' ' || ({_sql(_TAIL)})[1 + p_partkey % {len(_TAIL)}] || ' ' || p_size"


@query("sf_11_subdivision", f"""select p_partkey, list_filter(w, lambda x: not list_contains({_sql(fields.EMPTY_WORDS)}, x))[1] as root,
  array_to_string(list_filter(w[1:coalesce(nullif(list_position(list_transform(w, lambda x: list_contains({_sql(fields.LAST_WORDS)}, x)), true), 0), len(w) + 1) - 1], lambda x: not list_contains({_sql(fields.EMPTY_WORDS)}, x) and not regexp_full_match(x, '[A-Z]|[0-9]+(ST|ND|RD|TH)?'))[1:3], ' ') as family
  from (select p_partkey, regexp_extract_all(upper({_PLACE}), '[A-Z0-9]+') as w from part)""")
def sf_11_subdivision(spark, sf):
    """First telling word, and the words that a subdivision shares with its phases."""
    text = F.concat_ws(" ", "p_name", F.lit("at"), "p_type", _pick(_TAIL, F.col("p_partkey") % len(_TAIL)), F.col("p_size").cast("string"))
    return fx.table(spark, sf, "part").select("p_partkey", fields.subdivision_root(text).alias("root"), fields.subdivision_family(text).alias("family"))


@query("sf_31_development", """select p_partkey, case p_partkey % 6 when 0 then upper(p_name) || ' ' || p_size when 1 then upper(p_name) when 2 then 'DOWNTOWN | ' || p_size || ' QUAY LOFTS' when 3 then upper(p_name) || ' COURT' when 4 then 'DOWNTOWN' else '' end as development from part""")
def sf_31(spark, sf):
    """Development names out of legal descriptions in the forms that occur."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    text = classify.first_match([
        (k % 6 == 0, F.concat(name, F.lit("  "), size, F.lit(", Phase 3, Lot 12"))), (k % 6 == 1, F.concat(name, F.lit(" Townhomes, Common Area"))), (k % 6 == 2, F.concat(F.lit("DOWNTOWN, LOT 5, "), size, F.lit(" Quay Lofts Units 1-9"))),
        (k % 6 == 3, F.concat(F.lit("Common Area, North Bank, Block 2, "), name, F.lit(" Court"))), (k % 6 == 4, F.lit("Downtown, Parcel 2, Blk 7"))], F.lit(" , ,"))
    return fx.table(spark, sf, "part").select("p_partkey", fields.development(text).alias("development"))


# ------------------------------------------------------------------ sizes and heights


@query("cs_19_error_flags", fx.sql(f"""select fkey, l_partkey, l_suppkey, total, case when mode = 'perLand' and (land_size is null or land_size <= 0) then '{classify.SIZE_ERRORS["land"]}' when mode = 'perBuilding' and building < 0 then '{classify.SIZE_ERRORS["negative"]}' when mode = 'perBuilding' and coalesce(building, 0) = 0 then '{classify.SIZE_ERRORS["zero"]}' end as message
  from (select *, case l_linenumber % 3 when 0 then 'perLand' when 1 then 'perBuilding' else 'value' end as mode, case when qty % 5 = 0 then 0 when qty % 5 = 1 then null else qty end as land_size, case when qty % 7 = 0 then null else qty - 10 end as building from rec)""", "rec"))
def cs_19(spark, sf):
    """What is said of records whose size does not allow the rate that is shown."""
    q, line = F.col("qty"), F.col("l_linenumber")
    mode = F.when(line % 3 == 0, "perLand").when(line % 3 == 1, "perBuilding").otherwise("value")
    message = classify.size_error(mode, F.when(q % 5 == 0, 0).when(q % 5 != 1, q), F.when(q % 7 != 0, q - 10))
    return fx.rec(spark, sf).select("fkey", "l_partkey", "l_suppkey", "total", message.alias("message"))


@query("pj_08_inverted_rank", fx.sql("select fkey, round((4 - len(list_filter(b, lambda x: x <= least(land, 90000)))) / 4.0 * 1.5, 6) as height from roll, (select list_distinct([quantile_cont(land, 0.2), quantile_cont(land, 0.4), quantile_cont(land, 0.6), quantile_cont(land, 0.8)]) as b from roll)", "roll"))
def pj_08_rank(spark, sf):
    """Heights that fall by fifths of the values: the dearest fifth is lowest."""
    r = fx.roll(spark, sf).select("fkey", "land")
    breaks = ranks.percentiles(r, ["land"], [20, 40, 60, 80]).select(stats.rising(F.col("p")).alias("b"))
    height = stats.inverted_rank(F.least("land", F.lit(90000)), F.col("b"), 5) * 1.5
    return r.crossJoin(F.broadcast(breaks)).select("fkey", F.round(height, 6).alias("height"))  # one row


@query("sp_22_ladder", fx.sql(f"""select region, array_to_string(kept, ',') as kept, coalesce(least_zoom, 13) - 1 as hex_maxzoom, coalesce(least_zoom, 13) as parcel_minzoom from (select region, case when count(*) filter (where fine) > 0 then list(r order by r) filter (where fine) else [7] end as kept, min(z) filter (where not fine and (r > 7 or n_fine > 0)) as least_zoom from
  (select *, count(*) filter (where fine) over (partition by region) as n_fine from (select region, r, z, hex >= median as fine from (select region, count(*) * 500 * (n_nationkey % 4 + 1) as n, quantile_cont(area * pow(7.0, n_nationkey % 4) / 10, 0.5) as median from par group by region, n_nationkey),
   (values {", ".join(f"({r}, {low}, {rings.HEX_AREAS[r]})" for r, (low, _) in hexgrid.BANDS.items())}) b(r, z, hex) where not (n > 1000000 and r > 10) and not (n > 600000 and r > 11))) group by region)""", "par"))
def sp_22(spark, sf):
    """Which hexagons stand for each region's parcels, from their number and median area."""
    p = fx.par(spark, sf).withColumn("m2", F.col("area") * F.pow(F.lit(7.0), F.col("n_nationkey") % 4) / 10)
    m = ranks.percentiles(p, ["m2"], [50], ["region", "n_nationkey"])
    n = F.col("n") * 500 * (F.col("n_nationkey") % 4 + 1)
    return m.select("region", hexgrid.ladder(n, F.col("p")[0]).alias("l")).select("region", F.array_join(F.transform("l.kept", lambda r: r.cast("string")), ",").alias("kept"), "l.hex_maxzoom", "l.parcel_minzoom")


@query("sp_01_geodesic_area", fx.sql("""select fkey, round((max(case when r = 1 then abs(s) end) - coalesce(sum(case when r > 1 then abs(s) end), 0)) * 10.76391041671, 3) as sqft from (select fkey, r, sum((ax - ox) * (by_ - oy) - (bx - ox) * (ay - oy)) / 2 as s from (select *, min(ax) over (partition by fkey) as ox, min(ay) over (partition by fkey) as oy from (select fkey, r, radians(a.x / 100000 - 95) * 6378137.0 * k as ax, radians(b.x / 100000 - 95) * 6378137.0 * k as bx,
   (1 - e * e) * (sa / (1 - e * e * sa * sa) - ln((1 - e * sa) / (1 + e * sa)) / (2 * e)) * 6378137.0 / (2 * k) as ay, (1 - e * e) * (sb / (1 - e * e * sb * sb) - ln((1 - e * sb) / (1 + e * sb)) / (2 * e)) * 6378137.0 / (2 * k) as by_
   from (select *, sin(radians(a.y / 100000 + 29)) as sa, sin(radians(b.y / 100000 + 29)) as sb, 0.0818191908426215::double as e, cos(radians(30)) / sqrt(1 - 0.0818191908426215::double * 0.0818191908426215::double * 0.25) as k from edge))) group by fkey, r) group by fkey""", "geo", more=_POLY))
def sp_01_geodesic(spark, sf):
    """Square feet of polygons in degrees, holes subtracted."""
    degrees = F.transform("rings", lambda r: F.transform(r, lambda v: F.struct((v["x"] / 100000 - 95).alias("x"), (v["y"] / 100000 + 29).alias("y"))))
    return _poly(spark, sf).select("fkey", F.round(spatial.geodesic_area(degrees), 3).alias("sqft"))


@query("sp_27_ring_resolution", fx.sql(f"""select o_custkey, case when m <= 0 then 9 else list_position(errs, list_min(errs)) - 1 end as res from (select o_custkey, m, list_transform([{", ".join(map(str, rings.HEX_AREAS))}], lambda h: abs(h - m)) as errs from (select o_custkey, max(abs(s)) as m from
  (select fkey, sum((a.x * 0.001 * w) * (b.y * 0.001 * 111320) - (b.x * 0.001 * w) * (a.y * 0.001 * 111320)) / 2 as s from (select *, 111320 * cos(radians(fkey % 60)) as w from edge where r = 1) group by fkey) join geo using (fkey) group by o_custkey))""", "geo", more=_POLY))
def sp_27_rings(spark, sf):
    """The resolution of a layer from the largest of its rings, in metres."""
    degrees = F.transform(F.element_at("rings", 1), lambda v: F.struct((v["x"] * 0.001).alias("x"), (v["y"] * 0.001).alias("y")))
    p = _poly(spark, sf).select("fkey", rings.metric_area(degrees, F.col("fkey") % 60).alias("a")).join(fx.geo(spark, sf).select("fkey", "o_custkey"), "fkey")
    return p.groupBy("o_custkey").agg(F.max("a").alias("a")).select("o_custkey", rings.resolution(F.col("a")).cast("long").alias("res"))
