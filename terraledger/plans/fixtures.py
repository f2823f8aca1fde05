"""Synthetic parcel tables over the TPC-H-like ones, for Spark and for DuckDB.

``rec`` value records (lineitem), ``geo`` footprints (orders), ``bld`` buildings
(customer), ``roll`` records rolled up to footprints, ``par`` parcels = roll with
geometry, owner and region.  Rectangles have integer corners, so overlaps and
areas are exact on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraledger.operators import metrics, rollup

REC_SQL = """
rec as (select l_orderkey as fkey, cast(floor(l_extendedprice) as bigint) as total,
  case when l_linenumber = 7 then cast(0 as bigint)
       else cast(floor(l_extendedprice * (20 + 600 * l_discount) / 100) as bigint) end as land,
  l_returnflag || l_linestatus as category, case when l_tax >= 0.08 then 1 else 0 end as exempt,
  l_partkey, l_suppkey, l_linenumber, cast(floor(l_quantity) as bigint) as qty, l_shipdate from lineitem)"""

GEO_SQL = """
geo as (select o_orderkey as fkey, (o_orderkey % 250) * 40 as x0, (o_orderkey % 250) * 40 + 20 + o_custkey % 45 as x1,
  cast(floor(o_orderkey / 250) as bigint) * 40 as y0, cast(floor(o_orderkey / 250) as bigint) * 40 + 20 + o_custkey % 37 as y1,
  o_custkey from orders)"""

BLD_SQL = """
bld as (select c_custkey as bid, (c_custkey * 37 % 250) * 40 + 5 as bx0, (c_custkey * 37 % 250) * 40 + 25 + c_nationkey as bx1,
  (c_custkey % 60) * 40 + 5 as by0, (c_custkey % 60) * 40 + 30 as by1,
  case c_custkey % 5 when 0 then 'parking' when 1 then 'roof' when 2 then 'garage' else 'house' end as bclass,
  c_custkey % 7 as floors from customer)"""

ROLL_SQL = """
dom as (select fkey, category, sum(total) as v from rec group by fkey, category),
cat as (select fkey, category from (select *, row_number() over (partition by fkey order by v desc, category desc) as r from dom) where r = 1),
roll as (select a.fkey, a.land, a.total, a.total - a.land as impr, a.n, a.exempt, cat.category from
  (select fkey, cast(sum(land) as bigint) as land, cast(sum(total) as bigint) as total, count(*) as n, max(exempt) as exempt from rec group by fkey) a
  join cat on a.fkey = cat.fkey)"""

PAR_SQL = """
par as (select roll.*, geo.x0, geo.x1, geo.y0, geo.y1, (x1 - x0) * (y1 - y0) as area, geo.o_custkey, n_nationkey, n_name as region, r_name as district
  from roll join geo on roll.fkey = geo.fkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

LOT_SQL = """
lot as (select p_partkey as lot, (p_partkey * 13 % 250) * 40 + 10 as x0, (p_partkey * 13 % 250) * 40 + 20 + p_size as x1,
  (p_partkey % 60) * 40 + 8 as y0, (p_partkey % 60) * 40 + 18 + p_size % 30 as y1, p_size, p_type, p_brand,
  case when p_partkey % 11 = 0 then 'osm' else 'ml' end as source from part)"""

_PARTS = {"rec": REC_SQL, "geo": GEO_SQL, "bld": BLD_SQL, "roll": ROLL_SQL, "par": PAR_SQL, "lot": LOT_SQL}
_NEEDS = {"roll": ["rec"], "par": ["rec", "geo", "roll"]}


def sql(body: str, *names: str, more: str = "") -> str:
    """``body`` under the fixtures it names, as DuckDB SQL; ``more``: further CTEs."""
    order = [n for n in _PARTS if n in names or any(n in _NEEDS.get(m, []) for m in names)]
    ctes = ",".join(_PARTS[n] for n in order)
    if more:
        ctes = f"{ctes},{more}" if ctes else more
    return f"with {ctes} {body}" if ctes else body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rec(spark: SparkSession, sf: str) -> DataFrame:
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("fkey"), F.floor(price).cast("bigint").alias("total"),
        F.when(F.col("l_linenumber") == 7, F.lit(0).cast("bigint")).otherwise(F.floor(price * (20 + 600 * disc) / 100).cast("bigint")).alias("land"),
        F.concat("l_returnflag", "l_linestatus").alias("category"), F.when(F.col("l_tax") >= 0.08, 1).otherwise(0).alias("exempt"),
        "l_partkey", "l_suppkey", "l_linenumber", F.floor("l_quantity").cast("bigint").alias("qty"), "l_shipdate")


def geo(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (k % 250) * 40, F.floor(k / 250).cast("bigint") * 40
    return table(spark, sf, "orders").select(k.alias("fkey"), x.alias("x0"), (x + 20 + c % 45).alias("x1"), y.alias("y0"), (y + 20 + c % 37).alias("y1"), "o_custkey")


def bld(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 0, "parking").when(k % 5 == 1, "roof").when(k % 5 == 2, "garage").otherwise("house")
    return table(spark, sf, "customer").select(
        k.alias("bid"), ((k * 37 % 250) * 40 + 5).alias("bx0"), ((k * 37 % 250) * 40 + 25 + F.col("c_nationkey")).alias("bx1"),
        ((k % 60) * 40 + 5).alias("by0"), ((k % 60) * 40 + 30).alias("by1"), kind.alias("bclass"), (k % 7).alias("floors"))


def lot(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        k.alias("lot"), ((k * 13 % 250) * 40 + 10).alias("x0"), ((k * 13 % 250) * 40 + 20 + s).alias("x1"),
        ((k % 60) * 40 + 8).alias("y0"), ((k % 60) * 40 + 18 + s % 30).alias("y1"), "p_size", "p_type", "p_brand",
        F.when(k % 11 == 0, "osm").otherwise("ml").alias("source"))


def roll(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.roll_up(rec(spark, sf), "fkey")


def par(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("region"), "n_regionkey")
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("district"))
    out = roll(spark, sf).join(geo(spark, sf), "fkey").join(c, "o_custkey").join(n, "n_nationkey").join(r, "n_regionkey")
    return out.withColumn("area", metrics.rect_area("x0", "x1", "y0", "y1"))
