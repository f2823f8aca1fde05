"""Roll-up, dedupe and share operators over value records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roll_up(rec: DataFrame, key: str) -> DataFrame:
    """Records summed to one row a key, with the category that carries most value (ties: last name).

    Two-level aggregation: (key, category) first, so that both sums and the
    dominant category come from one shuffle of partial sums.
    """
    per = rec.groupBy(key, "category").agg(F.sum("land").alias("land"), F.sum("total").alias("total"), F.count("*").alias("n"), F.max("exempt").alias("exempt"))
    return per.groupBy(key).agg(
        F.sum("land").alias("land"), F.sum("total").alias("total"), (F.sum("total") - F.sum("land")).alias("impr"), F.sum("n").alias("n"),
        F.max("exempt").alias("exempt"), F.max_by("category", F.struct("total", "category")).alias("category"))


def dominant(df: DataFrame, key: Sequence[str], cat: str, weight: str) -> DataFrame:
    """key, cat, weight of the category with the largest summed weight; ties go to the smallest name."""
    per = df.groupBy(*key, cat).agg(F.sum(weight).alias("w"))
    return per.groupBy(*key).agg(F.min_by(F.struct(cat, "w"), F.struct(-F.col("w"), F.col(cat))).alias("m")).select(*key, f"m.{cat}", F.col("m.w").alias("weight"))


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order (group-limited before the shuffle)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_value(c: str, order: Sequence[str]) -> Column:
    """Aggregate: the first non-null value of ``c`` in the order given."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))


def share(value: str | Column, key: Sequence[str]) -> Column:
    """A row's share of its group's sum; equal shares where the sum is zero."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*key)
    s = F.sum(v).over(w)
    return F.when(s != 0, v / s).otherwise(1.0 / F.count("*").over(w))


def encode(df: DataFrame, c: str) -> DataFrame:
    """(value, id, n): ids by descending count, then name; null is -1."""
    per = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return per.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1)


def sums(df: DataFrame, sets: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Totals of the whole and of each of several single-column groupings: (field, name, sums...)."""
    out = df.groupingSets([[], *[[F.col(s)] for s in sets]], *[F.col(s) for s in sets]).agg(*aggs, *[F.grouping(s).alias(f"_g_{s}") for s in sets])
    field, name = F.lit("(all)"), F.lit("(all)")
    for s in sets:
        field = F.when(F.col(f"_g_{s}") == 0, s).otherwise(field)
        name = F.when(F.col(f"_g_{s}") == 0, F.coalesce(F.col(s), F.lit("(None)"))).otherwise(name)
    return out.select(field.alias("field"), name.alias("name"), *[c for c in out.columns if c not in sets and not c.startswith("_g_")])
