"""Data-quality checks: one aggregation, one row a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(cond: Column) -> Column:
    """Aggregate: share of rows where a condition holds."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def suite(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, ok): all checks from one pass over ``df``."""
    one = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks.values())])
    return one.select(F.expr("stack({}, {})".format(len(checks), ", ".join(f"'{n}', c{i}" for i, n in enumerate(checks)))).alias("name", "ok"))
