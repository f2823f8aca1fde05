"""Long scans in blocks that are finished one by one.

A block's rows go to their own folder, which a job replaces as a whole, and
only then does the block enter the journal.  So a run that stopped at any
point goes on with the blocks that are missing, and its table ends as that of
a run that was never stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def finished(spark: SparkSession, path: str) -> set[int]:
    """Blocks that are in the journal: one number each."""
    where = f"{path.rstrip('/')}/journal"
    return {r[0] for r in spark.read.schema("block long").parquet(where).distinct().collect()} if _exists(spark, where) else set()


def advance(spark: SparkSession, blocks: Iterable[int], make: Callable[[int], DataFrame], path: str, at_once: int = 8) -> DataFrame:
    """The table of all ``blocks``: those not yet in the journal are made now, ``at_once`` in a job."""
    path = path.rstrip("/")
    done = finished(spark, path)
    todo = [b for b in blocks if b not in done]
    for i in range(0, len(todo), at_once):
        some = todo[i : i + at_once]
        rows = make(some[0]).withColumn("block", F.lit(some[0]).cast("long"))
        for b in some[1:]:
            rows = rows.unionByName(make(b).withColumn("block", F.lit(b).cast("long")))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{path}/rows")
        spark.range(1).select(F.explode(F.array(*[F.lit(b).cast("long") for b in some])).alias("block")).write.mode("append").parquet(f"{path}/journal")
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(spark.read.parquet(f"{path}/journal").distinct()), "block", "left_semi").drop("block")  # one number a block
