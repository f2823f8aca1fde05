"""Telemetry windows, episodes and limits; each takes a batch or a streaming frame where its plan allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates of fixed windows; ``late`` sets the watermark of a stream."""
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs).withColumn("start", F.col("w.start")).drop("w")


def episodes(samples: DataFrame, key: str, order: list[str], bad: Column, good_to_close: int = 2) -> DataFrame:
    """Runs of bad samples of a key; a run ends after ``good_to_close`` good ones in a row, not by time.

    (key, episode, n_bad, first, last): an episode starts at a bad sample that
    has no bad one among the ``good_to_close`` before it.
    """
    w = Window.partitionBy(key).orderBy(*order)
    s = samples.withColumn("_bad", bad.cast("int"))
    near = F.coalesce(F.max("_bad").over(w.rowsBetween(-good_to_close, -1)), F.lit(0))
    s = s.withColumn("_start", ((F.col("_bad") == 1) & (near == 0)).cast("int"))
    s = s.withColumn("episode", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where("_bad = 1").groupBy(key, "episode").agg(F.count("*").alias("n_bad"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def over_limit(events: DataFrame, ts: str, width: str, key: str, limit: int) -> DataFrame:
    """Windows of a key with more events than allowed, and by how many."""
    n = tumbling(events, ts, width, [key], [F.count("*").alias("n")])
    return n.where(F.col("n") > limit).withColumn("rejected", F.col("n") - limit)


def debounced(events: DataFrame, ts: str, key: str, width: str, value: str, tie: str) -> DataFrame:
    """The last value of each key in each window."""
    return tumbling(events, ts, width, [key], [F.max_by(value, F.struct(ts, tie)).alias(value)])
