"""Greedy assignment of members to prioritised candidates, in rounds that give the sequential result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraledger.operators.lineage import saved


def greedy(candidates: DataFrame, members: DataFrame, least: int = 2, enough: Column | None = None) -> DataFrame:
    """(cand, member): members taken by candidates in the order of ``rank``, best (smallest) first.

    ``candidates`` has cand and a total order ``rank``; ``members`` has cand, member
    and weight.  A candidate takes its members that are still free if their weights
    reach ``least``, else none; ``enough`` is another test on their weight ``w``, their
    number ``n`` and whether the member of the candidate's own id is among them, ``whole``.  In each round every candidate decides that comes
    first among the undecided ones on all its free members: nothing that decides
    before it can touch them, so the result is that of one after the other.
    Rounds are as many as the longest chain of candidates that wait on each other.
    """
    open_ = saved(members.join(candidates.select("cand", "rank"), "cand").select("cand", "rank", "member", "weight").distinct())
    taken = []
    enough = F.col("w") >= least if enough is None else enough
    while not open_.isEmpty():  # the best one left decides in every round, so this ends
        ahead = F.col("rank") > F.min("rank").over(Window.partitionBy("member"))
        state = open_.withColumn("waits", ahead)
        ready = state.groupBy("cand").agg(F.bool_or("waits").alias("waits"), F.sum("weight").alias("w"), F.count("*").alias("n"), F.bool_or(F.col("member") == F.col("cand")).alias("whole")).where("not waits")
        now = saved(ready.select("cand", enough.alias("takes")))
        got = saved(open_.join(now.where("takes"), "cand").select("cand", "member"))
        taken.append(got)
        open_ = saved(open_.join(now.select("cand"), "cand", "left_anti").join(got.select("member"), "member", "left_anti").select("cand", "rank", "member", "weight"))
    out = open_.select("cand", "member").where(F.lit(False))
    for t in taken:
        out = out.unionByName(t)
    return out
