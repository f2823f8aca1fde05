"""Hilbert-curve sharding: multidimensional order, cut into runs of equal bytes.

Metadata dimensions (language, source, size) are quantised to ``bits`` bits
each; rows are sorted by their cell's index on the Hilbert curve and the sorted
run is cut into shards.  Neighbouring cells land in the same shard, so the
min/max statistics of a shard's files prune on every dimension.

Rows with equal texts share one cell, that of their smallest (doc_id, lang,
source), and lie side by side.  A group of equal texts goes whole into one
shard; only one larger than a shard's share is cut, into as few and equal parts
as fit.  Groups and parts over ``LARGE`` of a share, a bounded number, are dealt
first, the largest to where most room is; the curve's run of all others is then
cut where the room left in each shard ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraledger.llm.hilbert import hilbert_index
from terraledger.llm.scratch import materialize, ordered_positions, own, small_table

#: Share of a shard from which a group is dealt on its own: at most shards / LARGE groups.
LARGE = 0.01


def curve_table(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """(cell, curve) of every cell: 2**(dims * bits) rows, whatever the data."""
    cells = np.arange(1 << (dims * bits))
    points = np.stack([(cells >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)], axis=1)
    return spark.createDataFrame(pa.table({"cell": cells, "curve": hilbert_index(points, bits)}))


def quantised(value: Column, bits: int) -> Column:
    """A string as a coordinate: its first two characters, order kept, on ``bits`` bits; null is 0."""
    s = F.lower(F.coalesce(value, F.lit("")))
    def at(i):
        c = F.ascii(F.substring(s, i, 1))
        return F.when(c.between(97, 122), c - 96).when(c.between(48, 57), c - 21).when(c == 0, 0).otherwise(37)
    return F.floor((at(1) * 38 + at(2)) * (1 << bits) / (38 * 38)).cast("long")


def tail_number(value: Column, bits: int) -> Column:
    """Trailing digits of a string modulo 2**bits, so that numbered sources keep their order; hash otherwise."""
    digits = F.regexp_extract(F.coalesce(value, F.lit("")), r"(\d{1,9})$", 1)
    return F.when(digits != "", F.pmod(digits.try_cast("long"), F.lit(1 << bits))).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << bits))).cast("long")


def deal(units: list[tuple[int, int]], total: int, shards: int) -> tuple[list[int], list[float]]:
    """Shards of ``units`` (bytes, number), and the bytes of other rows that end before each shard's end.

    The largest unit goes first, to the shard with most room; ties to the lower number.
    """
    room = [total / shards] * shards
    to = [0] * len(units)
    for size, k in sorted(units, key=lambda u: (-u[0], u[1])):
        best = max(range(shards), key=lambda x: (room[x], -x))
        room[best] -= size
        to[k] = best
    free = np.maximum(room, 0.0)
    rest = total - sum(u[0] for u in units)
    ends = np.cumsum(free * (rest / free.sum() if free.sum() else 0))
    return to, ends.tolist()


def shard(docs: DataFrame, shards: int = 16, bits: int = 5) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1).  The law is
    ``bytes``: a shard holds its share of all bytes, up to about one document or
    a group of ``LARGE`` of that share; groups of equal texts near a whole share
    that do not pack evenly add at most what they differ by.  ``slot`` is gapless
    from 0 in each shard: the curve's order, then the large groups.  Null
    metadata counts as empty; repeated rows are separate rows; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = own(docs, "doc_id", "text", "lang", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_g1"), F.xxhash64(F.lit(1), text).alias("_g2"), "lang", "source")
    rows, _ = materialize(rows)
    group = ["_g1", "_g2", "size"]
    lead = rows.groupBy(*group).agg(F.min(F.struct("doc_id", "lang", "source")).alias("_lead"), F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    top = F.lit((1 << bits) - 1)
    dims = [quantised(F.col("_lead.lang"), bits), tail_number(F.col("_lead.source"), bits), F.least(F.floor(F.log2(F.col("size") + F.lit(0.0)) * 1.5), top)]
    cell = F.lit(0).cast("long")
    for d in dims:
        cell = cell * (1 << bits) + d.cast("long")
    groups, _ = materialize(lead.withColumn("cell", cell).join(F.broadcast(curve_table(spark, len(dims), bits)), "cell").select(*group, "_bytes", "_rows", "curve"))
    total = groups.agg(F.sum("_bytes")).first()[0] or 1
    share = total / shards
    big = groups.where(F.col("_bytes") > LARGE * share)
    parts = F.ceil(F.col("_bytes") / share).cast("int")
    large = [(r["_g1"], r["_g2"], r["size"], p, r["_rows"] * p // r["_n"], r["_rows"] * (p + 1) // r["_n"], r["curve"]) for r in big.withColumn("_n", F.least(parts, F.col("_rows"))).orderBy(*group).collect() for p in range(r["_n"])]
    to, ends = deal([((u[5] - u[4]) * u[2], k) for k, u in enumerate(large)], total, shards)

    few = big.select(*group)
    light = rows.drop("lang", "source").join(F.broadcast(few), group, "left_anti").join(groups.where(F.col("_bytes") <= LARGE * share), group)
    run, _ = ordered_positions(light, run=["curve", *group], tie=["doc_id"], carry=["doc_id", "size", "text_crc32", "curve", "_bytes"], weight="size")
    middle = F.col("run_cum") + F.col("_bytes") / 2
    at = sum((F.when(middle >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")
    run = run.select("doc_id", "size", "text_crc32", "curve", "pos", at.alias("shard"))
    first = {r["shard"]: (r["f"], r["n"]) for r in run.groupBy("shard").agg(F.min("pos").alias("f"), F.count("*").alias("n")).collect()}  # a row a shard
    out = run.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("pos") - _of("shard", {s: f for s, (f, _) in first.items()})).alias("slot"))
    if large:
        used = {s: n for s, (_, n) in first.items()}
        plan = []
        for k, u in enumerate(large):
            plan.append((*u[:3], u[4], u[5], u[6], to[k], used.get(to[k], 0)))
            used[to[k]] = used.get(to[k], 0) + u[5] - u[4]
        units = small_table(spark, plan, "_g1 long, _g2 long, size long, _from long, _to long, curve long, shard int, _base long")
        heavy, _ = ordered_positions(rows.drop("lang", "source").join(F.broadcast(few), group, "left_semi"), run=group, tie=["doc_id"], carry=["doc_id", "text_crc32", *group])
        within = F.col("pos") - F.col("run_pos")
        m, u = heavy.withColumn("_at", within).alias("m"), F.broadcast(units).alias("u")
        on = (F.col("m._g1") == F.col("u._g1")) & (F.col("m._g2") == F.col("u._g2")) & (F.col("m.size") == F.col("u.size")) & (F.col("m._at") >= F.col("u._from")) & (F.col("m._at") < F.col("u._to"))
        out = out.unionByName(m.join(u, on).select("doc_id", "m.size", "text_crc32", "u.curve", "u.shard", (F.col("u._base") + F.col("m._at") - F.col("u._from")).alias("slot")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _of(column: str, known: dict[int, int]) -> Column:
    """The value that ``known``, a short table, has for a column."""
    out = F.lit(0).cast("long")
    for k, v in known.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out
