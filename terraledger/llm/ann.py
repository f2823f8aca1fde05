"""Nearest neighbours by shifted Hilbert curves.

Vectors are projected on a few random directions, shifted and quantised, once
for each of ``CURVES`` curves, and every curve orders all of them by Hilbert
index.  The order is range-partitioned and numbered; ``BLOCK`` neighbours form a
block.  Queries lie in homes of as many blocks as half a window has, and search
every block within half a window of their home, so a block goes to three homes
at most, however wide the window is.  The windows' finds of all curves are
merged and ranked by the exact inner product in double precision.

The window is measured, not guessed: up to ``PROBES`` queries are compared with
all vectors, and the window is the smallest with which the curves together
would have met ``RECALL`` of their true neighbours.  Where vectors have
structure it is narrow; on directionless data no order of few curves tells
neighbours from others, and it grows towards all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraledger.llm.hilbert import hilbert_index
from terraledger.llm.scratch import discard, mapped, materialize, ordered_positions, own

#: Neighbours, and the divisor of a query's id.
NEAREST, EVERY = 20, 20
#: Curves; dimensions and bits of each; rows of a block.
CURVES, DIMS, BITS, BLOCK = 3, 8, 7, 256
#: Queries that measure the window, and the recall it must reach on them.
PROBES, RECALL = 64, 0.96


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(classes of equal vectors: cid, vec, asked), (members: cid, vec_id, rank), dimensions.

    A class keeps the k + 1 smallest ids as members: no more of it can be
    among a query's k nearest, whose ties go to smaller ids.
    """
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = own(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(ok)
    most = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dims = most["d"] if most else 1
    plus = F.transform("embedding", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    rows = rows.where(F.size("embedding") == dims).select("vec_id", plus.alias("vec")).withColumns({"g1": F.xxhash64("vec"), "g2": F.xxhash64(F.lit(1), "vec")})
    cls = rows.groupBy("g1", "g2").agg(F.min("vec_id").alias("cid"), F.first("vec").alias("vec"), F.max(F.col("vec_id") % EVERY == 0).alias("asked"))
    cls, _ = materialize(cls)
    named = rows.select("g1", "g2", "vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("g1", "g2").orderBy("vec_id"))).where(F.col("rank") <= k + 1)
    members, _ = materialize(named.join(cls.select("g1", "g2", F.struct("g1", "g2").alias("c")), ["g1", "g2"]).select("g1", "g2", "vec_id", "rank"))
    return cls, members, dims


def _axes(dims: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1000 + curve))
    q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    return q[:, : min(DIMS, dims)], rng.random(min(DIMS, dims))


def curve_rows(cls: DataFrame, dims: int) -> DataFrame:
    """(curve, key, g1, g2, cid, vec, asked): every class on every curve."""
    axes = [_axes(dims, c) for c in range(CURVES)]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros((CURVES, axes[0][0].shape[1])), np.zeros((CURVES, axes[0][0].shape[1]))
        for b in batches:
            v = _matrix(b.column("vec"), dims)
            n += len(v)
            for c, (a, _) in enumerate(axes):
                p = v @ a
                s[c] += p.sum(0)
                q[c] += (p * p).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([s.ravel().tolist()], pa.list_(pa.float64())), pa.array([q.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s", "q"])

    per = mapped(cls.select("vec"), moments, "n double, s array<double>, q array<double>").select("n", F.posexplode(F.arrays_zip("s", "q")).alias("at", "x"))
    sums = per.groupBy("at").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q")).orderBy("at").collect()  # one row a direction
    n = max(sums[0]["n"], 1.0) if sums else 1.0
    mean = np.array([r["s"] for r in sums]).reshape(CURVES, -1) / n
    sd = np.sqrt(np.maximum(np.array([r["q"] for r in sums]).reshape(CURVES, -1) / n - mean**2, 1e-18))
    schema = "curve int, key long, g1 long, g2 long, cid long, vec array<double>, asked boolean"

    rest = ["g1", "g2", "cid", "vec", "asked"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 1 << BITS
        for b in batches:
            v = _matrix(b.column("vec"), dims)
            for c, (a, shift) in enumerate(axes):
                at = ((v @ a - mean[c]) / sd[c] / 6 + 0.5) * (top - 1) + shift  # three deviations either way, shifted by part of a cell
                h = hilbert_index(np.clip(at, 0, top - 1).astype(np.int64), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(h), *(b.column(n) for n in rest)], names=["curve", "key", *rest])

    return mapped(cls.select(*rest), keys, schema)


def window(cls: DataFrame, placed: DataFrame, dims: int, total: int, k: int) -> tuple[int, float]:
    """Half a window in rows, and the recall that the curves reach with it on the probes."""
    probes = cls.where("asked").orderBy(F.xxhash64("g1"), "g1", "g2").limit(PROBES).select("g1", "g2", "vec").collect()
    if not probes:
        return BLOCK, 1.0
    q = np.array([r["vec"] for r in probes])
    ids = [(r["g1"], r["g2"]) for r in probes]
    schema = "p int, g1 long, g2 long, score double"

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = q @ _matrix(b.column("vec"), dims).T
            top = np.argsort(-s, axis=1)[:, : k + 1]
            take = pa.array(top.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), top.shape[1])), b.column("g1").take(take), b.column("g2").take(take), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["p", "g1", "g2", "score"])

    near = mapped(cls.select("g1", "g2", "vec"), nearest, schema)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "g1", "g2"))).where(F.col("r") <= k + 1)
    where = placed.select("curve", "g1", "g2", "pos")
    at = best.join(where, ["g1", "g2"]).select("p", "g1", "g2", "curve", "pos").collect()  # at most PROBES * (k + 1) * CURVES rows
    home = {(ids[r["p"]], r["curve"]): r["pos"] for r in at if (r["g1"], r["g2"]) == ids[r["p"]]}
    gap: dict[tuple, int] = {}
    for r in at:
        mine = (ids[r["p"]], r["curve"])
        if (r["g1"], r["g2"]) != ids[r["p"]] and mine in home:
            key = (r["p"], r["g1"], r["g2"])
            gap[key] = min(gap.get(key, total), abs(r["pos"] - home[mine]))
    if not gap:
        return BLOCK, 1.0
    gaps = np.sort(np.array(list(gap.values())))
    half = int(gaps[min(len(gaps) - 1, int(np.ceil(RECALL * len(gaps))) - 1)])
    return half, float((gaps <= half).mean())


def search(vectors: DataFrame, k: int = NEAREST, half: int | None = None) -> DataFrame:
    """The k nearest found of every query (vec_id divisible by ``EVERY``): query_id, rank, vec_id, score.

    Nearness is the inner product in double precision; ties go to the smaller
    vec_id.  Vectors that are null, zero, of another length than most, or hold
    null or non-finite components take no part, and rows without a vec_id
    cannot be named.  Repeated (vec_id, vector) rows count once.  With fewer
    than k candidates a query gets all of them.  ``half`` is half a window in
    rows; without it the window is measured.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    cls, members, dims = classes(vectors, k)
    total = cls.count()
    rows = curve_rows(cls, dims)
    placed, path = ordered_positions(rows, run=["curve", "key"], tie=["g1", "g2"], carry=["curve", "g1", "g2", "cid", "vec", "asked"])
    placed = placed.withColumn("pos", F.col("pos") - F.col("curve") * total)
    if half is None:
        half, _ = window(cls, placed, dims, total, k)
    reach = max(1, -(-half // BLOCK))
    homes = -(-max(1, -(-total // BLOCK)) // reach)
    at = F.col("block")
    searched_by = F.sequence(F.greatest(F.lit(0), F.floor(at / reach) - 1).cast("int"), F.least(F.lit(homes - 1), F.floor(at / reach) + 1).cast("int"))
    packed = placed.groupBy("curve", (F.col("pos") / BLOCK).cast("int").alias("block")).agg(F.collect_list(F.struct("g1", "g2", "cid", "vec", "asked")).alias("rows"))
    packed, packed_path = materialize(packed)
    asked = packed.select("curve", F.floor(at / reach).cast("int").alias("home"), F.filter("rows", lambda x: x["asked"]).alias("rows"), F.lit(-1).alias("block")).where(F.size("rows") > 0)
    data = packed.select("curve", F.explode(searched_by).alias("home"), "rows", "block")
    both = asked.unionByName(data).repartition("curve", "home").sortWithinPartitions("curve", "home", "block")
    schema = "q1 long, q2 long, g1 long, g2 long, cid long, score double"

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, qid, best, ids = None, [], [], None, None

        def out():
            if not qid:
                return []
            keep = np.isfinite(best)
            n = keep.sum(1)
            a = np.repeat(np.concatenate(qid), n, axis=0)
            b = ids[keep]
            return [pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(b[:, 0]), pa.array(b[:, 1]), pa.array(b[:, 2]), pa.array(best[keep])], names=["q1", "q2", "g1", "g2", "cid", "score"])]

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                key = (one.column("curve")[0].as_py(), one.column("home")[0].as_py())
                if key != now:
                    yield from out()
                    now, q, qid, best, ids = key, [], [], None, None
                held = one.column("rows").flatten()
                v = _matrix(held.field("vec"), dims)
                g = np.stack([held.field(n).to_numpy() for n in ("g1", "g2", "cid")], axis=1)
                if one.column("block")[0].as_py() < 0:
                    q.append(v), qid.append(g)
                    continue
                if not q:
                    continue
                if best is None:
                    q = [np.concatenate(q)]
                    best, ids = np.full((len(q[0]), k + 1), -np.inf), np.zeros((len(q[0]), k + 1, 3), dtype=np.int64)
                s = q[0] @ v.T
                m = min(k + 1, len(v))
                least = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]  # what comes within rounding of the last one goes on, too
                m = int((s >= least - 1e-9 * np.abs(s).max(axis=1, keepdims=True)).sum(1).max())
                top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(v) else np.tile(np.arange(m), (len(s), 1))
                exact = np.stack([(q[0] * v[top[:, j]]).sum(1) for j in range(m)], axis=1)  # one order of summation for all
                best, ids = np.concatenate([best, exact], axis=1), np.concatenate([ids, g[top]], axis=1)
                order = np.lexsort((ids[:, :, 2], -best), axis=1)[:, : k + 1]
                best, ids = np.take_along_axis(best, order, 1), np.take_along_axis(ids, order[:, :, None], 1)
        yield from out()

    found = mapped(both, rank, schema).groupBy("q1", "q2", "g1", "g2", "cid").agg(F.max("score").alias("score"))
    per = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "cid")  # a class's least id stands for it, so ties fall as they do among vectors
    found, _ = materialize(found.withColumn("r", F.row_number().over(per)).where(F.col("r") <= k + 1).drop("r"))
    discard(spark, path, packed_path)
    named = found.join(members, ["g1", "g2"]).select("q1", "q2", "vec_id", "score").distinct()
    near = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    lists = named.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    key = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    queries = own(vectors, "vec_id", "embedding").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64(key).alias("q1"), F.xxhash64(F.lit(1), key).alias("q2")).distinct()
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return queries.join(lists, ["q1", "q2"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
