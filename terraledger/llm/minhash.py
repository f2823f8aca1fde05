"""MinHash near-dedup by an inverted join over signature coordinates.

A document's set is its distinct five-word shingles.  Equal sets form one
class.  Each class is posted under its ``K`` (coordinate, minimum) pairs.  Two
sets of Jaccard similarity 0.75 agree on 48 of 64 coordinates on average and on
fewer than ``T`` = 30 with probability 3.8e-7, so pairs below T are left out.

*Prefix*: with postings ordered by how many classes share them, two classes with
T common postings have one among the first K - T + 1 of either.  Postings that
nobody shares come first and count, so a class with fewer than T shared ones
is out at once, and the most frequent T - 1 postings are never joined.

*Skip*: within a posting list only members of different components meet.  Short
lists are paired in full; in a long list members meet the hub, its most central
one, only.  First each class meets the hub of its longest list, and the links
found are contracted.  From then on a posting counts only where it lies in
several components: two classes that are not yet joined share T of those, so the
prefix is taken again from them, rarest first, and all members of the lists that
it leaves meet their hubs.  For what is left there is a bound: two sets share at
most what both share with the hub, plus what either shares with anybody outside
the hub.  Pairs that pass it and lie in different components are kept.  No pair
above the threshold is given up to save work.

*Count*: the common postings of the kept pairs are counted, and pairs with T or
more are confirmed on full sets of 64-bit shingle hashes.  The hub's pairs are
compared on full sets at once, as those sizes are what the bound is made of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.llm.exact_dedup import ROW, drop_rows, row_key
from terraledger.llm.graph import components
from terraledger.llm.scratch import Sieve, discard, mapped, materialize, own, slices, with_facts
from terraledger.llm.words import buffers, mixed, random_numbers, words

#: Signature coordinates, least matches of a candidate pair, words in a shingle.
K, T, WORDS = 64, 30, 5
#: Similarity in percent that makes a link.
PERCENT = 75
#: Members up to which a posting list is paired in full at once.
SHORT = 6


_PLACE = random_numbers(WORDS, 100) | np.uint64(1)
_LENGTH = random_numbers(WORDS + 1, 200)
_A = (random_numbers(K, 300) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (random_numbers(K, 400) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and how many each text has."""
    found = words(*buffers(texts))
    w = found.marks
    ends = np.searchsorted(found.owner, np.arange(len(texts)), side="right")
    counts = np.diff(np.r_[0, ends])
    h = np.zeros(len(w), dtype=np.uint64)
    n = max(0, len(w) - WORDS + 1)
    for j in range(WORDS):
        h[:n] += w[j : j + n] * _PLACE[j]
    h = mixed(h + _LENGTH[WORDS], 0xBF58476D1CE4E5B9)
    out, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i in np.flatnonzero(counts).tolist():
        c, e = counts[i], ends[i]
        if c >= WORDS:
            u = np.unique(h[e - c : e - WORDS + 1])
        else:
            u = mixed((w[e - c : e] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True) + _LENGTH[c : c + 1], 0xBF58476D1CE4E5B9)
        out.append(u)
        sizes[i] = len(u)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def signatures(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, K) minima under K bijections of 32 bits; empty sets are left out."""
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), K), dtype=np.uint32)
    if len(sizes):
        x = (flat >> np.uint64(32)).astype(np.uint32)
        for k in range(K):
            out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    return out


def features(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, _h, _nb, n_shingles, cls (identity of the set, null if empty), sig."""
    schema = "doc_id long, _h long, _nb long, n_shingles long, cls binary, sig array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            flat, sizes = shingle_sets(b.column("_text"))
            sig = signatures(flat, sizes).view(np.int32)
            ends = np.cumsum(sizes)
            cls = [xxhash.xxh3_128_digest(flat[e - n : e].tobytes()) if n else None for e, n in zip(ends, sizes, strict=True)]
            at = np.r_[0, np.cumsum(np.where(sizes > 0, K, 0))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_h"), b.column("_nb"), pa.array(sizes), pa.array(cls, pa.binary()), lists],
                names=["doc_id", "_h", "_nb", "n_shingles", "cls", "sig"])

    return mapped(row_key(own(docs, "doc_id", "text")).select(*ROW, "_text"), run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, n, arr, sig): the shingle hashes of each class in ``wanted`` (cls, first, sig), read from the text of its first document."""
    schema = "cls binary, n long, arr array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            flat, sizes = shingle_sets(b.column("_text"))
            ends = np.cumsum(sizes)
            keep = np.flatnonzero(sizes)
            cls = [xxhash.xxh3_128_digest(flat[ends[i] - sizes[i] : ends[i]].tobytes()) for i in keep]
            at = np.r_[0, np.cumsum(sizes[keep])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sizes[keep]), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["cls", "n", "arr"])

    rows = row_key(own(docs, "doc_id", "text")).select("doc_id", "_text")
    sieve = Sieve(wanted, ["first"])
    some = sieve.mark(rows, [F.col("doc_id")]).where("_maybe").select("_text")
    return mapped(some, run, schema).join(wanted.select("cls", "sig"), "cls").dropDuplicates(["cls"])


def _alike(a: str, b: str):
    """Sizes that allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _postings(reps: DataFrame) -> DataFrame:
    """(cls, n, key): the coordinate-value pairs of each class."""
    key = F.shiftleft(F.col("i").cast("long"), 32) + F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return reps.select("cls", "n", F.posexplode("sig").alias("i", "v")).select("cls", "n", key.alias("key"))


def _owned(post: DataFrame, freq: DataFrame) -> DataFrame:
    """(cls, n, own, w): the postings of a class that ``freq`` (key, f) holds, rarest first, and their sum; classes with fewer than T are out."""
    per = post.join(freq, "key").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("own"), F.sum("f").alias("w"))  # at most K a class
    return per.where(F.size("own") >= T)


def _prefix(mine: DataFrame) -> DataFrame:
    """(cls, n, w, key): all but the T - 1 most frequent postings of each class."""
    return mine.select("cls", "n", "w", F.explode(F.expr(f"slice(own, 1, size(own) - {T - 1})")).alias("p")).select("cls", "n", "w", F.col("p.key").alias("key"))


def _hubs(lists: DataFrame) -> DataFrame:
    """(key, size, hub): lists with several members, and the member with most postings in company."""
    return lists.groupBy("key").agg(F.count("*").alias("size"), F.max_by(F.struct("cls", "n"), F.struct("w", "cls")).alias("hub")).where("size > 1")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (u, v) between classes of ``reps`` (cls, first, n, sig) that give every component; each joins what confirmed links join."""
    spark = docs.sparkSession
    post = _postings(reps)
    lists, lists_path = materialize(_prefix(_owned(post, post.groupBy("key").agg(F.count("*").alias("f")).where("f > 1"))))
    sizes, sizes_path = materialize(_hubs(lists))
    wanted, wanted_path = materialize(reps.join(lists.join(sizes.select("key"), "key", "left_semi").select("cls").distinct(), "cls", "left_semi"))
    sets, sets_path = materialize(full_sets(docs, wanted))
    used = lists.join(sizes, "key")
    short, long = used.where(F.col("size") <= SHORT), used.where(F.col("size") > SHORT)
    a, b = short.select("key", F.col("cls").alias("u"), F.col("n").alias("nu")), short.select("key", F.col("cls").alias("v"), F.col("n").alias("nv"))
    full = a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & _alike("nu", "nv")).select("u", "v", F.lit(False).alias("hub"))
    largest = long.groupBy("cls").agg(F.max_by(F.struct("n", "hub"), F.struct("size", "key")).alias("p")).select("cls", "p.n", "p.hub")
    pairs = full.unionAll(_with_hub(largest).withColumn("hub", F.lit(True))).groupBy("u", "v").agg(F.bool_or("hub").alias("hub"))
    met, met_path = materialize(compared(pairs, sets))
    root = components(met.where(_linked("both")).select("u", "v"))
    apart = _several(_rooted(long.select("key", "cls"), root)).select("cls").distinct()
    members, members_path = materialize(_refined(wanted.join(apart, "cls", "left_semi"), root))
    star = _with_hub(members).distinct().join(met.select("u", "v"), ["u", "v"], "left_anti").withColumn("hub", F.lit(True))
    more, more_path = materialize(compared(star, sets))
    edges = root.select(F.col("node").alias("u"), F.col("root").alias("v"))
    root = components(edges.unionAll(more.where(_linked("both")).select("u", "v")))
    rest = _rest(members.select("key", "cls", "n", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n")), root, sets, met.unionAll(more))
    out, _ = materialize(root.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(rest))
    discard(spark, lists_path, sizes_path, sets_path, met_path, more_path, members_path, wanted_path)
    return out


def _refined(reps: DataFrame, root: DataFrame, rounds: int = 2) -> DataFrame:
    """(key, cls, n, hub): prefix lists of ``reps`` over postings that lie in several components only.

    A class that leaves may leave others' postings in one component, so the
    count is taken ``rounds`` times.
    """
    post = _postings(reps)
    for k in range(rounds):
        several = _rooted(post, root).groupBy("key").agg(F.count("*").alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "f")
        mine = _owned(post, several)
        if k + 1 < rounds:
            post = mine.select("cls", "n", F.explode("own").alias("p")).select("cls", "n", F.col("p.key").alias("key"))
    lists, _ = materialize(_prefix(mine))
    return lists.join(_hubs(lists), "key").select("key", "cls", "n", "hub")


def _with_hub(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of members (cls, n, hub) and their hubs, where sizes allow a link."""
    ok = members.where((F.col("cls") != F.col("hub.cls")) & _alike("n", "hub.n"))
    return ok.select(F.least("cls", "hub.cls").alias("u"), F.greatest("cls", "hub.cls").alias("v"))


def _rooted(members: DataFrame, root: DataFrame) -> DataFrame:
    """``members`` with the root of their component."""
    return members.join(root.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _several(m: DataFrame) -> DataFrame:
    """Members of lists that hold several components."""
    two = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return m.join(two, "key", "left_semi")


def _linked(both: str):
    return F.col(both) * 100 >= (F.col("nu") + F.col("nv") - F.col(both)) * PERCENT


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v, hub) with the sizes of both sets (nu, nv) and of their intersection (both).

    Pairs that are not with a hub are counted first: their common postings are
    as many as their signatures have equal coordinates, and those with fewer than
    ``T`` are out.
    """
    a = sets.select(F.col("cls").alias("u"), F.col("arr").alias("x"), F.col("sig").alias("sx"))
    b = sets.select(F.col("cls").alias("v"), F.col("arr").alias("y"), F.col("sig").alias("sy"))
    count = F.aggregate(F.zip_with("sx", "sy", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "u").join(b, "v").where(F.col("hub") | (count >= T)).select("u", "v", F.size("x").alias("nu"), F.size("y").alias("nv"), F.size(F.array_intersect("x", "y")).alias("both"))


def _rest(members: DataFrame, root: DataFrame, sets: DataFrame, met: DataFrame) -> DataFrame:
    """Links between components that still share a long posting list.

    For x and y in a list with hub h, let a be the size of x & h, s the number
    of x's shingles that any other set here holds, and e = s - a.  What x and
    y share lies in h, where it is at most min(a) of the two, or outside, where
    it is at most min(e).
    """
    at, path = materialize(_several(_rooted(members, root)))
    shingles = sets.join(at.select("cls").distinct(), "cls", "left_semi").select("cls", F.explode("arr").alias("h"))
    common = shingles.groupBy("h").agg(F.count("*").alias("f")).where("f > 1").select("h")
    shared = shingles.join(common, "h").groupBy("cls").agg(F.count("*").alias("s"))
    with_hub = met.select("u", "v", "both").withColumnRenamed("both", "a")
    can = at.join(shared, "cls").where(F.col("s") * 100 >= F.col("n") * PERCENT)
    can = can.withColumns({"u": F.least("cls", "hub"), "v": F.greatest("cls", "hub")}).join(with_hub, ["u", "v"], "left")
    # the hub holds itself; a member that was too large or small to be compared with it has no better bound than its size
    can = can.withColumn("a", F.when(F.col("cls") == F.col("hub"), F.col("n")).otherwise(F.col("a"))).select("key", "cls", "n", "root", "s", F.coalesce("a", F.least("n", "hub_n")).alias("a"), F.when(F.col("a").isNull(), F.col("s")).otherwise(F.col("s") - F.col("a")).alias("e"))
    can = _several(can)
    keys = can.groupBy("cls").agg(F.collect_list("key").alias("keys"))  # at most K - T + 1 of them
    can, can_path = materialize(can.join(keys, "cls"))
    side = lambda x: can.select("key", *[F.col(c).alias(f"{c[0]}{x}") for c in ("cls", "n", "root", "s", "a", "e")], F.col("keys").alias(f"k{x}"))
    a, b = side("u"), side("v")
    most = F.least(F.least("su", "sv"), F.least("au", "av") + F.least("eu", "ev"))
    on = (a["key"] == b["key"]) & (F.col("cu") < F.col("cv")) & (F.col("ru") != F.col("rv")) & _alike("nu", "nv") & (most * 100 >= (F.col("nu") + F.col("nv") - most) * PERCENT)
    once = F.array_min(F.array_intersect("ku", "kv")) == a["key"]  # a pair counts in the first list that holds both
    pairs = a.join(b, on & once).select(F.col("cu").alias("u"), F.col("cv").alias("v"), F.lit(False).alias("hub"))
    out, _ = materialize(compared(pairs, sets).where(_linked("both")).select("u", "v"))
    discard(members.sparkSession, path, can_path)
    return out


def grouped(docs: DataFrame) -> DataFrame:
    """A row a document with _h and _nb: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach, the document itself
    included.  Null and blank texts have an empty set and no links.  Repeated
    rows share their class.  A null doc_id never names a component that has
    another id.  Columns other than doc_id and text play no part.  An empty
    table gives no rows.
    """
    feats, path = materialize(features(docs))
    reps, reps_path = materialize(feats.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    root = components(links(docs, reps))
    of = reps.select("cls", "first").join(root.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    of, of_path = materialize(of)
    least, least_path = materialize(of.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size")))
    named, _ = materialize(with_facts(of, least, ["root"], "size").select("cls", "component"))
    discard(docs.sparkSession, reps_path, of_path, least_path)
    out = feats.select(*ROW, "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select(*ROW, "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; see ``grouped``."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id", "kept")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that another one of their component stands for; all columns stay.

    Null and blank texts stay; repeated rows share their fate; an empty table gives an empty one.
    """
    return drop_rows(docs, grouped(docs).where("not kept").select(*ROW).distinct())
