"""Exact dedup by deterministic block naming.

Every text is cut into blocks of ``block`` bytes.  All blocks are sorted and
each distinct one gets an integer name.  Adjacent names are then named as pairs,
level by level, until each document has one name.  Names come from comparing
whole blocks, so two documents of equal length share a name exactly when their
texts are equal.  Hashes only shorten the sort keys; a digest stands for a
block (SHA-256) solely where two tasks' neighbouring rows are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.llm.scratch import Sieve, discard, materialize, ordered_positions, own, with_facts

#: Bytes in a block.
BLOCK = 4096
#: What tells two rows apart: the id, and for repeated ids length and hash of the text.
ROW = ["doc_id", "_h", "_nb"]


def row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with _text (null as empty), _h and _nb."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_h", F.xxhash64("_text")).withColumn("_nb", F.octet_length("_text").cast("long"))


def names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct rows (doc_id, _h, _nb) with _level, _name and their number _n; equal texts have equal (_nb, _level, _name)."""
    spark = docs.sparkSession
    rows = row_key(own(docs, "doc_id", "text"))
    last = F.greatest(F.ceil(F.col("_nb") / block) - 1, F.lit(0)).cast("int")
    raw = F.encode("_text", "UTF-8")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block + 1, F.lit(block)))
    blocks = rows.select(*ROW, F.posexplode(cut).alias("_pos", "_block"))
    blocks = blocks.withColumn("_start", F.substring("_block", 1, F.lit(16))).withColumn("_hash", F.xxhash64("_block"))
    level, path = ordered_positions(blocks, run=["_block"], lead=["_start", "_hash"], tie=[*ROW, "_pos"], carry=[*ROW, "_pos"])
    level = level.select(*ROW, "_pos", F.lit(1).cast("long").alias("_n"), F.col("run_id").alias("_name"))
    most = rows.agg(F.max("_nb")).first()[0] or 0
    done, paths, k, span = [], [path], 0, block
    while True:
        single = F.col("_nb") <= span
        done.append(level.where(single).select(*ROW, F.lit(k).alias("_level"), "_name", "_n"))
        if most <= span:
            break
        pairs = (
            level.where(~single)
            .groupBy(*ROW, F.expr("_pos div 2").cast("int").alias("_pos"))
            .agg(F.sum(F.when(F.col("_pos") % 2 == 0, F.col("_n"))).alias("_n"), F.max(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_a"), F.coalesce(F.max(F.when(F.col("_pos") % 2 == 1, F.col("_name"))), F.lit(-1)).alias("_b"))
        )
        level, path = ordered_positions(pairs, run=["_a", "_b"], tie=[*ROW, "_pos"], carry=[*ROW, "_pos", "_n"])
        level = level.select(*ROW, "_pos", "_n", F.col("run_id").alias("_name"))
        paths.append(path)
        k, span = k + 1, span * 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    table, _ = materialize(out.groupBy(*ROW).agg(F.max("_level").alias("_level"), F.max("_name").alias("_name"), F.sum("_n").alias("_n")))
    discard(spark, *paths)
    return table


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  Of equal texts the largest doc_id stays; a null
    doc_id stays only if the whole group has none.  A row that occurs several
    times comes back as often, and one of its copies at most is kept.  Columns
    of ``docs`` other than doc_id and text play no part.  An empty table gives
    an empty result.
    """
    keyed = row_key(own(docs, "doc_id", "text"))
    rows = keyed.groupBy(*ROW).agg(F.first(F.sha2("_text", 256)).alias("text_sha256"))
    a, b = rows.alias("a"), _kept(names(docs, block)).alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._h") == F.col("b._h")) & (F.col("a._nb") == F.col("b._nb"))
    one = a.join(b, on).select("a.*", "b.keep_id", "b.group_size", F.explode(F.sequence(F.lit(1).cast("long"), "b._n")).alias("_copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return one.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _kept(named: DataFrame) -> DataFrame:
    """``named`` with keep_id and group_size; a group of very many rows is told by broadcast, not in one task."""
    ident = ["_nb", "_level", "_name"]
    per, _ = materialize(named.groupBy(*ident).agg(F.max("doc_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_rows")))
    return with_facts(named, per, ident, "_rows")


def dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows of which an equal text with a larger doc_id exists.

    All columns stay as they are, also ones called like this module's own.  Of
    fully repeated (doc_id, text) rows one stays.  Null texts count as empty; an
    empty table gives an empty one.
    """
    named = _kept(names(docs, block))
    gone = named.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*ROW)
    twice = named.where(F.col("_n") > 1).select(*ROW)
    return drop_rows(docs, gone, twice)


def drop_rows(docs: DataFrame, gone: DataFrame, twice: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` and with one copy of those in ``twice``.

    Rows that a sieve clears never move; only those that may match are shuffled.
    """
    gone, _ = materialize(gone.withColumn("_gone", F.lit(True)) if twice is None else gone.withColumn("_gone", F.lit(True)).unionByName(twice.withColumn("_gone", F.lit(False))))
    names = [f"_c{k}" for k in range(len(docs.columns))]
    whole, at = docs.toDF(*names), {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text")}
    keyed = row_key(whole.select(*names, at["doc_id"].cast("long").alias("doc_id"), at["text"].alias("text"))).drop("text", "_text")
    marked = Sieve(gone, ROW).mark(keyed, [F.col(c) for c in ROW])
    clear = marked.where(~F.col("_maybe")).select(*names)
    g = gone.groupBy(*ROW).agg(F.max("_gone").alias("_gone")).alias("g")
    m = marked.where("_maybe").alias("m")
    on = F.col("m.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("m._h") == F.col("g._h")) & (F.col("m._nb") == F.col("g._nb"))
    checked = m.join(g, on, "left").select("m.*", "g._gone")
    single = checked.where("_gone is null").select(*names)
    out = clear.unionByName(single)
    if twice is not None:
        once = checked.where("not _gone").dropDuplicates(ROW).select(*names)
        out = out.unionByName(once)
    return out.toDF(*docs.columns)
