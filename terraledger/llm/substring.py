"""Substring dedup over sliding runs of sentences.

A text is cut after ends of sentences, line breaks and words chosen by their own
hash; each cut depends on the word before it alone, so a passage is cut alike
wherever it stands, and a splice inside a sentence moves no other cut.  Hashed
and joined over all documents is every run of consecutive pieces that is the
shortest with at least ``least`` pieces and ``min_words`` words from its start,
or the shortest up to its end.  These cover every repeated run of that size or
more: from each piece the shortest run either ends inside it, or the shortest
run up to its end covers the piece.  Of equal runs the one at the smallest
(doc_id, text hash, position) is the first; pieces that any other repeated run
covers are removed.

Words are what ASCII white space parts; A-Z count as a-z.  All texts of a slice
are cut and hashed together, as arrays over their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.llm.exact_dedup import ROW, row_key
from terraledger.llm.scratch import Sieve, discard, mapped, materialize, own, slices, with_facts
from terraledger.llm.words import buffers, mixed, powers, words

#: Pieces and words that a run has at least; one in so many words is cut after.
LEAST, MIN_WORDS, EVERY = 2, 25, 8
#: Bits of the sieve of repeated runs: 16 MB, whatever the input.
RUN_BITS = 27


_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
#: Odd factor of a word's place in its run, and its inverse modulo 2**64.
_FACTOR = 0xD1342543DE82EF95
_BACK = pow(_FACTOR, -1, 1 << 64)


@dataclass
class Pieces:
    """Pieces of all texts of a slice, end to end; text t has those from ``of[t]`` to before ``of[t + 1]``."""

    of: np.ndarray
    ends: np.ndarray  # in bytes of the slice
    stops: np.ndarray  # in words of the slice
    begin: np.ndarray  # first words
    text: np.ndarray  # number of the piece's text
    marks: np.ndarray  # a hash of each word


def pieces(raw: np.ndarray, offs: np.ndarray, every: int = EVERY) -> Pieces:
    """Cut texts; the pieces tile each text, and a text of blanks only is one piece without words."""
    n, w = len(raw), words(raw, offs)
    begins, owner = w.begins, w.owner
    cut = ((w.marks >> np.uint64(17)) % np.uint64(every) == 0) | _STOP[raw[w.last]]
    breaks = np.flatnonzero(raw == 10)
    before = np.searchsorted(begins, breaks) - 1
    before, breaks = before[before >= 0], breaks[before >= 0]
    cut[before[np.searchsorted(offs, breaks, side="right") - 1 == owner[before]]] = True
    if len(owner):
        cut[np.r_[owner[1:] != owner[:-1], True]] = True
    at = np.flatnonzero(cut)
    text, stops = owner[at], at + 1
    ends = np.r_[begins, n][stops]
    final = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
    ends[final] = offs[text[final] + 1]
    sizes = np.diff(offs)
    hollow = np.flatnonzero((np.bincount(owner, minlength=len(sizes)) == 0) & (sizes > 0))
    if len(hollow):
        place = np.searchsorted(text, hollow)
        ends, stops = np.insert(ends, place, offs[hollow + 1]), np.insert(stops, place, np.r_[0, stops][place])
        text = np.insert(text, place, hollow)
    of = np.searchsorted(text, np.arange(len(sizes) + 1))
    return Pieces(of, ends, stops, np.r_[0, stops[:-1]] if len(stops) else stops, text, w.marks)


def runs(p: Pieces, least: int = LEAST, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last pieces of the runs, counted through the slice, and their hashes (signed 64 bits) under two functions."""
    i = np.arange(len(p.stops))
    j = np.maximum(np.searchsorted(p.stops, p.begin + min_words), i + least - 1)  # the shortest from each start
    ok = j < p.of[p.text + 1]
    i, j = i[ok], j[ok]
    taken = np.zeros(len(p.stops), dtype=bool)
    taken[j] = True
    e = np.flatnonzero(~taken)
    b = np.minimum(np.searchsorted(p.begin, p.stops[e] - min_words, side="right") - 1, e - least + 1)  # the shortest up to each other end
    ok = b >= p.of[p.text[e]]
    i, j = np.r_[i, b[ok]], np.r_[j, e[ok]]
    return i, j, _hashed(p, i, j, 0x94D049BB133111EB), _hashed(p, i, j, 0x2545F4914F6CDD1D)


def _hashed(p: Pieces, i: np.ndarray, j: np.ndarray, by: int) -> np.ndarray:
    """Hash of the words of pieces i to j, wherever they stand: a polynomial's partial sums, moved to place 0."""
    sums = np.r_[np.uint64(0), np.cumsum(mixed(p.marks, by) * powers(_FACTOR, len(p.marks)))] if len(p.marks) else np.zeros(1, np.uint64)
    a, b = p.begin[i], p.stops[j]
    back = powers(_BACK, len(p.marks) + 1)
    return mixed((sums[b] - sums[a]) * back[a], 0xBF58476D1CE4E5B9).view(np.int64)


def _half_rows(texts: DataFrame, least: int, min_words: int) -> DataFrame:
    """(r1): the first half of every run's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([pa.array(runs(pieces(*buffers(b.column("_text"))), least, min_words)[2])], names=["r1"])

    return mapped(texts.select("_text"), run, "r1 long")


def _run_rows(rows: DataFrame, least: int, min_words: int) -> DataFrame:
    schema = "doc_id long, _h long, _nb long, i int, j int, r1 long, r2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            p = pieces(*buffers(b.column("_text")))
            i, j, r1, r2 = runs(p, least, min_words)
            text = p.text[i]
            take = pa.array(text)
            own = p.of[text]
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(take) for c in ROW] + [pa.array((i - own).astype(np.int32)), pa.array((j - own).astype(np.int32)), pa.array(r1), pa.array(r2)],
                names=[*ROW, "i", "j", "r1", "r2"])

    return mapped(rows, run, schema)


def covered(docs: DataFrame, least: int = LEAST, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, _h, _nb, cuts): for rows that lose sentences, the runs (i, j) that are not first.

    First only halves of the runs' hashes are dealt out and counted; the rows
    that a sieve of those found twice or more lets through are then joined on
    whole hashes, runs that very many documents hold by broadcast.
    """
    spark = docs.sparkSession
    rows = row_key(own(docs, "doc_id", "text")).select(*ROW, "_text")
    twice = _half_rows(rows, least, min_words).groupBy("r1").agg(F.count("*").alias("n")).where("n > 1").select("r1")
    sieve = Sieve(twice, ["r1"], RUN_BITS)
    r, path = materialize(sieve.mark(_run_rows(rows, least, min_words), [F.col("r1")]).where("_maybe").drop("_maybe"))
    place = F.struct("doc_id", "_h", "i")
    first, first_path = materialize(r.groupBy("r1", "r2").agg(F.count("*").alias("n"), F.min(place).alias("lead")).where("n > 1"))
    later = with_facts(r, first, ["r1", "r2"], "n").where(~place.eqNullSafe(F.col("lead")))
    out, _ = materialize(later.groupBy(*ROW).agg(F.collect_set(F.struct("i", "j")).alias("cuts")))
    discard(spark, path, first_path, sieve.path)
    return out


def _rewrite(rows: DataFrame, place: int) -> DataFrame:
    """``rows`` with the cuts of their text (the last column) carried out, n_sentences and n_removed in its stead.

    ``place`` is the text's column; a text that loses nothing stays as it is, null included.
    """
    schema = rows.drop("cuts").schema.add("n_sentences", "integer").add("n_removed", "integer")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, place):
            text = b.column(place)
            raw, offs = buffers(text)
            p = pieces(raw, offs)
            gone = np.zeros(len(p.ends) + 1, dtype=np.int64)
            cuts = b.column(b.num_columns - 1)
            many = np.repeat(p.of[:-1], cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = cuts.flatten()
            np.add.at(gone, many + flat.field("i").to_numpy(), 1)
            np.add.at(gone, many + flat.field("j").to_numpy() + 1, -1)
            out = np.cumsum(gone)[:-1] > 0
            lost = np.add.reduceat(np.r_[out, False].astype(np.int32), np.minimum(p.of[:-1], len(out))) * (np.diff(p.of) > 0)
            if lost.any():
                start = np.r_[0, p.ends[:-1]]
                clean = text.to_pylist()
                for t in np.flatnonzero(lost).tolist():
                    own = range(int(p.of[t]), int(p.of[t + 1]))
                    clean[t] = b"".join(raw[start[k] : p.ends[k]].tobytes() for k in own if not out[k]).decode("utf-8", "replace")
                text = pa.array(clean, pa.string())
            cols = [text if k == place else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(p.of).astype(np.int32)), pa.array(lost.astype(np.int32))], names=names)

    return mapped(rows, run, schema)


def _cut(docs: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows that surely lose nothing, rows that may, with their cuts; both under neutral column names), and those names."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    text = F.col(names[docs.columns.index("text")])
    ids = F.col(names[docs.columns.index("doc_id")]).cast("long")
    keyed = row_key(docs.toDF(*names).withColumn("text", text)).drop("text").withColumn("doc_id", ids)
    marked = Sieve(cuts, ROW).mark(keyed, [F.col(c) for c in ROW])
    m, g = marked.where("_maybe").alias("m"), cuts.alias("g")
    on = F.col("m.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("m._h") == F.col("g._h")) & (F.col("m._nb") == F.col("g._nb"))
    return marked.where(~F.col("_maybe")).select(*names), m.join(g, on, "left").select(*names, "cuts"), names


def removed(docs: DataFrame, least: int = LEAST, min_words: int = MIN_WORDS) -> DataFrame:
    """A row a document: doc_id, text (what stays), n_sentences, n_removed.

    A null text counts as empty: no sentences, nothing removed.  Rows that
    repeat a (doc_id, text) hold the same runs at the same place, so each is as
    first as the other and nothing goes on their account; a passage that comes
    twice in one text goes the second time.  Documents without repeats keep
    their text byte by byte.  An empty table gives no rows.
    """
    texts = own(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    clear, cut, _ = _cut(texts, covered(docs, least, min_words))
    clear = clear.withColumn("cuts", F.lit(None).cast("array<struct<i:int,j:int>>"))
    return _rewrite(clear, 1).unionByName(_rewrite(cut, 1)).toDF("doc_id", "text", "n_sentences", "n_removed")


def strip(docs: DataFrame, least: int = LEAST, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` cut as in ``removed``; all rows and all other columns stay as they are.

    Null and empty texts stay; repeated (doc_id, text) rows take nothing from
    each other; an empty table gives an empty one.
    """
    clear, cut, names = _cut(docs, covered(docs, least, min_words))
    return clear.unionByName(_rewrite(cut, docs.columns.index("text")).select(*names)).toDF(*docs.columns)
