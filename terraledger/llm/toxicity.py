"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all texts (bytes mapped to 32
   classes, so the counts are one bounded table).
2. Tokens that look disguised (signs or digits among letters, letters drawn
   out, letters set apart) become a lattice: every character may stand for
   itself, for a letter it imitates, or for nothing.  Viterbi decoding under
   the character model restores the likeliest word, and the likeliest words
   where it may hold several.
3. Words, restored words and their beginnings are looked up among features
   that labelled documents gave, and a logistic model of the features found
   gives the score.

Labels are read only for the rows that the caller lets in; of those a bounded,
hash-ordered sample (``PER_CLASS`` a class) fits the features.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraledger.llm.scratch import held, mapped, materialize, own, slices

#: Labelled documents of each class that fit the features; features kept.
PER_CLASS, FEATURES = 5000, 20_000
#: Toxic documents that a feature must occur in (at least two, and this share of the sample's), and by how much more often than in others.
SUPPORT, LIFT = 0.01, 4.0
#: Tokens whose features a worker remembers.
REMEMBERED = 100_000
#: Beginnings of words that count as features, in characters.
STEMS = (4, 5, 6)

#: What a sign or digit may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Costs in nats: reading a look-alike; leaving out a separator, a look-alike, the second of a double letter, a third one.
COST_LOOK, COST_SKIP, COST_UNREAD, COST_DOUBLE, COST_DRAWN = 0.5, 0.2, 5.0, 2.5, 0.2

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _classes() -> np.ndarray:
    """Bytes to classes: 0 white space, 1-26 letters, 27 other letters' bytes, 31 anything else."""
    out = np.full(256, 31, dtype=np.int64)
    out[[9, 10, 11, 12, 13, 32]] = 0
    for i, c in enumerate(LETTERS):
        out[ord(c)] = out[ord(c.upper())] = i + 1
    out[128:] = 27
    return out


CLASSES = _classes()


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): counts of class trigrams over all texts; at most 32**3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(32**3, dtype=np.int64)
        for b in slices(batches):
            raw = " ".join(t for t in b.column("text").to_pylist() if t)
            c = CLASSES[np.frombuffer((" " + raw + " ").encode("utf-8"), dtype=np.uint8)]
            if len(c) > 2:
                total += np.bincount(c[:-2] * 1024 + c[1:-1] * 32 + c[2:], minlength=32**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    return mapped(own(docs, "text"), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """-log P(class | two classes before), smoothed."""

    cost: list = field(default_factory=lambda: np.full((32, 32, 32), math.log(32)).tolist())

    @staticmethod
    def of(rows: list) -> CharModel:
        n = np.zeros(32**3)
        for code, k in rows:
            n[code] = k
        n = n.reshape(32, 32, 32)
        n[:, :, 28:] = 0  # signs are the channel's, not the language's
        n[:, 28:, :] = 0
        n[28:, :, :] = 0
        two, one = n.sum(0), n.sum((0, 1))
        p1 = (one + 1) / (one.sum() + 32)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (n + 20 * p2) / (n.sum(2, keepdims=True) + 20)
        return CharModel((-np.log(p3)).tolist())


def _class(c: str) -> int:
    i = LETTERS.find(c)
    return i + 1 if i >= 0 and len(c) == 1 else 27


def restore(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest word behind ``token`` (lower case): Viterbi over the lattice of its characters.

    ``spaced`` lets words end before any character; then they come with blanks between them.
    """
    cost = model.cost
    beams: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}  # letters read: (those before, the last)
    for c in token:
        nxt: dict[tuple[int, int, str], tuple[float, tuple]] = {}
        looks = LOOKALIKES.get(c, "")
        reads = [(c, 0.0)] if c.isalpha() else [(x, COST_LOOK) for x in looks]
        if spaced:
            for (a, b, _), (s, word) in list(beams.items()):
                key, total = (b, 0, ""), s + cost[a][b][0]
                if b and (key not in beams or total < beams[key][0]):
                    beams[key] = (total, (word, " "))
        for (a, b, last), (s, word) in beams.items():
            for x, extra in reads:
                k = _class(x)
                key, total = (b, k, x), s + extra + cost[a][b][k]
                if key not in nxt or total < nxt[key][0]:
                    nxt[key] = (total, (word, x))
            if not c.isalpha():
                extra = COST_UNREAD if looks else COST_SKIP
            elif c == last:
                extra = COST_DRAWN if word and word[1] == c and word[0] and word[0][1] == c else COST_DOUBLE
            else:
                continue
            key, total = (a, b, last), s + extra
            if key not in nxt or total < nxt[key][0]:
                nxt[key] = (total, word)
        beams = nxt
    if not beams:
        return ""
    word = min(((s + cost[a][b][0], w) for (a, b, _), (s, w) in beams.items()), key=lambda x: x[0])[1]
    out = []
    while word:
        word, c = word
        out.append(c)
    return "".join(reversed(out))


_EDGE = re.compile(r"^[^\w@$!|+(<€£¡*]+|[^\w@$]+$")
_DISGUISED = re.compile(r"[^\W\d_][\d@$!|+(<€£¡*._\-]+[^\W\d_]|^[\d@$!|+(<€£¡*]+[^\W\d_]|[^\W\d_][\d@$]+$|([^\W\d_])\1\1")
_BETWEEN = re.compile(r"[._\-]+")
_PLAIN = re.compile(r"[^\W\d_]+")
#: Letters set apart by blanks, four at least.
_APART = re.compile(r"(?<!\S)[^\W_](?: [^\W_](?!\S)){3,}")


def readings(token: str, model: CharModel) -> list[str]:
    """Words to look up for one lower-case token: its plain parts, and what it may disguise as one word."""
    bare = _EDGE.sub("", token)
    out = [bare] if bare.isalpha() else _PLAIN.findall(bare)
    if _DISGUISED.search(bare):
        out.append(restore(bare, model))
    return [w for w in out if len(w) > 1]


def several(token: str, model: CharModel, row: bool = False) -> list[str]:
    """Words that a disguised token, or a joined row of single letters, may hold one after the other."""
    bare = _EDGE.sub("", token)
    if not row and not _DISGUISED.search(bare):
        return []
    parts = [p for p in _BETWEEN.split(bare) if len(p) > 1]
    alone = [w for p in parts for w in readings(p, model)] if len(parts) > 1 else []
    return [w for w in [*restore(bare, model, True).split(), *alone] if len(w) > 1]


_DRAWN = re.compile(r"([^\W\d_])\1\1")


def drawn_out(text: str) -> bool:
    """Whether a character that may be a letter stands three times in a row; ``_DRAWN`` says then which words have one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return bool(((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & (c[2:] >= 97)).any())


def features_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


def apart(text: str) -> list[str]:
    """Rows of single letters, as tokens; a row of one letter alone hides nothing."""
    return [m for m in _APART.findall(text) if len(set(m)) > 3]


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    coef: list[float]
    cache: dict[str, frozenset[int]] = field(default_factory=dict, repr=False)
    kinds: dict[frozenset[int], frozenset[int]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.names = list(self.weights)
        self.values = np.array([0.0, *self.weights.values()])
        self.number = {f: i + 1 for i, f in enumerate(self.names)}
        self.longest = max(map(len, self.names), default=0)
        self.heads = {f.rstrip("*")[:4] for f in self.names}

    def best(self, words: list[str]) -> int:
        """Number of the strongest feature of a token's readings, 0 if they have none."""
        found = [self.number[f] for w in words for f in features_of(w) if f in self.number]
        return max(found, key=lambda i: (self.values[i], -i), default=0)

    def of(self, token: str, row: bool = False) -> set[int]:
        """Numbers of a token's features: one for the token as a word, one for each of several words in it."""
        if token.isalpha() and not row and not _DRAWN.search(token):
            return {self.best([token] if len(token) > 1 else [])}
        words = readings(token, self.chars)
        found = {self.best(words), *(self.best([w]) for w in several(token, self.chars, row))}
        return found.union(*(self.within(w) for w in words)) if row or len(words) > 1 else found

    def within(self, letters: str) -> set[int]:
        """Numbers of the features that begin anywhere in a joined row or restored token, each after the end of the one before."""
        found, at = set(), 0
        while at < len(letters):
            here = [letters[at:to] for to in range(at + STEMS[0], min(len(letters), at + self.longest) + 1)]
            known = [(self.number[f], len(w)) for w in here for f in ((w, w + "*") if len(w) in STEMS else (w,)) if f in self.number]
            best, size = max(known, key=lambda x: (self.values[x[0]], -x[0]), default=(0, 1))
            found.add(best)
            at += size
        return found

    def hits(self, text: str) -> set[int]:
        """Numbers of the features in a text, one for each token and each word decoded from it.

        A plain word whose first letters begin no feature is passed over; only
        the others are looked up, and remembered.
        """
        low = text.lower()
        words = low.split()
        heads, cache = self.heads, self.cache
        found = set()
        odd = drawn_out(low)
        for w in [w for w in set(words) if w[:4] in heads or not w.isalpha() or (odd and _DRAWN.search(w))]:
            bare = w.rstrip(".,;:!?")
            if bare[:4] not in heads and bare.isalpha() and not (odd and _DRAWN.search(bare)):
                continue
            i = cache.get(bare)
            if i is None:
                if len(cache) > REMEMBERED:
                    cache.clear()
                i = frozenset(self.of(bare))
                i = cache[bare] = self.kinds.setdefault(i, i)  # most tokens have one of few sets
            found |= i
        if b"\1\1\1\1" in bytes([len(w) == 1 for w in words]):
            for row in apart(low):
                found |= self.of(row.replace(" ", ""), True)
        found.discard(0)
        return found

    def score(self, hits: set[int]) -> float:
        x = summary(self.values[list(hits)])
        z = float(np.dot(self.coef, x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def summary(w: np.ndarray) -> np.ndarray:
    """What the logistic model sees of a document's feature weights."""
    w = np.sort(w)[::-1]
    return np.array([1.0, w[:1].sum(), w[:3].sum(), min(len(w), 10)])


def may_learn(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` documents of each class with a label that may be learnt."""
    chars = CharModel.of(trigram_counts(docs).collect())  # at most 32**3 rows
    marks = own(labels, "doc_id", "toxic").withColumn("toxic", F.col("toxic").cast("int"))
    marks = marks.where(F.col("toxic").isin(0, 1) & may_learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for t in (0, 1):
        part = marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked, _ = materialize(picked)
    rows = own(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")
    n = {t: min(size.get(t, 0), per_class) for t in (0, 1)}
    share = (size.get(1, 0) + 1) / (size.get(0, 0) + size.get(1, 0) + 2)
    flat = Model(chars, {}, [math.log(share / (1 - share)), 0.0, 0.0, 0.0])  # what is known without examples of both classes
    if not n[0] or not n[1]:
        return flat

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for b in slices(batches):
            feats, takes = [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                low, mine = t.lower(), set()
                for w in [*set(low.split()), *apart(low)]:
                    if w not in known:
                        row = w.replace(" ", "")
                        known[w] = [f for r in readings(row, chars) + several(row, chars, row != w) for f in features_of(r)]
                    mine.update(known[w])
                feats += mine
                takes += [k] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(feats, pa.string()), b.column("toxic").take(pa.array(takes, pa.int32()))], names=["f", "toxic"])

    counts = mapped(rows, words, "f string, toxic int").groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    lift = (F.col("t") / n[1]) / ((F.col("c") + 0.5) / n[0])
    best = counts.where((F.col("t") >= max(2, round(SUPPORT * n[1]))) & (lift >= LIFT)).orderBy(F.desc(F.col("t") * F.log(lift)), "f").limit(FEATURES).collect()
    got = {r["f"]: (r["t"], r["c"]) for r in best}

    def weight(t: float, c: float) -> float:
        return math.log((t + 0.2) / (n[1] + 1)) - math.log((c + 0.2) / (n[0] + 1))

    first = Model(chars, {f: weight(t, c) for f, (t, c) in got.items()}, [0.0] * 4)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hits = [sorted(first.hits(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "hits"])

    sample = mapped(rows, found, "toxic int, hits array<int>").collect()  # at most 2 * per_class rows
    if len({r["toxic"] for r in sample}) < 2:
        return flat
    counts_of = [(0, 0), *got.values()]
    x, y = [], []
    for toxic, hits in sample:  # each document is judged by features counted without it
        w = [weight(max(t - toxic, 0), max(c - (1 - toxic), 0)) for t, c in (counts_of[i] for i in hits)]
        x.append(summary(np.array([v for v in w if v > 0])))
        y.append(toxic)
    x, y = np.array(x), np.array(y, dtype=float)
    share = {t: size[t] / max(1, (y == t).sum()) for t in (0, 1)}  # the sample's classes count by their real sizes
    coef = logistic(x, y, np.where(y == 1, share[1], share[0]))
    return Model(chars, first.weights, coef.tolist())


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    b = np.zeros(x.shape[1])
    w = w / w.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)) * np.r_[0.01, np.ones(len(b) - 1)]
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * np.r_[0.01 * b[0], b[1:]])
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _scored(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """``rows`` (keep, text) with score; the text is not carried on."""
    schema = rows.select(keep).schema.add("score", "double")
    fitted, mark = model, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(f"toxicity {mark}", lambda: fitted)  # a worker's tasks share the tokens it has decoded
        for b in slices(batches):
            s = [model.score(model.hits(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(s, pa.float64())], names=[keep, "score"])

    return mapped(rows, run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a document: doc_id, held_out, score in 0..1, predicted.

    Null and empty texts have no features and get the score of such a text.
    Labels that are null or neither 0 nor 1 are not learnt; a doc_id with two
    labels counts as toxic if one says so; without labels of both classes every
    score is the smoothed share of toxic ones.  Repeated rows are scored alike;
    other columns are dropped; an empty table gives no rows.
    """
    model = fit(docs, labels)
    out = _scored(own(docs, "doc_id", "text"), model, "doc_id")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``at``, with all their columns as they are.

    Null and empty texts score as a text without features does.  Other columns,
    also ones called like this module's own, only pass through; an empty table
    gives no rows.
    """
    fitted, mark = fit(docs, labels), uuid.uuid4().hex
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(f"toxicity {mark}", lambda: fitted)
        for b in slices(batches, place):
            ok = [model.score(model.hits(t or "")) < at for t in b.column(place).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return mapped(docs, run, docs.schema)
