"""Language identification of mixed texts.

A word ends where its letters' script changes.  Its script names the languages
that were learnt with it; only those are candidates for the word.  A naive Bayes model of
character n-grams scores the word in every candidate.  Viterbi decoding with a
switching penalty then labels the words, so that spans of one language come out
rather than single words, and the label that covers most letters is the text's.
Runs of letters without a blank, as in Thai or Chinese, are read in consecutive
pieces, to the last letter.

The model is fitted on a bounded sample: at most ``PER_LANGUAGE`` documents a
language in hash order, among those whose label may be learnt.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraledger.llm.scratch import gathered, held, mapped, materialize, own, slices

#: Sample: documents a language; n-grams kept a language; longest n-gram.
PER_LANGUAGE, GRAMS, LONGEST = 1500, 30_000, 4
#: Nats that a change of language costs, and letters of a piece that an unbroken run is read in.
SWITCH, LETTERS = 6.0, 40
#: Bytes of text that are decoded in lockstep.
LOCKSTEP = 12 << 20
#: Share of a language's letters that a script needs to make it a candidate.
SCRIPT_SHARE = 0.01

#: Scripts by their main Unicode ranges.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_NAMES = list(SCRIPTS)
_STARTS = sorted((lo, hi, i) for i, r in enumerate(SCRIPTS.values()) for lo, hi in r)


def _piece_pattern() -> str:
    """Letters of one script and the marks on them, at most ``LETTERS``; then letters of no script listed."""
    sets = ["".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in r) for r in SCRIPTS.values()]
    more = f"{{0,{LETTERS - 1}}}"
    listed = [rf"[[{x}]&&\p{{L}}][[[{x}]&&\p{{L}}]\p{{M}}]{more}" for x in sets]
    return "|".join([*listed, rf"[\p{{L}}--[{''.join(sets)}]][[\p{{L}}--[{''.join(sets)}]]\p{{M}}]{more}"])


_PIECE = regex.compile(_piece_pattern(), regex.V1)
#: The same where no character is above U+024F, for the faster engine.
_LATIN = re.compile(f"[A-Za-zªµºÀ-ÖØ-öø-ɏ]{{1,{LETTERS}}}")
_BEYOND = re.compile("[ɐ-\U0010ffff]")


def pieces(text: str) -> list[str]:
    """The text's words, cut where the script changes and after ``LETTERS`` letters; numbers and signs are none."""
    return (_PIECE if _BEYOND.search(text) else _LATIN).findall(text)


def script(word: str) -> str:
    """Script of a word's first letter that has one; "other" if none has."""
    for c in word:
        o = ord(c)
        for lo, hi, i in _STARTS:
            if lo <= o <= hi:
                return _NAMES[i]
    return "other"


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


@dataclass
class Model:
    langs: list[str]
    table: dict[str, list[float]]
    unseen: list[list[float]]
    allowed: dict[str, list[bool]]
    cache: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.number = {g: i + LONGEST + 1 for i, g in enumerate(self.table)}
        self.weights = np.array([*[u or [0.0] * len(self.langs) for u in self.unseen], *self.table.values()]).reshape(-1, max(1, len(self.langs)))
        self.rows = np.zeros((0, len(self.langs)))

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of words in each language, less the best one's; not a candidate: very low."""
        found, sizes, get = [], [], self.number.get
        for w in words:
            g = grams(w.lower())
            sizes.append(len(g))
            found += [get(x) or len(x) for x in g]
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(self.weights[found], starts, axis=0) / LONGEST * 2  # n-grams overlap
        free = [True] * len(self.langs)
        ok = np.array([self.allowed.get(script(w), free) for w in words])
        total = np.where(ok, total, -1e6)
        return np.maximum(total - total.max(1, keepdims=True), -60.0)

    def index(self, words: list[str]) -> np.ndarray:
        """Row numbers in ``rows`` of words."""
        if len(self.cache) > 500_000:
            self.cache.clear()
            self.rows = self.rows[:0]
        get = self.cache.get
        at = list(map(get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i is None))
            n = len(self.rows)
            self.rows = np.concatenate([self.rows, *[self.words(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]])
            self.cache.update(zip(new, range(n, n + len(new)), strict=True))
            at = list(map(get, words))
        return np.array(at, dtype=np.int64)

    def label(self, texts: list[str]) -> tuple[list[str], list[float], list[int]]:
        """Language, score and number of spans of each text."""
        words, counts = [], []
        for t in texts:
            w = pieces(t)
            words += w
            counts.append(len(w))
        at = self.index(words)
        scores = self.rows[at]
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        path = viterbi(scores, np.array(counts), SWITCH)
        langs, got, spans = [], [], []
        end = 0
        for c in counts:
            p, n = path[end : end + c], size[end : end + c]
            end += c
            if not c:
                langs.append("und"), got.append(0.0), spans.append(0)
                continue
            share = np.bincount(p, weights=n, minlength=len(self.langs))
            k = int(share.argmax())
            langs.append(self.langs[k]), got.append(float(share[k] / share.sum())), spans.append(int((p[1:] != p[:-1]).sum()) + 1)
        return langs, got, spans


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every row of ``scores``; texts are ``counts`` rows long and decoded in lockstep."""
    n, states = scores.shape
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lens = counts[order]
    back = np.zeros((n, states), dtype=np.int16)
    live = int((lens > 0).sum())
    v = scores[starts[:live]].copy()
    final = np.zeros((live, states))
    t = 1
    while live:
        more = int(np.searchsorted(-lens, -t, side="left"))  # texts with over t words
        final[more:live] = v[more:live]
        live = more
        if not live:
            break
        v = v[:live]
        at = starts[:live] + t
        top = v.argmax(1)
        switched = v[np.arange(live), top] - penalty
        stay = v >= switched[:, None]
        back[at] = np.where(stay, np.arange(states), top[:, None])
        v = np.maximum(v, switched[:, None]) + scores[at]
        t += 1
    path = np.zeros(n, dtype=np.int64)
    if len(final):
        state = final.argmax(1)
        for t in range(int(lens[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lens, -t, side="left"))
            at = starts[:live] + t
            path[at] = state[:live]
            state[:live] = back[at, state[:live]]
    return path


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows whose crc32(doc_id as text) modulo 4 is not 2 and that have a language and a text."""
    rows = own(docs, "doc_id", "lang", "text").where("text is not null and lang is not null and doc_id is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    per = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked, _ = materialize(rows.select("lang", "doc_id").withColumn("r", F.row_number().over(per)).where(F.col("r") <= per_language).select("lang", "doc_id").distinct())
    langs = sorted(r[0] for r in picked.select("lang").distinct().collect())  # one row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in slices(batches):
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(pieces(t.lower()))
        for lang, words in seen.items():
            total: Counter = Counter()
            for w, n in words.items():
                for g in grams(w):
                    total[g] += n
                total["\x00" + script(w)] += n * len(w)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["lang", "g", "n"])

    counts = mapped(rows.join(F.broadcast(picked), ["lang", "doc_id"]), count, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "g")
    table: dict[str, dict[str, int]] = {x: {} for x in langs}
    scripts: dict[str, dict[str, int]] = {x: {} for x in langs}
    for r in counts.withColumn("r", F.row_number().over(frequent)).where(F.col("r") <= GRAMS).collect():  # GRAMS rows a language
        (scripts if r["g"][0] == "\x00" else table)[r["lang"]][r["g"].lstrip("\x00")] = r["n"]
    known = sorted({g for t in table.values() for g in t})
    sums = {x: [sum(n for g, n in table[x].items() if len(g) == k) for k in range(LONGEST + 1)] for x in langs}
    kinds = [sum(len(g) == k for g in known) + 1 for k in range(LONGEST + 1)]
    logs = {g: [math.log((table[x].get(g, 0) + 0.3) / (sums[x][len(g)] + 0.3 * kinds[len(g)])) for x in langs] for g in known}
    unseen = [[math.log(0.3 / (sums[x][k] + 0.3 * kinds[k])) for x in langs] for k in range(LONGEST + 1)]
    names = {s for t in scripts.values() for s in t}
    allowed = {s: [scripts[x].get(s, 0) >= SCRIPT_SHARE * max(1, sum(scripts[x].values())) for x in langs] for s in names}
    return Model(langs, logs, unseen, {s: a for s, a in allowed.items() if any(a)})


def identify(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, held_out, lang_pred, score (share of letters in that language), spans.

    Null and empty texts and texts without a letter are ``und`` with score 0, and
    so is everything where no language could be learnt, as from an empty table.  Ties go to the language
    first in the alphabet.  ``lang`` is read for fitting only; repeated rows are
    labelled alike; other columns are dropped.
    """
    fitted, mark = fit(docs), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(f"language {mark}", lambda: fitted)  # a worker's tasks share the words it has scored
        for b in slices(gathered(batches, LOCKSTEP), most=LOCKSTEP):
            texts = [t or "" for t in b.column("text").to_pylist()]
            lang, score, spans = model.label(texts) if model.langs else (["und"] * len(texts), [0.0] * len(texts), [0] * len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang), pa.array(score, pa.float64()), pa.array(spans, pa.int32())], names=["doc_id", "lang_pred", "score", "spans"])

    out = mapped(own(docs, "doc_id", "text"), run, "doc_id long, lang_pred string, score double, spans int")
    out_of_fit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", out_of_fit.alias("held_out"), "lang_pred", "score", "spans")
