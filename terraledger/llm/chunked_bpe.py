"""Byte-level BPE over a rank file, long texts in overlapping chunks.

A text is cut into chunks that overlap, and every chunk is split into
pre-tokens by itself, wherever it lies.  A chunk begins in the middle of
something, but a pre-token depends on nothing before it: as soon as a chunk
and the one before have one boundary in common, they agree from there on.
Neighbours are stitched at the first common boundary of their overlap.  A text
in which two have none (a run longer than the overlap) is cut again into
longer chunks with longer overlaps, until all meet; so every boundary is the
whole text's.  Then the pieces between the stitches are encoded, each by
itself, and decoding concatenates the tokens' bytes.

Inside a pre-token the two neighbours whose joined bytes have the least rank
merge first, the leftmost of equals.  Short words merge in lockstep; a word in
which a merge brings up a lower rank than its own, and a very long one, goes
through a queue.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraledger.llm.bpe import LATIN, NONE, ODD, SPLIT, IntTable, WordStore
from terraledger.llm.scratch import gathered, held, mapped, materialize, own, slices

#: Characters of a chunk, how many it has in common with the next, and by how much both grow where neighbours do not meet.
CHUNK, OVERLAP, GROW = 1 << 14, 1 << 8, 4
#: A text of over so many chunks is dealt out chunk by chunk before its chunks are split.
SPREAD = 64
#: A pre-token is final with so many characters past its start, and one past its end.
SIGHT = 3
#: Bytes of a word from which on the queue merges it; bytes of text that are encoded together.
LONG_WORD, BATCH_BYTES = 1 << 11, 1 << 22


class RankBpe:
    """Encoder of a file of lines "token in base 64, rank"; a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.raw = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.raw[rank] = token
        self.small = np.dtype("<u2" if len(self.raw) <= 1 << 16 else "<u4")  # how ids travel
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        a, b, made = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.pairs = IntTable(a << 32 | b, made.astype(np.int32))
        self.words = WordStore(self.encode_words)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        raw = [w.encode() for w in words]
        out: list = [self.ranks.get(r) for r in raw]  # a word that is a token needs no merges
        todo = [i for i, known in enumerate(out) if known is None]
        short = [i for i in todo if len(raw[i]) <= LONG_WORD]
        flat, lens, odd = self._lockstep([raw[i] for i in short])
        for i, ids in zip(short, np.split(flat, np.cumsum(lens)[:-1]) if short else [], strict=True):
            out[i] = ids
        for i in [*(short[k] for k in odd), *(i for i in todo if len(raw[i]) > LONG_WORD)]:
            out[i] = self.merged(raw[i])
        sizes = np.array([1 if isinstance(x, int) else len(x) for x in out], dtype=np.int64)
        return np.concatenate([np.atleast_1d(np.asarray(x, dtype=np.int32)) for x in out]) if out else np.zeros(0, np.int32), sizes

    def _lockstep(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Merge many words at once, a rank a step; also which words have to be merged in order instead."""
        lens = np.array([len(r) for r in raw], dtype=np.int64)
        word = np.repeat(np.arange(len(raw)), lens)
        sym = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        rank = self._pair(sym, word, np.arange(len(sym)))
        ready, odd = [], np.zeros(len(raw), dtype=bool)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == NONE, size)
            if over.any():
                ready.append((sym[over], word[over]))
                sym, word, rank = sym[~over], word[~over], rank[~over]
                size, least = size[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            least = np.repeat(least, size)
            at = np.flatnonzero(rank == least)
            run = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]  # aaaa: every other one, from the left
            now = rank[at]
            sym[at] = now
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            sym, word, rank, least = sym[stay], word[stay], rank[stay], least[stay]
            near = np.r_[at, at[at > 0] - 1]
            rank[near] = self._pair(sym, word, near)
            odd[word[near[rank[near] < least[near]]]] = True
        if not ready:
            return np.zeros(0, np.int32), lens, []
        sym, word = np.concatenate([s for s, _ in ready]), np.concatenate([w for _, w in ready])
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(raw)), np.flatnonzero(odd).tolist()

    def _pair(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(sym) - 1)
        out = self.pairs.get(sym[at].astype(np.int64) << 32 | sym[after])
        out[(after == at) | (word[after] != word[at])] = NONE
        return out

    def merged(self, raw: bytes) -> list[int]:
        """One word, its merges strictly in order."""
        ranks, ends, n = self.ranks, list(range(1, len(raw) + 1)), len(raw)
        before = list(range(-1, n - 1))

        def rank(i: int) -> int | None:
            j = ends[i]
            return ranks.get(raw[i : ends[j]]) if j < n else None

        queue = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(queue)
        gone = bytearray(n)
        while queue:
            r, i = heapq.heappop(queue)
            if gone[i] or rank(i) != r:
                continue
            j = ends[i]
            gone[j] = 1
            ends[i] = ends[j]
            if ends[i] < n:
                before[ends[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(queue, (r, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : ends[i]]])
            i = ends[i]
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


def pre_tokens(text: str) -> list[str]:
    return (LATIN if not ODD.search(text) else SPLIT).findall(text)


def loaded(path: str) -> RankBpe:
    """One coder a worker process, with its store of words."""
    return held(f"ranks {path}", lambda: RankBpe(path))


# ---------------------------------------------------------------- chunks and stitches


def chunks(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """(key, doc_id, chunk, start, text): chunks of ``size`` characters, each with its last ``overlap`` in common with the next."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for key, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                starts = range(0, max(len(text) - overlap, 1), size - overlap)
                for at in range(0, len(starts), SPREAD):
                    some = starts[at : at + SPREAD]
                    cols = [pa.array([key] * len(some)), pa.array([doc_id] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.int64()), pa.array([text[i : i + size] for i in some])]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "chunk", "start", "text"])

    return mapped(rows, cut, "key string, doc_id long, chunk long, start long, text string")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where a chunk's pre-tokens begin or end, and of these the places that hold whatever follows the chunk."""
    ends = np.cumsum([0, *map(len, pre_tokens(text))])
    final = (ends[:-1] + SIGHT <= len(text)) & (ends[1:] + 1 <= len(text))
    sure = len(final) if final.all() else int(np.argmin(final))
    return ends, ends[: sure + 1]


def _edges(parts: DataFrame, overlap: int) -> DataFrame:
    """(key, chunk, head, tail): boundaries in the text's places, near a chunk's begin, and sure ones near its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            heads, tails = [], []
            for start, text in zip(b.column("start").to_pylist(), b.column("text").to_pylist(), strict=True):
                every, sure = boundaries(text)
                heads.append((every[every <= overlap] + start).tolist())
                tails.append((sure[sure >= len(text) - overlap] + start).tolist())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["key", "chunk", "head", "tail"])

    return mapped(parts.select("key", "chunk", "start", "text"), run, "key string, chunk long, head array<long>, tail array<long>")


def stitches(rows: DataFrame, size: int, overlap: int) -> tuple[DataFrame, str]:
    """(key, chunk, since, until, torn) of every chunk, and its table.

    Pre-tokens from place ``since`` to ``until`` are the chunk's own; null means
    the text's begin or end.  ``torn``: somewhere in the text, neighbours have
    no boundary in common.
    """
    far = F.length("text") > SPREAD * size
    parts = chunks(rows.where(~far), size, overlap), chunks(rows.where(far), size, overlap).repartition("key", "chunk")
    edges = _edges(parts[0], overlap).unionByName(_edges(parts[1], overlap)).dropDuplicates(["key", "chunk"])  # of repeated rows, one
    order = Window.partitionBy("key").orderBy("chunk")
    met = edges.select("key", "chunk", F.array_min(F.array_intersect("tail", F.lead("head").over(order))).alias("until"), F.lead("chunk").over(order).isNull().alias("last"))
    every = Window.partitionBy("key")
    out = met.select("key", "chunk", F.lag("until").over(order).alias("since"), "until", F.max(F.col("until").isNull() & ~F.col("last")).over(every).alias("torn"))
    return materialize(out)


# ---------------------------------------------------------------- encoding


def _ids(parts: DataFrame, path: str) -> DataFrame:
    """(key, doc_id, chunk, ids) of stitched chunks, ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for b in slices(batches):
            words, ends = [], [0]
            for start, text, since, until in zip(*(b.column(c).to_pylist() for c in ("start", "text", "since", "until")), strict=True):
                found = pre_tokens(text)
                places = start + np.cumsum([0, *map(len, found)])
                words += found[0 if since is None else int(np.searchsorted(places, since)) : len(found) if until is None else int(np.searchsorted(places, until))]
                ends.append(len(words))
            flat, lens = coder.words.ids(words)
            cuts = np.r_[0, np.cumsum(lens)][ends].tolist()
            raw = [flat[i:j].astype(coder.small).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), b.column("chunk"), pa.array(raw, pa.binary())], names=["key", "doc_id", "chunk", "ids"])

    return mapped(parts.select("key", "doc_id", "chunk", "start", "text", "since", "until"), run, "key string, doc_id long, chunk long, ids binary")


def pieces(rows: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(key, doc_id, chunk, ids) of long texts: (key, doc_id, text).

    Texts with a run that is longer than the overlap go on to the next round.
    """
    done: list[DataFrame] = []
    while True:
        met, _ = stitches(rows, size, overlap)
        whole = met.where("not torn").drop("torn")
        # stitches grow with the texts, so they are not for broadcasting, whatever they measure
        done.append(_ids(chunks(rows, size, overlap).join(whole.hint("merge"), ["key", "chunk"]), path))
        torn = met.where("torn")
        if torn.isEmpty():
            break
        rows = rows.join(torn.select("key").distinct(), "key", "left_semi")
        size, overlap = size * GROW, overlap * GROW
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(coded: DataFrame, path: str, keep: bool) -> DataFrame:
    """A row a document from its pieces, read in order, one at a time; a repeated row's pieces repeat, and so does its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        now = doc = last = None
        copies, n, ids_sha, text_sha, held_ids = 0, 0, hashlib.sha256(), hashlib.sha256(), []

        def done() -> pa.RecordBatch:
            cols = [pa.array([doc] * copies, pa.int64()), pa.array([n] * copies, pa.int64()), pa.array([ids_sha.hexdigest()] * copies), pa.array([text_sha.hexdigest()] * copies)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols.append(pa.array([np.concatenate(held_ids)] * copies, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            for key, doc_id, chunk, raw in zip(*(b.column(c) for c in ("key", "doc_id", "chunk", "ids")), strict=True):
                key, chunk = key.as_py(), chunk.as_py()
                if key != now:
                    if now is not None:
                        yield done()
                    now, doc, last = key, doc_id.as_py(), -1
                    copies, n, ids_sha, text_sha, held_ids = 0, 0, hashlib.sha256(), hashlib.sha256(), []
                copies += chunk == 0
                if chunk == last:
                    continue
                last = chunk
                ids = np.frombuffer(raw.as_buffer(), dtype=coder.small)
                n += len(ids)
                ids_sha.update(ids.astype("<u4").tobytes())
                text_sha.update(coder.decoded(ids))
                if keep:
                    held_ids.append(ids.astype(np.int32))
        if now is not None:
            yield done()

    schema = "doc_id long, " + _DIGEST + (", ids array<int>" if keep else "")
    return mapped(coded.repartition("key").sortWithinPartitions("key", "chunk"), run, schema)


def encode_documents(docs: DataFrame, path: str, ids: bool = False, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode ``docs.text`` without special tokens, and decode it again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the
    ids as array<int>.  A null text counts as empty: no tokens.  One row a
    document, repeated rows included; other columns are dropped.  A text of at
    most ``size`` characters is one chunk; longer ones are cut, stitched and
    encoded chunk by chunk to the last character.  An empty table gives no
    rows.  Copies of a text under other ids are separate texts, so a large
    group of them needs no task of its own.
    """
    if size < 2 * overlap or overlap < SIGHT + 1:
        raise ValueError("a chunk needs two overlaps, an overlap four characters")
    rows = own(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for b in slices(gathered(batches, BATCH_BYTES), most=BATCH_BYTES):
            words, ends = [], [0]
            for t in b.column("text").to_pylist():
                words += pre_tokens(t or "")
                ends.append(len(words))
            flat, lens = coder.words.ids(words)
            cuts = np.r_[0, np.cumsum(lens)][ends]
            raw, width = flat.astype("<u4").tobytes(), np.array([len(x) for x in coder.raw])
            back, at = coder.decoded(flat), np.r_[0, np.cumsum(width[flat])][cuts].tolist()
            sha = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            text_sha = [hashlib.sha256(back[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
            cols = [b.column("doc_id"), pa.array(np.diff(cuts)), pa.array(sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    length = F.coalesce(F.length("text"), F.lit(0))
    short = mapped(rows.where(length <= size), run, "doc_id long, " + _DIGEST + (", ids array<int>" if ids else ""))
    long = rows.where(length > size)
    if long.isEmpty():
        return short
    keyed = long.withColumn("key", F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256))
    return short.unionByName(_digests(pieces(keyed, path, size, overlap), path, ids))


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, raw (binary): the bytes behind ``coded.ids``; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for b in batches:
            back = [coder.decoded(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(back, pa.binary())], names=["doc_id", "raw"])

    return mapped(own(coded, "doc_id", "ids"), run, "doc_id long, raw binary")
