"""Bounded-space online packing of token sequences.

Every task keeps ``windows`` open windows of ``width`` tokens.  A document's
full windows leave at once; its rest goes to the open window where it fits
best, and when it fits nowhere the fullest window is emitted and replaced.
At a task's end its open windows stay as leftovers.  Leftover windows are merged
by the same rule, sixty-four tasks' windows at a time, until one task has seen
the last of them.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.llm.bpe import MergeList, WordStore, byte_letters
from terraledger.llm.scratch import held, mapped, materialize, own, slices

#: Token ids that end a document, a window's width, and open windows in a task.
END, WIDTH, WINDOWS = 1, 2048, 64
#: Partitions of leftovers that one merging task takes.
FAN_IN = 64


class WordBpe:
    """Ids of whole texts under a word-end BPE vocabulary, as the tokenizers library gives them.

    The vocabulary's rules never join text across white space, so text is cut
    at white space and each distinct chunk is encoded once.  Chunks of plain
    letters, digits and signs go through the lockstep merger; any other chunk,
    and any text with white space that the two sides read differently, goes
    through the library itself.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding(), self.library.no_truncation()
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters, end = byte_letters(), spec["model"]["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int32)
        bare = {i: len(t.removesuffix(end)) for t, i in vocab.items()}
        self.rules = MergeList([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges], bare)
        self.plain = re.compile("[!-ɏ]*").fullmatch
        self.odd_space = re.compile("[\x1c-\x1f]").search
        letter, digit = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
        self.parts = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{letter}]+|[{digit}]|[^\s{letter}{digit}]+").findall
        self.words = WordStore(self._encode)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, job = [], []
        for c in chunks:
            if self.plain(c) and "<|" not in c and "İ" not in c:
                p = self.parts(c.lower())
                job.append(len(p))
                parts += p
            else:
                job.append(np.array(self.library.encode(c, add_special_tokens=False).ids, dtype=np.int32))
        raw = [p.encode() for p in parts]
        lens = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(lens)
        if len(ends):
            sym[ends - 1] = self.final[flat[ends - 1]]
        ids, n = self.rules.merge(sym, lens)
        at = np.r_[0, np.cumsum(n)]
        out, sizes, k = [], [], 0
        for j in job:
            x = ids[at[k] : at[k + j]] if isinstance(j, int) else j
            k += j if isinstance(j, int) else 0
            out.append(x), sizes.append(len(x))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(sizes, dtype=np.int64)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        words: list[str] = []
        jobs = []
        for t in texts:
            if self.odd_space(t):
                jobs.append(np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.int32))
            else:
                w = t.split()
                jobs.append((len(words), len(words) + len(w)))
                words += w
        flat, lens = self.words.ids(words)
        ends = np.r_[0, np.cumsum(lens)]
        return [flat[ends[j[0]] : ends[j[1]]] if isinstance(j, tuple) else j for j in jobs]


def loaded(path: str) -> WordBpe:
    """One coder a worker process, with its store of words."""
    return held(f"words {path}", lambda: WordBpe(path))


class Windows:
    """At most ``most`` open windows, ordered by the room they have left."""

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most
        self.open: list[tuple[int, int]] = []  # (room, number), sorted
        self.held: dict[int, list] = {}
        self.n = 0

    def put(self, items: list, size: int) -> list | None:
        """Add items of ``size`` tokens in all; returns a window that is emitted for it, if any."""
        out = None
        i = bisect.bisect_left(self.open, (size, -1))
        if i == len(self.open):
            if len(self.open) == self.most:
                out = self.held.pop(self.open.pop(0)[1])
            room, number = self.width, self.n
            self.n += 1
            self.held[number] = []
        else:
            room, number = self.open.pop(i)
        self.held[number] += items
        if room > size:
            bisect.insort(self.open, (room - size, number))
            return out
        full = self.held.pop(number)
        if out is None:
            return full
        self.done = full  # a full one besides the emitted: hand it out next
        return out

    done: list | None = None

    def take_done(self) -> list | None:
        out, self.done = self.done, None
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, left boolean, part int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int32()]
    names = [f.split()[0] for f in PIECES.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _placed(items: list, window: int, left: bool, part: int) -> Iterator[tuple]:
    at = 0
    for x in items:
        yield (*x, window, at, left, part)
        at += x[2]


def pack(docs: DataFrame, vocab_path: str, width: int = WIDTH, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of all documents in windows of ``width`` tokens.

    Returns a row a piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  A document is its ids and then ``END``; a null or
    empty text is ``END`` alone, and repeated rows are packed as often as they
    occur.  Full windows of a long document are cut off first; the rest stays
    in one piece.  Other columns are dropped; an empty table gives no rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = loaded(vocab_path), TaskContext.get().partitionId()
        space, rows = Windows(width, windows), []
        number = part << 40
        for b in slices(batches):
            coded = coder.encode_many([t or "" for t in b.column("text").to_pylist()])
            for doc, ids in zip(b.column("doc_id").to_pylist(), coded, strict=True):
                ids = np.r_[ids, np.int32(END)].astype("<u4")
                n = len(ids)
                for at in range(0, n, width):
                    piece = (doc, at, min(width, n - at), zlib.crc32(ids[at : at + width].tobytes()), n)
                    ready = [[piece]] if piece[2] == width else [space.put([piece], piece[2]), space.take_done()]
                    for w in ready:
                        if w:
                            rows += _placed(w, number, False, part)
                            number += 1
            if len(rows) > 50_000:
                yield _batch(rows)
                rows = []
        for _, k in space.open:
            rows += _placed(space.held[k], number, True, part)
            number += 1
        yield _batch(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        space, rows, now, size, held = Windows(width, windows), [], None, 0, []

        def close():
            nonlocal rows
            for w in (space.put(held, size), space.take_done()) if held else ():
                if w:
                    rows += _placed([x[:5] for x in w], min(x[5] for x in w), False, part)

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if r[5] != now:
                    close()
                    now, size, held = r[5], 0, []
                held.append(r[:6])
                size += r[2]
        close()
        for _, k in space.open:
            w = space.held[k]
            rows += _placed([x[:5] for x in w], min(x[5] for x in w), True, part)
        yield _batch(rows)

    source = own(docs, "doc_id", "text")
    table, path = materialize(mapped(source, first, PIECES))
    done, paths, parts = [table.where("not left")], [], None
    left = table.where("left")
    while True:
        top = left.agg(F.max("part")).first()[0]
        if top is None:
            break
        last = top < fan_in
        to = F.lit(0) if last else (F.col("part") / fan_in).cast("int")
        n = 1 if last else top // fan_in + 1
        dealt = left.withColumn("part", to).repartitionByRange(n, "part").sortWithinPartitions("part", "window", "offset")
        table, path = materialize(mapped(dealt, merge, PIECES))
        paths.append(path)
        if last:
            done.append(table)
            break
        done.append(table.where("not left"))
        left = table.where("left")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset")
