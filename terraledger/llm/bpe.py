"""Byte-pair encoding as a streaming transducer, and its inverse.

The encoder reads text in pieces and emits a token once no further input can
change it.  Two bounds make that possible:

* pre-tokens: a match of the splitting pattern is final once the buffer holds
  three characters past its start and one past its end;
* inside one pre-token: ``MergeList.lookahead`` bytes.  When input follows,
  the first difference between the two merge runs sits at the old end.  A rule
  (X, Z) can move it left by len(X), and only if Z begins at the current
  place, so Z is the former X or a token that starts with it, and the rule has
  a later rank.  The longest such chain over the merge list is the lookahead:
  tokens that end so far before the end of the input are stable.

A token boundary cuts BPE runs in two independent ones, so the encoder drops
what it has emitted and keeps one window.  Merging itself runs over many short
words in lockstep in numpy (``MergeList.merge``).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.llm.scratch import held, mapped, own, slices

NONE = np.int32(2**31 - 1)


class IntTable:
    """Open-addressing table from int64 keys to int32 values, read in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NONE, dtype=np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            s = slot[left]
            free = self.keys[s] == -1
            self.keys[s[free]] = keys[left[free]]  # of equal slots the last one wins
            won = self.keys[s] == keys[left]
            self.values[s[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], NONE)
        todo = np.flatnonzero((at != keys) & (at != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            at = self.keys[slot[todo]]
            found = at == keys[todo]
            out[todo[found]] = self.values[slot[todo[found]]]
            todo = todo[~found & (at != -1)]
        return out


class MergeList:
    """Merge rules over symbol ids; rank = position in ``pairs``."""

    def __init__(self, pairs: Sequence[tuple[int, int]], made: Sequence[int], width: dict[int, int]):
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        self.made = np.array(made, dtype=np.int32)
        self.ranks = IntTable(a << 32 | b, np.arange(len(a), dtype=np.int32))
        self.lookahead = self._lookahead(pairs, made, width)

    @staticmethod
    def _lookahead(pairs, made, width) -> int:
        parts = dict(zip(made, pairs, strict=True))
        if len(parts) != len(pairs):
            raise ValueError("a token made by two rules: the merge list has no lookahead bound")
        reach: dict[int, int] = {}
        known = set(width) - set(parts)
        most = max((width[s] for s in known), default=1)
        for (x, z), new in zip(pairs, made, strict=True):
            if x not in known or z not in known:
                raise ValueError("a rule uses a token that no earlier rule makes")
            known.add(new)
            best, s = 0, z
            while True:
                best = max(best, reach.get(s, 0))
                if s not in parts:
                    break
                s = parts[s][0]
            reach[x] = max(reach.get(x, 0), width[x] + best)
            most = max(most, reach[x])
        return most

    def merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words at once: ``sym`` is the words' symbols end to end."""
        n_words = len(lens)
        word = np.repeat(np.arange(n_words, dtype=np.int32), lens)
        sym = sym.astype(np.int32)
        rank = self._ranks(sym, word, np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            live = least != NONE
            if not live.all():
                keep = np.repeat(live, size)
                done_sym.append(sym[~keep]), done_word.append(word[~keep])
                sym, word, rank = sym[keep], word[keep], rank[keep]
                least, size = least[live], size[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, size)
            if (hit[1:] & hit[:-1]).any():  # aaa: leftmost first, every other one
                at = np.flatnonzero(hit)
                new_run = np.r_[True, np.diff(at) != 1]
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - first) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            sym, word, rank = sym[stay], word[stay], rank[stay]
            at = moved[at]
            near = np.r_[at, at[at > 0] - 1]
            rank[near] = self._ranks(sym, word, near)
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int32)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n_words).astype(np.int64)

    def _ranks(self, sym, word, at) -> np.ndarray:
        nxt = np.minimum(at + 1, len(sym) - 1)
        out = self.ranks.get(sym[at].astype(np.int64) << 32 | sym[nxt])
        out[(nxt == at) | (word[nxt] != word[at])] = NONE
        return out


def byte_letters() -> list[str]:
    """The printable stand-ins of the 256 byte values in byte-level vocabularies."""
    # The bytes that stand for themselves
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in own else chr(extra)
        extra += b not in own
    return out


class WordStore:
    """Ids of the words met so far, flat; forgets all when it holds ``most`` words."""

    def __init__(self, encode, most: int = 250_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.n_flat = np.zeros(1 << 16, dtype=np.int32), 0
        self.lens, self.offs = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each word has."""
        if len(self.index) > self.most:
            self.clear()
        get = self.index.get
        at = list(map(get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i is None))
            flat, lens = self.encode(new)
            self._append(new, flat, lens)
            at = list(map(get, words))
        at = np.array(at, dtype=np.int64)
        lens, offs = self.lens[at], self.offs[at]
        ends = np.cumsum(lens)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offs - (ends - lens), lens)], lens

    def _append(self, new, flat, lens) -> None:
        n0 = len(self.index)
        self.index.update(zip(new, range(n0, n0 + len(new)), strict=True))
        while self.n_flat + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n0 + len(new) > len(self.lens):
            self.lens, self.offs = np.r_[self.lens, np.zeros_like(self.lens)], np.r_[self.offs, np.zeros_like(self.offs)]
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.lens[n0 : n0 + len(new)] = lens
        self.offs[n0 : n0 + len(new)] = self.n_flat + np.cumsum(lens) - lens
        self.n_flat += len(flat)


#: How the byte-level vocabulary splits text, and the classes of long runs.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for text of which every letter is below U+0250, for the faster engine.
LATIN = re.compile(
    r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+|"""
    r""" ?[^\sA-Za-z0-9ª²³µ¹º¼-¾À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+""")  # fmt: skip
#: Characters outside the faster engine's range, or white space to the one engine only.
ODD = re.compile("[\x1c-\x1fɐ-\U0010ffff]")
RUNS = {"L": regex.compile(r"\p{L}+"), "N": regex.compile(r"\p{N}+"), "S": regex.compile(r"\s+"), "O": regex.compile(r"[^\s\p{L}\p{N}]+")}


class ByteBpe:
    """Streaming encoder and decoder of a byte-level BPE vocabulary file."""

    #: Characters read at a time, and the longest pre-token that is held whole.
    CHUNK, HELD = 1 << 16, 1 << 12

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
        raw = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if all(c in to_byte for c in t)}
        self.rules = MergeList([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges], {i: len(r) for i, r in raw.items()})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw |= {i: t.encode() for t, i in self.special.items()}
        self.raw = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.width = np.array([len(r) for r in self.raw], dtype=np.int64)
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.hold_back = max(map(len, self.special), default=1) - 1
        self.words = WordStore(self._encode_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        return self.rules.merge(self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.array([len(r) for r in raw]))

    # -------------------------------------------------------------- encoding

    def pieces(self, chunks: Iterable[str]) -> Iterator[list[str] | np.ndarray]:
        """Transduce text: lists of pre-tokens, arrays of ids (special tokens, parts of long pre-tokens).

        Holds at most one chunk, one pre-token of ``HELD`` characters and the
        lookahead, however long the text is.
        """
        buf, run, source = "", None, iter(chunks)
        nxt = next(source, None)
        ended = False
        while not ended:
            buf += nxt or ""
            nxt = next(source, None)
            ended = nxt is None
            while True:  # special tokens first; a suffix that may begin one waits
                m = self._special.search(buf) if self._special else None
                stop = m.start() if m else len(buf) if ended else self._safe_end(buf)
                out, rest, run = self._split(buf[:stop], ended or bool(m), run)
                yield from out
                if m is None:
                    buf = rest + buf[stop:]
                    break
                yield np.array([self.special[m.group()]], dtype=np.int32)
                buf, run = buf[m.end() :], None

    def _safe_end(self, buf: str) -> int:
        tail = max(0, len(buf) - self.hold_back)
        for i in range(tail, len(buf)):
            if any(s.startswith(buf[i:]) for s in self.special):
                return i
        return len(buf)

    def _split(self, text: str, final: bool, run: str | None) -> tuple[list, str, str | None]:
        out: list = []
        at = 0
        if run:  # inside a pre-token of which a part has been emitted
            m = RUNS[run].match(text)
            end = m.end() if m else 0
            if run == "S" and m and (end < len(text)):
                end -= 1  # the last white-space character may belong to what follows
            if end < len(text) or final:
                if end:
                    out.append(self._encode_words([text[:end]])[0])
                at, run = end, None
            else:
                ids, rest = self._stable(text)
                return [ids], rest, run
        found = (LATIN if not ODD.search(text) else SPLIT).findall(text, at)
        if final:
            return [*out, found], "", None
        end = len(text)
        while found and (end >= len(text) or end - len(found[-1]) + 3 > len(text)):
            end -= len(found.pop())
        out.append(found)
        m = SPLIT.match(text, end)
        if m and m.end() - end > self.HELD:
            kind = next(k for k, r in RUNS.items() if r.fullmatch(text, m.end() - 1, m.end()))
            ids, rest = self._stable(text[end : m.end()])
            return [*out, ids], rest + text[m.end() :], kind
        return out, text[end:], None

    def _stable(self, part: str) -> tuple[np.ndarray, str]:
        """Ids of ``part`` that no further input can change, and the text they leave."""
        raw = part.encode("utf-8", "surrogatepass")
        ids, _ = self.rules.merge(self.first[np.frombuffer(raw, dtype=np.uint8)], np.array([len(raw)]))
        ends = np.cumsum(self.width[ids])
        n = int(np.searchsorted(ends, len(raw) - self.rules.lookahead - 4, side="right"))
        while n and (raw[ends[n - 1]] & 0xC0) == 0x80:  # keep whole characters
            n -= 1
        return ids[:n], raw[ends[n - 1] if n else 0 :].decode("utf-8", "surrogatepass")

    def encode_many(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text; every text goes through ``pieces`` in chunks."""
        words: list[str] = []
        jobs = []  # for each text: list of (first word, last word) or ready ids
        for t in texts:
            job, at = [], len(words)
            for p in self.pieces(t[i : i + self.CHUNK] for i in range(0, len(t), self.CHUNK)):
                if isinstance(p, list):
                    words += p
                else:
                    job += [(at, len(words)), p]
                    at = len(words)
            jobs.append([*job, (at, len(words))])
        flat, lens = self.words.ids(words)
        ends = np.r_[0, np.cumsum(lens)]
        out = []
        for job in jobs:
            parts = [flat[ends[j[0]] : ends[j[1]]] if isinstance(j, tuple) else j for j in job]
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        return out

    def stream(self, chunks: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of one text as they become stable; what is held does not grow with the text."""
        for p in self.pieces(chunks):
            yield self.words.ids(p)[0] if isinstance(p, list) else p

    # -------------------------------------------------------------- decoding

    def decoded(self, ids: np.ndarray, step: int = 1 << 16) -> Iterator[str]:
        """Text of ids, piece by piece: a byte-to-text machine keeps only an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in range(0, len(ids), step):
            yield machine.decode(self._bytes(ids[i : i + step]))
        yield machine.decode(b"", True)

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))

    def digests(self, chunks: Iterable[str]) -> tuple[int, str, str]:
        """Number of ids of one text, SHA-256 of the ids and of the text decoded from them, in constant memory."""
        n, ids_sha, text_sha, machine = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for ids in self.stream(chunks):
            n += len(ids)
            ids_sha.update(ids.astype("<u4").tobytes())
            text_sha.update(machine.decode(self._bytes(ids)).encode("utf-8", "surrogatepass"))
        text_sha.update(machine.decode(b"", True).encode("utf-8", "surrogatepass"))
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


def loaded(path: str) -> ByteBpe:
    """One coder a worker process, with its store of words."""
    return held(f"bytes {path}", lambda: ByteBpe(path))


def encode_documents(docs: DataFrame, vocab_path: str, ids: bool = False) -> DataFrame:
    """Encode and decode ``docs.text``.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the
    ids as array<int>.  A null text counts as empty: no tokens.  One row a
    document, repeated rows included; other columns are dropped.  Long texts are
    encoded in chunks, to the last character; an empty table gives no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(vocab_path)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            far = [not ids and len(t) > coder.CHUNK for t in texts]  # these are digested chunk by chunk
            coded = iter(coder.encode_many([t for t, x in zip(texts, far, strict=True) if not x]))
            found, kept = [], []
            for t, x in zip(texts, far, strict=True):
                if x:
                    found.append(coder.digests(t[i : i + coder.CHUNK] for i in range(0, len(t), coder.CHUNK)))
                    continue
                own_ids = next(coded)
                h = hashlib.sha256()
                for part in coder.decoded(own_ids):
                    h.update(part.encode("utf-8", "surrogatepass"))
                found.append((len(own_ids), hashlib.sha256(own_ids.astype("<u4").tobytes()).hexdigest(), h.hexdigest()))
                kept.append(own_ids)
            cols = [b.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array([x.tolist() for x in kept], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return mapped(own(docs, "doc_id", "text"), run, schema)
