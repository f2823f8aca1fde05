"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest piece at each place.  Over a trie
of the vocabulary with failure links (Song et al., 2021) it needs one pass: when
no edge fits, the link leads to the state of the text that is left, and the
pieces which are complete by then are popped.  Only their number is kept, so a
word's count comes out without building a piece.  The automaton runs over many
distinct words in lockstep; texts then sum their words' counts.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.llm.bpe import NONE, IntTable, byte_letters
from terraledger.llm.scratch import held, mapped, own, slices

#: Runs of letters, digits and underscores; any other sign is a word.
WORDS = re.compile(r"\w+|[^\w\s]")


def pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """(pieces that begin a word, pieces that continue one) from a byte-level vocabulary file.

    Entries with the marker of a leading blank begin words; the rest continue
    them.  Every single byte may do either, so each word has a splitting.
    """
    spec = json.load(open(path, encoding="utf-8"))
    letters = byte_letters()
    to_byte = {c: b for b, c in enumerate(letters)}
    blank = letters[32]
    single = {bytes([b]) for b in range(256)}
    raw = [t for t in spec["model"]["vocab"] if all(c in to_byte for c in t)]
    first = {bytes(to_byte[c] for c in t[1:]) for t in raw if t[0] == blank and len(t) > 1}
    rest = {bytes(to_byte[c] for c in t) for t in raw if blank not in t}
    return first | single, rest | single


class LongestMatch:
    """States 0 (start of a word) and 1 (start of a continuation), then the tries' nodes."""

    def __init__(self, first: set[bytes], rest: set[bytes]):
        edges: list[dict[int, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, vocab in ((0, first), (1, rest)):
            for piece in sorted(vocab):
                u = root
                for c in piece:
                    if c not in edges[u]:
                        edges[u][c] = len(edges)
                        edges.append({}), ends.append(False)
                    u = edges[u][c]
                ends[u] = True
        n = len(edges)
        fail, pops = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
        todo = deque([0, 1])
        while todo:  # nearer the root first: a link leads to a shorter rest
            u = todo.popleft()
            for c, v in edges[u].items():
                todo.append(v)
                if ends[v]:
                    fail[v], pops[v] = 1, 1
                    continue
                z, k = fail[u], pops[u]
                while z >= 0 and c not in edges[z]:
                    k += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = edges[z][c], k
        self.fail, self.pops = fail, pops
        keys = np.array([u << 8 | c for u in range(n) for c in edges[u]], dtype=np.int64)
        self.edges = IntTable(keys, np.array([v for e in edges for v in e.values()], dtype=np.int32))

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; 1 for a word that no pieces make up, 0 for an empty one."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-lens, kind="stable")
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        starts, lens = (np.cumsum(lens) - lens)[order], lens[order]
        state, count, lost = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
        for t in range(int(lens[0]) if len(lens) else 0):
            at = np.arange(int(np.searchsorted(-lens, -t, side="left")))
            at = at[~lost[at]]
            c = flat[starts[at] + t]
            while len(at):
                to = self.edges.get(state[at] << 8 | c)
                ok = to != NONE
                state[at[ok]] = to[ok]
                at, c = at[~ok], c[~ok]
                back = self.fail[state[at]]
                lost[at[back < 0]] = True
                at, c, back = at[back >= 0], c[back >= 0], back[back >= 0]
                count[at] += self.pops[state[at]]
                state[at] = back
        at = np.flatnonzero(~lost & (lens > 0) & (state != 1))
        while len(at):
            back = self.fail[state[at]]
            lost[at[back < 0]] = True
            at, back = at[back >= 0], back[back >= 0]
            count[at] += self.pops[state[at]]
            state[at] = back
            at = at[back != 1]
        count[lost] = 1
        out = np.empty_like(count)
        out[order] = count
        return out


class Counter:
    """Counts of texts, with a store of the words met."""

    def __init__(self, path: str, most: int = 300_000):
        self.match, self.most, self.seen = LongestMatch(*pieces(path)), most, {}

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, words) of each text."""
        if len(self.seen) > self.most:
            self.seen.clear()
        words, ends = [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            words += WORDS.findall(t)
            ends[i] = len(words)
        get = self.seen.get
        n = list(map(get, words))
        if None in n:
            new = list({w for w, k in zip(words, n, strict=True) if k is None})
            self.seen.update(zip(new, self.match.counts([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))
            n = list(map(get, words))
        sums = np.r_[0, np.cumsum(np.array(n, dtype=np.int64))]
        starts = np.r_[0, ends[:-1]]
        return sums[ends] - sums[starts], ends - starts


def count_tokens(docs: DataFrame, vocab_path: str) -> DataFrame:
    """A row a document: doc_id, n_tokens, n_words.

    Null and empty texts have none of either.  Repeated rows are counted each;
    columns other than doc_id and text are dropped.  Texts and words of any
    length are counted whole; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(f"pieces {vocab_path}", lambda: Counter(vocab_path))
        for b in slices(batches):
            tokens, words = counter.many([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tokens), pa.array(words)], names=["doc_id", "n_tokens", "n_words"])

    return mapped(own(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, n_words long")
