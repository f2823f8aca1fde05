"""Fill-in-the-middle rearrangement of texts over ropes.

A text's units are ``[A-Za-z]+|[^A-Za-z]``.  It is cut at two unit ranks into
prefix, middle and suffix, and rearranged with sentinels, so that a model
learns to write the middle.  The text is a rope: leaves of some kilobytes with
their counts of units and code points, inner nodes with the sums.  A cut
descends by the counts and copies two leaves' bytes at most; rearranging joins
subtrees; the inverse cuts the rearranged rope at the sentinels' unit ranks.

A word may span leaves: a unit counts in the leaf where it starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terraledger.llm.scratch import mapped, own, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Units of a sentinel; bytes of a leaf.
SENTINEL_UNITS, LEAF = 3, 4096
#: Of a hundred, from where on a text stays plain, and up to where the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20


class Rope(NamedTuple):
    """A leaf (``raw`` set) or a node over two ropes, with what lies under it."""

    units: int
    points: int
    size: int
    raw: bytes | None = None
    joined: bool = False  # a leaf that begins inside a word
    left: Rope | None = None
    right: Rope | None = None


def _marks(raw: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """For UTF-8 bytes: where code points begin, and where units do."""
    point = (raw & 0xC0) != 0x80
    letter = ((raw | 0x20) - np.uint8(97)) < 26
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    if len(raw) and joined:
        unit[0] = False
    return point, unit


def _node(left: Rope | None, right: Rope | None) -> Rope | None:
    if left is None or right is None:
        return left if right is None else right
    return Rope(left.units + right.units, left.points + right.points, left.size + right.size, None, False, left, right)


def rope(text: bytes, leaf: int = LEAF) -> Rope | None:
    """A balanced rope over UTF-8 bytes; None for no text."""
    if not text:
        return None
    raw = np.frombuffer(text, dtype=np.uint8)
    point, unit = _marks(raw, False)
    starts = []
    for at in range(0, len(raw), leaf):
        while at < len(raw) and not point[at]:
            at += 1
        if at < len(raw) and (not starts or at > starts[-1]):
            starts.append(at)
    units, points = np.add.reduceat(unit, starts, dtype=np.int64), np.add.reduceat(point, starts, dtype=np.int64)
    level: list[Rope | None] = [
        Rope(int(u), int(p), z - a, text[a:z], not unit[a]) for a, z, u, p in zip(starts, [*starts[1:], len(raw)], units, points, strict=True)
    ]
    while len(level) > 1:
        level = [_node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def joined(*ropes: Rope | None) -> Rope | None:
    """One rope of several, in order."""
    out = None
    for r in ropes:
        out = _node(out, r)
    return out


def sentinel(mark: bytes) -> Rope:
    return Rope(SENTINEL_UNITS, len(mark), len(mark), mark)


def split(r: Rope | None, rank: int) -> tuple[Rope | None, Rope | None]:
    """The rope before and from its unit ``rank``; a rank past the end cuts nothing off."""
    if r is None or rank >= r.units:
        return r, None
    if r.raw is None:
        if rank < r.left.units:
            a, b = split(r.left, rank)
            return a, _node(b, r.right)
        a, b = split(r.right, rank - r.left.units)
        return _node(r.left, a), b
    point, unit = _marks(np.frombuffer(r.raw, dtype=np.uint8), r.joined)
    at = int(np.flatnonzero(unit)[rank])
    if at == 0:
        return None, r
    before = int(point[:at].sum())
    return Rope(rank, before, at, r.raw[:at], r.joined), Rope(r.units - rank, r.points - before, r.size - at, r.raw[at:])


def unit_rank(r: Rope, offset: int) -> int:
    """How many units start before a byte offset."""
    rank = 0
    while r.raw is None:
        if offset < r.left.size:
            r = r.left
        else:
            rank, offset, r = rank + r.left.units, offset - r.left.size, r.right
    return rank + int(_marks(np.frombuffer(r.raw, dtype=np.uint8), r.joined)[1][:offset].sum())


def flat(r: Rope | None) -> bytes:
    out, todo = [], [r] if r else []
    while todo:
        x = todo.pop()
        if x.raw is not None:
            out.append(x.raw)
        else:
            todo += [x.right, x.left]
    return b"".join(out)


def draws(doc_id: int | None, salt: str = "1:") -> list[int]:
    """Four 32-bit numbers from a document's id; a null id reads as no digits."""
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id: int | None, text: bytes, leaf: int = LEAF) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    whole = rope(text, leaf)
    n = whole.units if whole else 0
    h1, h2, h3, h4 = draws(doc_id)
    if not n or h3 % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(whole, high)
    prefix, middle = split(head, low)
    p, s, m = sentinel(PREFIX), sentinel(SUFFIX), sentinel(MIDDLE)
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    out = joined(s, suffix, p, prefix, m, middle) if form == "spm" else joined(p, prefix, s, suffix, m, middle)
    return n, form, prefix.points if prefix else 0, middle.points if middle else 0, flat(out)


def restored(output: bytes, form: str, leaf: int = LEAF) -> bytes:
    """The text that ``rearranged`` was given.

    A rearranged text holds no sentinel of its own, and none can arise where
    its parts meet one: a sentinel's first character occurs in it once.
    """
    if form == "plain":
        return output
    whole = rope(output, leaf)
    second = unit_rank(whole, output.index(SUFFIX if form == "psm" else PREFIX, len(PREFIX)))
    third = unit_rank(whole, output.index(MIDDLE, len(PREFIX)))
    rest, last = split(whole, third)
    first, between = split(rest, second)
    inner = [split(x, SENTINEL_UNITS)[1] for x in (first, between, last)]
    prefix, suffix = inner[:2] if form == "psm" else (inner[1], inner[0])
    return flat(joined(prefix, inner[2], suffix))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rearrange(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document.

    A null text counts as empty and stays plain, as do texts with a sentinel of
    their own.  Texts are rearranged whole, however long; equal ids draw equal
    numbers, so repeated rows give equal rows, and a null id draws as one id.
    Other columns are dropped; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, form, pre, mid, out = zip(*map(rearranged, b.column("doc_id").to_pylist(), _bytes(b.column("text"))), strict=True)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return mapped(own(docs, "doc_id", "text"), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``: the text behind each ``output`` and ``form``.  An empty output restores to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "output"):
            back = map(restored, _bytes(b.column("output")), b.column("form").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(back), pa.binary()).cast(pa.string())], names=[*b.schema.names, "restored"])

    return mapped(rows, run, T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())]))
