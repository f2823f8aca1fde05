"""Words of many texts at once, as arrays over their UTF-8 bytes.

Words are what ASCII white space parts; A-Z count as a-z.  A word's hash is a
polynomial over random numbers of its bytes, modulo 2**64, and mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def random_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


def _lowered() -> np.ndarray:
    table = random_numbers(256, 7)
    table[65:91] = table[97:123]
    return table


_BYTE = _lowered()
_SOLID = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Odd factor of a byte's place in its word.
_FACTOR = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each text begins in them, with the end of the last."""
    n, at = len(column), column.offset
    offs = np.frombuffer(column.buffers()[1], dtype=np.int32)[at : at + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


@dataclass
class Words:
    begins: np.ndarray  # first bytes
    last: np.ndarray  # last bytes
    owner: np.ndarray  # numbers of their texts
    marks: np.ndarray  # hashes


def words(raw: np.ndarray, offs: np.ndarray) -> Words:
    """All words of the texts, in order."""
    solid = _SOLID[raw]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    heads = offs[:-1][offs[:-1] < len(raw)]
    fresh[heads] = solid[heads]
    place = np.flatnonzero(solid).astype(np.int32)
    first = np.flatnonzero(fresh[place])
    begins = place[first]
    size = np.diff(np.r_[first, len(place)])
    within = place - np.repeat(begins, size)
    power = powers(_FACTOR, int(size.max(initial=0)))
    value = _BYTE[raw[place]]
    value *= power[within]
    marks = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.uint64)
    begins = begins.astype(np.int64)
    return Words(begins, begins + size - 1, np.searchsorted(offs, begins, side="right") - 1, mixed(marks, 0xBF58476D1CE4E5B9))
