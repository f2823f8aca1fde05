"""Polygons out of and into well-known text and bytes.

``decoded`` takes text, hexadecimal bytes or bytes in one column, polygons and
multipolygons, either byte order, with or without heights, measures and a
reference system.  What it cannot read, and other kinds of geometry, is null.
Vertices are read from the buffer as arrays, not one by one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraledger.operators import shapes

POLYGONS = f"array<{shapes.RINGS}>"
#: Codes of the two kinds, and the flags of heights, measures and a reference system in the extended form.
POLYGON, MULTIPOLYGON, WITH_Z, WITH_M, WITH_SRID = 3, 6, 0x80000000, 0x40000000, 0x20000000
_TEXT = re.compile(r"^\s*(?:SRID=\d+;)?\s*(MULTI)?POLYGON\s*(ZM|Z|M)?\s*(\(.*\))\s*$", re.IGNORECASE | re.DOTALL)
_HEX = re.compile(r"^(?:[0-9A-Fa-f]{2})+$")


def from_bytes(raw: bytes) -> list[list[np.ndarray]] | None:
    """Polygons of well-known bytes."""
    try:
        found, end = _geometry(raw, 0)
        return found if end == len(raw) else None
    except (ValueError, IndexError, struct.error):
        return None


def _geometry(raw: bytes, at: int) -> tuple[list[list[np.ndarray]] | None, int]:
    order = "<" if raw[at] == 1 else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    at += 5 + (4 if code & WITH_SRID else 0)
    plain = code & 0xFFFF
    dims = 2 + bool(code & WITH_Z) + bool(code & WITH_M) + {0: 0, 1: 1, 2: 1, 3: 2}[plain // 1000]
    n = struct.unpack_from(order + "I", raw, at)[0]
    at += 4
    out: list[list[np.ndarray]] = []
    if plain % 1000 == MULTIPOLYGON:
        for _ in range(n):
            part, at = _geometry(raw, at)
            out += part
        return out, at
    if plain % 1000 != POLYGON:
        raise ValueError("no polygon")
    rings = []
    for _ in range(n):
        k = struct.unpack_from(order + "I", raw, at)[0]
        rings.append(shapes.opened(np.frombuffer(raw, dtype=order + "f8", count=k * dims, offset=at + 4).reshape(k, dims)[:, :2].astype(np.float64)))
        at += 4 + 8 * k * dims
    return [rings] if rings else [], at


def from_text(text: str) -> list[list[np.ndarray]] | None:
    """Polygons of well-known text."""
    m = _TEXT.match(text)
    if not m:
        return None
    body = m[3].strip()[1:-1].strip()
    try:
        if m[1]:
            parts = re.split(r"\)\s*\)\s*,\s*\(\s*\(", body)
            return [_rings(p) for p in parts]
        return [_rings(body)]
    except ValueError:
        return None


def _rings(text: str) -> list[np.ndarray]:
    out = []
    for ring in re.split(r"\)\s*,\s*\(", text.strip("() \t\r\n")):
        points = ring.split(",")
        dims = len(points[0].split())
        flat = np.array(ring.replace(",", " ").split(), dtype=np.float64)
        if dims < 2 or len(flat) != dims * len(points):
            raise ValueError("points of unequal length")
        out.append(shapes.opened(flat.reshape(-1, dims)[:, :2]))
    return out


def any_form(value: str | bytes | None) -> list[list[np.ndarray]] | None:
    if value is None:
        return None
    if isinstance(value, bytes):
        return from_bytes(value)
    return from_bytes(bytes.fromhex(value)) if _HEX.match(value) else from_text(value)


def polygons_column(found: list[list[list[np.ndarray]] | None]) -> pa.ListArray:
    flat = shapes.polygon_column([p for f in found for p in f or []])
    ends = np.r_[0, np.cumsum([len(f or []) for f in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[[f is None for f in found], False].astype(bool)), flat)


def decoded(df: DataFrame, column: str, name: str = "polygons") -> DataFrame:
    """``df`` with ``name``: the column's polygons as array<polygon>, rings not closed."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(POLYGONS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, polygons_column([any_form(v) for v in b.column(column).to_pylist()])], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def to_bytes(polygons: list[list[np.ndarray]], big: bool = False) -> bytes:
    """Well-known bytes: one polygon as such, others as a multipolygon."""
    order = ">" if big else "<"
    head = lambda code, n: struct.pack(order + "BII", 0 if big else 1, code, n)
    one = lambda p: head(POLYGON, len(p)) + b"".join(struct.pack(order + "I", len(r) + 1) + np.vstack([r, r[:1]]).astype(order + "f8").tobytes() for r in p)
    return one(polygons[0]) if len(polygons) == 1 else head(MULTIPOLYGON, len(polygons)) + b"".join(map(one, polygons))


def encoded(df: DataFrame, polygons: str, name: str = "wkb", big: bool = False) -> DataFrame:
    """``df`` with ``name``: its polygons as well-known bytes; null stays null."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [to_bytes([p or [] for p in shapes.polygons(v.values)], big) if v.is_valid else None for v in b.column(polygons)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def as_text(polygons) -> F.Column:
    """Well-known text of a column of polygons."""
    point = lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), point), ", "), F.lit(")"))
    whole = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    return F.when(F.size(polygons) == 1, F.concat(F.lit("POLYGON "), whole(polygons[0]))).otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(polygons, whole), ", "), F.lit(")")))
