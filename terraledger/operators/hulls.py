"""Convex hulls by key, their least bounding rectangle, and widening to a least width."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraledger.operators import shapes

#: Parts in which a key's hulls meet before they meet as one; straight pieces of a quarter circle.
PARTS, QUARTER = 32, 16


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the least; the points themselves if they are one, both ends of a line."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append([x, y])
        return out[:-1]

    rows = p.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def least_rectangle(corners: np.ndarray) -> tuple[float, float] | None:
    """(shorter, longer) side of the rectangle of least area around a hull; None for a point or line.

    One side of it lies along an edge.  While the edges turn, the corners that
    touch the other sides only move on (rotating calipers): each is found among
    the edges' angles.
    """
    if len(corners) < 3:
        return None
    step = np.roll(corners, -1, axis=0) - corners
    unit = step / np.hypot(*step.T)[:, None]
    angle = np.unwrap(np.arctan2(step[:, 1], step[:, 0]))
    turning = np.r_[angle, angle + 2 * np.pi]

    def touched(turned: float) -> np.ndarray:  # the corner farthest in the edge's direction, turned by so much
        at = np.searchsorted(turning, angle + turned - 1e-12)
        return corners[at % len(corners)]

    normal = np.column_stack([-unit[:, 1], unit[:, 0]])
    ahead, across, behind = touched(np.pi / 2), touched(np.pi), touched(3 * np.pi / 2)
    length, height = ((ahead - behind) * unit).sum(1), ((across - corners) * normal).sum(1)
    area = length * height
    close = np.flatnonzero(area <= area.min() * (1 + 1e-9))
    sides = np.sort(np.column_stack([length, height])[close], axis=1)
    return tuple(sides[np.lexsort((sides[:, 1], sides[:, 0]))[0]].tolist())


def widened(corners: np.ndarray, by: float) -> np.ndarray:
    """The outline of all places within ``by`` of a hull, quarter circles as ``QUARTER`` straight pieces."""
    if len(corners) == 1:
        at = np.arange(4 * QUARTER) * (np.pi / 2 / QUARTER)
        return corners[0] + by * np.column_stack([np.cos(at), np.sin(at)])
    step = np.roll(corners, -1, axis=0) - corners
    out = np.arctan2(step[:, 1], step[:, 0]) - np.pi / 2  # where an edge faces
    ring = []
    for c, a, b in zip(corners, np.roll(out, 1), out, strict=True):
        turn = (b - a) % (2 * np.pi)
        at = a + turn * np.linspace(0, 1, max(1, int(np.ceil(turn / (np.pi / 2) * QUARTER - 1e-9))) + 1)
        ring.append(c + by * np.column_stack([np.cos(at), np.sin(at)]))
    return np.concatenate(ring)


def _by_key(points: DataFrame, key: list[str], n: int) -> DataFrame:
    """Hull corners of what a task, or of what a key's part, holds."""
    schema = T.StructType([points.schema[k] for k in key] + [T.StructField("p", T._parse_datatype_string("array<struct<x:double,y:double>>"))])
    part = F.pmod(F.xxhash64("x", "y"), F.lit(n)) if n > 1 else F.lit(0)
    grouped = points.groupBy(*key, part.alias("_part")).agg(F.collect_list(F.struct("x", "y")).alias("p")).drop("_part")
    return grouped.mapInArrow(lambda batches: _hulls(batches, key), schema)


def _hulls(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [hull(shapes.points(p.values)) for p in b.column("p")]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), shapes.ring_column(found)], names=[*key, "p"])


def _thinned(points: DataFrame, key: list[str]) -> DataFrame:
    """Points of each batch that are corners of their key's hull in it: what a hot key sends is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.zeros(b.num_rows, dtype=np.int64)
            for k in key:
                _, c = np.unique(np.array(b.column(k).dictionary_encode().indices.fill_null(-1)), return_inverse=True)
                codes = codes * (int(c.max(initial=0)) + 1) + c
            xy = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
            order = np.argsort(codes, kind="stable")
            keep = []
            for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                corners = {tuple(c) for c in hull(xy[rows])} if len(rows) > 8 else None
                keep += rows.tolist() if corners is None else [r for r in rows.tolist() if tuple(xy[r]) in corners]
            yield b.take(pa.array(keep, pa.int64()))

    return points.mapInArrow(run, points.schema)


def hulls(points: DataFrame, key: Sequence[str], x: str, y: str, least: float) -> DataFrame:
    """key..., corners, short, pad, footprint: a hull a key, widened until the shorter side of its least rectangle is ``least``.

    ``short`` is null where all points are one or lie on a line; such hulls are
    widened by half of ``least`` all round.  Points with a null or non-finite
    coordinate are left out.  A key's points first meet in batches, then in
    parts, then as one hull, so no task holds all points of a large key.
    """
    key = list(key)
    p = points.select(*key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("abs(x) < double('inf') and abs(y) < double('inf')")
    parts = _by_key(_thinned(p, key), key, PARTS).select(*key, F.explode("p").alias("c")).select(*key, "c.x", "c.y")
    ring = "array<struct<x:double,y:double>>"
    schema = T.StructType([points.schema[k] for k in key] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in (("corners", ring), ("short", "double"), ("pad", "double"), ("footprint", ring))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            corners = [shapes.points(c.values) for c in b.column("p")]
            sides = [least_rectangle(c) for c in corners]
            pad = [least / 2 if s is None else max(0.0, (least - s[0]) / 2) for s in sides]
            foot = [widened(c, w) if w else c for c, w in zip(corners, pad, strict=True)]
            cols = [shapes.ring_column(corners), pa.array([s and s[0] for s in sides], pa.float64()), pa.array(pad, pa.float64()), shapes.ring_column(foot)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), *cols], names=[*key, "corners", "short", "pad", "footprint"])

    return _by_key(parts, key, 1).mapInArrow(run, schema)
