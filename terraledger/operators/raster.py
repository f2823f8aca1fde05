"""Masks of large rasters as tiles: filters over neighbourhoods, regions across seams, borders.

A tile is a bitmap of ``SIDE`` by ``SIDE`` pixels.  A filter needs its
surroundings, so each tile gives its eight neighbours the strips along their
common sides; with these every tile is filtered by itself, as the whole image
would be.  Regions are found tile by tile as runs of pixels, and only those
that touch a tile's side are joined over the seams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraledger.operators.borders import outlines, traced
from terraledger.operators.components import connected

#: Pixels along a tile's side: a tile's bits fit one bitmap of Spark's (32768).
SIDE = 128
_TILE = "ty long, tx long, bits binary"


def tiles(pixels: DataFrame, y: str = "y", x: str = "x", side: int = SIDE) -> DataFrame:
    """(ty, tx, bits) of the set pixels; tiles without one are left out.  Repeated pixels count once."""
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    at = F.pmod(F.col(y), F.lit(side)) * side + F.pmod(F.col(x), F.lit(side))
    p = pixels.select(cell(y).alias("ty"), cell(x).alias("tx"), (at + 1).cast("long").alias("p"))
    return p.groupBy("ty", "tx").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))


def _mask(bits: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=h * w, bitorder="little").reshape(h, w).astype(bool)


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask, bitorder="little").tobytes()


def pixels(tiles_: DataFrame, side: int = SIDE) -> DataFrame:
    """(y, x) of the set pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ty, tx, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                y, x = np.nonzero(_mask(bits, side, side))
                yield pa.RecordBatch.from_arrays([pa.array(y + ty * side), pa.array(x + tx * side)], names=["y", "x"])

    return tiles_.select("ty", "tx", "bits").mapInArrow(run, "y long, x long")


# ---------------------------------------------------------------- filters


def _part(at: int, halo: int, side: int) -> slice:
    """What of a tile lies beside a neighbour that is ``at`` (-1, 0, 1) further on."""
    return slice(None) if at == 0 else slice(side - halo, side) if at > 0 else slice(0, halo)


def _place(at: int, halo: int, side: int) -> slice:
    """Where that lies in the neighbour's widened image."""
    return slice(halo, halo + side) if at == 0 else slice(0, halo) if at > 0 else slice(halo + side, 2 * halo + side)


def filtered(tiles_: DataFrame, halo: int, f: Callable[[np.ndarray], np.ndarray], side: int = SIDE) -> DataFrame:
    """Tiles of ``f`` over the whole image, where a pixel depends on those within ``halo``; outside the image all is clear.

    Strips without a set pixel are not sent; a tile meets nine pieces at most.
    """
    if not 0 < halo <= side:
        raise ValueError("a halo of up to a tile")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ty, tx, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mask = _mask(bits, side, side)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        strip = mask[_part(dy, halo, side), _part(dx, halo, side)]
                        if strip.any():
                            out.append((ty + dy, tx + dx, dy, dx, _bits(strip)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["ty", "tx", "dy", "dx", "bits"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ty, tx, parts in zip(b.column("ty").to_pylist(), b.column("tx").to_pylist(), b.column("parts").to_pylist(), strict=True):
                image = np.zeros((side + 2 * halo,) * 2, dtype=bool)
                for p in parts:
                    hole = image[_place(p["dy"], halo, side), _place(p["dx"], halo, side)]
                    hole[:] = _mask(p["bits"], *hole.shape)
                mask = f(image)[halo:-halo, halo:-halo]
                if mask.any():
                    out.append((ty, tx, _bits(mask)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["ty", "tx", "bits"])

    strips = tiles_.select("ty", "tx", "bits").mapInArrow(send, "ty long, tx long, dy int, dx int, bits binary")
    return strips.groupBy("ty", "tx").agg(F.collect_list(F.struct("dy", "dx", "bits")).alias("parts")).mapInArrow(apply, _TILE)


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets within a distance."""
    reach = range(-radius, radius + 1)
    return [(dy, dx) for dy in reach for dx in reach if dy * dy + dx * dx <= radius * radius]


def _shifted(image: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Each pixel's neighbour at an offset; clear beyond the image."""
    out = np.zeros_like(image)
    h, w = image.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = image[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def opened(tiles_: DataFrame, radius: int, side: int = SIDE) -> DataFrame:
    """Morphological opening with a disk: what the disk can cover without leaving the mask."""
    offsets = disk(radius)

    def run(image: np.ndarray) -> np.ndarray:
        inner = np.logical_and.reduce([_shifted(image, dy, dx) for dy, dx in offsets])
        return np.logical_or.reduce([_shifted(inner, -dy, -dx) for dy, dx in offsets])

    return filtered(tiles_, 2 * radius, run, side)


def smoothed(tiles_: DataFrame, size: int, side: int = SIDE) -> DataFrame:
    """Majority of the square of an odd ``size`` around each pixel."""

    def run(image: np.ndarray) -> np.ndarray:
        r = size // 2
        total = np.pad(np.pad(image, r).astype(np.int32).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        n = total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]
        return n * 2 > size * size

    return filtered(tiles_, size // 2, run, side)


# ---------------------------------------------------------------- regions


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows y, x0, x1 of the runs of set pixels in reading order, the first run of each run's region).

    Runs of neighbouring rows that share a column belong together.
    """
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1]
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    start = np.searchsorted(y, np.arange(len(mask) + 1))
    for row in range(1, len(mask)):
        i, j = int(start[row - 1]), int(start[row])
        while i < start[row] and j < start[row + 1]:
            if x0[i] < x1[j] and x0[j] < x1[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    return np.column_stack([y, x0, x1]), np.array([find(i) for i in range(len(y))], dtype=np.int64)


def labelled(tiles_: DataFrame, side: int = SIDE) -> DataFrame:
    """(label, y, x0, x1): runs of set pixels (x1 excluded) with the label of their region over the whole image.

    A label is the place of the region's first run in some tile, y * 2^32 + x.
    Regions that touch no tile's side are final at once; of the others, only
    the runs along seams meet, and only their labels are joined to components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ty, tx, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, root = runs_of(_mask(bits, side, side))
                rim = (at[:, 0] == 0) | (at[:, 0] == side - 1) | (at[:, 1] == 0) | (at[:, 2] == side)
                seam = np.isin(root, root[rim])
                at = at + np.array([ty, tx, tx]) * side
                label = (at[:, 0] << 32) + at[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(label[root]), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(at[:, 2]), pa.array(seam)], names=["label", "y", "x0", "x1", "seam"])

    found = tiles_.select("ty", "tx", "bits").mapInArrow(run, "label long, y long, x0 long, x1 long, seam boolean")
    outer = found.where("seam")
    named = lambda cond, n: outer.where(cond).select(*[F.col(c).alias(c + n) for c in ("label", "y", "x0", "x1")])
    left, right = named(F.col("x1") % side == 0, "_a"), named(F.col("x0") % side == 0, "_b")
    upper, lower = named((F.col("y") + 1) % side == 0, "_a"), named(F.col("y") % side == 0, "_b")
    beside = left.join(right, (F.col("y_a") == F.col("y_b")) & (F.col("x1_a") == F.col("x0_b")))
    column = F.floor(F.col("x0_a") / side) == F.floor(F.col("x0_b") / side)
    below = upper.join(lower, (F.col("y_a") + 1 == F.col("y_b")) & column & (F.col("x0_a") < F.col("x1_b")) & (F.col("x0_b") < F.col("x1_a")))
    pairs = beside.select(F.col("label_a").alias("u"), F.col("label_b").alias("v")).unionByName(below.select(F.col("label_a").alias("u"), F.col("label_b").alias("v"))).distinct()
    roots = connected(pairs)
    merged = outer.join(roots.withColumnRenamed("node", "label"), "label", "left").select(F.coalesce("root", "label").alias("label"), "y", "x0", "x1")
    return found.where("not seam").select("label", "y", "x0", "x1").unionByName(merged)


def regions(runs: DataFrame) -> DataFrame:
    """(label, pixels, rings): each region as a polygon with holes, in pixel coordinates."""
    size = runs.groupBy("label").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))
    boxes = runs.select("label", "x0", "x1", F.col("y").alias("y0"), (F.col("y") + 1).alias("y1"))
    shape = traced(outlines(boxes, ["label"]), ["label"])  # joined along sides, a region has one exterior
    return shape.join(size, "label").select("label", "pixels", "rings")
