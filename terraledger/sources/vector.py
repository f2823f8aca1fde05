"""Shapefiles and GeoJSON as Spark data sources, and a shapefile sink.

``spark.read.format("shapefile" | "geojson").schema(...).load(path)`` where the
path is a file or a folder of them.  A column ``polygons``
(``array<array<array<struct<x,y>>>>``: polygons, rings, vertices; exterior
first, rings not closed) takes the geometry, every other column the attribute
of its name.  Rows without a polygon have null there.

Partitions are ranges: of record numbers in a shapefile, whose index says where
they lie, of bytes in GeoJSON, where a feature belongs to the range in which it
begins.  Filters on single attributes are pushed down, and the option ``bbox``
(x0,y0,x1,y1) keeps features whose extent meets the box: a shapefile's
geometry is read only if some record of the range passes its attributes, and
vertices are decoded only if the record's own extent meets the box.
"""

from __future__ import annotations

import json
import operator
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terraledger.operators import shapes
from terraledger.operators.borders import nested

POLYGONS = f"array<{shapes.RINGS}>"
#: Records and bytes of a partition.
RECORDS, BYTES = 20_000, 32 << 20
#: Fixed values of the shapefile format: magic number, version, type of polygons.
MAGIC, VERSION, POLYGON = 9994, 1000, 5
_TESTS: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of one file, or of a folder's."""
    system, place = _open(path)
    info = system.get_file_info(place)
    found = system.get_file_info(fs.FileSelector(place)) if info.type == fs.FileType.Directory else [info]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes) and not f.base_name.startswith(("_", ".")))


def _bytes(path: str, start: int, length: int) -> bytes:
    system, place = _open(path)
    with system.open_input_file(place) as f:
        return f.read_at(max(0, min(length, f.size() - start)), start)


class VectorReader(DataSourceReader):
    suffixes: tuple[str, ...] = ()

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        box = options.get("bbox", "")
        self.box = [float(v) for v in box.split(",")] if box else None
        self.records, self.bytes = int(options.get("records", RECORDS)), int(options.get("bytes", BYTES))
        self.tests: list[tuple[str, type | None, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else "polygons"
            plain = isinstance(getattr(f, "value", None), (str, int, float)) and not isinstance(f.value, bool)
            if name != "polygons" and name in self.schema.names and (isinstance(f, IsNotNull) or type(f) in _TESTS and plain):
                self.tests.append((name, None if isinstance(f, IsNotNull) else type(f), getattr(f, "value", None)))
            else:
                yield f

    def passes(self, values: dict) -> bool:
        return all(values.get(n) is not None and (t is None or _TESTS[t](values[n], v)) for n, t, v in self.tests)

    def meets(self, box) -> bool:
        b = self.box
        return b is None or (box[0] <= b[2] and b[0] <= box[2] and box[1] <= b[3] and b[1] <= box[3])

    def batch(self, rows: list[dict], shapes_: list[list[list[np.ndarray]] | None]) -> pa.RecordBatch:
        types = to_arrow_schema(self.schema)
        cols = []
        for field in types:
            if field.name == "polygons":
                flat = shapes.polygon_column([p for s in shapes_ for p in s or []])
                ends = np.r_[0, np.cumsum([len(s or []) for s in shapes_])].astype(np.int32)
                col = pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[[s is None for s in shapes_], False].astype(bool)), flat)
                cols.append(col.cast(field.type))
            else:
                cols.append(pa.array([r.get(field.name) for r in rows], field.type))
        return pa.RecordBatch.from_arrays(cols, schema=types)

    def typed(self, name: str, value):
        """A value as its column's type; null where it is none."""
        kind = self.schema[name].dataType.typeName()
        try:
            if value is None or kind == "string":
                return value if value is None or isinstance(value, str) else json.dumps(value)
            if kind in ("integer", "long", "short", "byte"):
                return int(float(value)) if isinstance(value, str) and not value.lstrip("+-").isdigit() else int(value)
            if kind in ("double", "float"):
                return float(value)
            if kind == "boolean":
                return value if isinstance(value, bool) else str(value)[:1].upper() in ("T", "Y")
        except (TypeError, ValueError, OverflowError):
            return None
        return value


# ------------------------------------------------------------------ shapefiles


class ShapefileReader(VectorReader):
    def partitions(self):
        out = []
        for path, size in _files(self.path, (".shx",)):
            n = (size - 100) // 8
            out += [Range(path[:-4], at, min(n, at + self.records)) for at in range(0, n, self.records)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows = self._attributes(part)
        wanted = [i for i, r in enumerate(rows) if r is not None and self.passes(r)]
        if not wanted:
            return
        where = np.frombuffer(_bytes(part.path + ".shx", 100 + 8 * part.start, 8 * (part.end - part.start)), dtype=">i4").reshape(-1, 2).astype(np.int64) * 2
        first, last = int(where[wanted[0], 0]), int(where[wanted[-1]].sum()) + 8
        raw = _bytes(part.path + ".shp", first, last - first)
        keep, found = [], []
        for i in wanted:
            at = int(where[i, 0]) - first + 8
            kind = struct.unpack_from("<i", raw, at)[0]
            if kind in (5, 15, 25):  # polygons, also with heights or measures
                if self.meets(struct.unpack_from("<4d", raw, at + 4)):
                    keep.append(rows[i])
                    found.append(self._polygons(raw, at))
            elif self.box is None:
                keep.append(rows[i])
                found.append(None)
        yield self.batch(keep, found)

    @staticmethod
    def _polygons(raw: bytes, at: int) -> list[list[np.ndarray]]:
        parts, n = struct.unpack_from("<2i", raw, at + 36)
        cuts = [*np.frombuffer(raw, dtype="<i4", count=parts, offset=at + 44).tolist(), n]
        xy = np.frombuffer(raw, dtype="<f8", count=2 * n, offset=at + 44 + 4 * parts).reshape(-1, 2)
        rings = [shapes.opened(xy[a:b])[::-1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # there, exteriors run clockwise
        return nested(rings)

    def _attributes(self, part: Range) -> list[dict | None]:
        """A dictionary a record; None for deleted ones."""
        path = part.path + ".dbf"
        n, head, width = struct.unpack_from("<IHH", _bytes(path, 0, 32), 4)
        fields, at = [], 1
        spec = _bytes(path, 32, head - 32)
        for i in range(0, len(spec) - 31, 32):
            if spec[i] == 0x0D:
                break
            name, kind, size = spec[i : i + 11].split(b"\0")[0].decode("latin-1"), chr(spec[i + 11]), spec[i + 16]
            fields.append((name, kind, at, size))
            at += size
        raw = _bytes(path, head + part.start * width, (part.end - part.start) * width)
        names = [f for f in fields if f[0] in self.schema.names]
        out: list[dict | None] = []
        for i in range(part.end - part.start):
            rec = raw[i * width : (i + 1) * width]
            out.append(None if rec[:1] == b"*" else {name: self.typed(name, rec[a : a + size].decode("utf-8", "replace").strip() or None) for name, _, a, size in names})
        return out


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShapefileReader(schema, self.options)


def write_shapefiles(df: DataFrame, path: str, polygons: str, attributes: dict[str, int]) -> None:
    """One shapefile a partition; ``attributes`` are columns and their widths as text.

    Names follow the partition, so a task that runs again writes the same files.
    """
    names = list(attributes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}"
        system, place = _open(base)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        at, count, box = 100, 0, [np.inf, np.inf, -np.inf, -np.inf]
        with system.open_output_stream(place + ".shp.tmp") as shp, system.open_output_stream(place + ".shx.tmp") as shx, system.open_output_stream(place + ".dbf.tmp") as dbf:
            for f in (shp, shx):
                f.write(b"\0" * 100)
            dbf.write(_dbf_head(0, attributes))
            for b in batches:
                for i, multi in enumerate(b.column(polygons)):
                    body = struct.pack("<i", 0)
                    if multi.is_valid:
                        rings = [r if (shapes.signed_area(r) < 0) == (k == 0) else r[::-1] for p in shapes.polygons(multi.values) for k, r in enumerate(p or [])]
                        closed = [np.vstack([r, r[:1]]) for r in rings if len(r)]
                        if closed:
                            xy = np.vstack(closed)
                            own = [*xy.min(0), *xy.max(0)]
                            box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
                            body = struct.pack("<i4d2i", POLYGON, *own, len(closed), len(xy)) + np.cumsum([0, *map(len, closed)])[:-1].astype("<i4").tobytes() + xy.astype("<f8").tobytes()
                    count += 1
                    shp.write(struct.pack(">2i", count, len(body) // 2) + body)
                    shx.write(struct.pack(">2i", at // 2, len(body) // 2))
                    at += 8 + len(body)
                    values = ["" if (v := b.column(n)[i].as_py()) is None else str(v) for n in names]
                    dbf.write(b" " + b"".join(v.encode()[: attributes[n]].ljust(attributes[n]) for n, v in zip(names, values, strict=True)))
            dbf.write(b"\x1a")
        extent = box if np.isfinite(box).all() else [0.0] * 4
        for suffix, size in ((".shp", at), (".shx", 100 + 8 * count)):
            head = struct.pack(">7i", MAGIC, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, POLYGON, *extent, 0, 0, 0, 0)
            _finish(system, place + suffix, head)
        _finish(system, place + ".dbf", _dbf_head(count, attributes))
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    df.select(polygons, *names).mapInArrow(run, "n long").agg({"n": "sum"}).collect()


def _dbf_head(count: int, attributes: dict[str, int]) -> bytes:
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, count, 33 + 32 * len(attributes), 1 + sum(attributes.values()))
    return head + b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], b"C", w, 0) for n, w in attributes.items()) + b"\r"


def _finish(system: fs.FileSystem, path: str, head: bytes) -> None:
    """The file under its name, with the head that is known only at the end."""
    with system.open_input_stream(path + ".tmp") as old, system.open_output_stream(path) as new:
        old.read(len(head))
        new.write(head)
        while block := old.read(1 << 22):
            new.write(block)
    system.delete_file(path + ".tmp")


# ------------------------------------------------------------------ GeoJSON

#: How a feature begins; inside a JSON string its quotes would be escaped.
FEATURE = re.compile(rb'\{\s*"type"\s*:\s*"Feature"')
_LONGEST = 4096  # white space that a beginning may hold


class GeoJsonReader(VectorReader):
    def partitions(self):
        return [Range(path, at, min(size, at + self.bytes)) for path, size in _files(self.path, (".json", ".geojson", ".txt")) for at in range(0, size, self.bytes)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        raw = _bytes(part.path, part.start, part.end - part.start + _LONGEST)
        decoder = json.JSONDecoder()
        rows, found = [], []
        for m in FEATURE.finditer(raw):
            if m.start() >= part.end - part.start:
                break
            feature = self._feature(decoder, part, raw, m.start())
            values = {n: self.typed(n, (feature.get("properties") or {}).get(n)) for n in self.schema.names if n != "polygons"}
            if not self.passes(values):
                continue
            polygons = self._polygons(feature.get("geometry") or {})
            if self.box is not None:
                xy = np.vstack([r for p in polygons for r in p]) if polygons else None
                if xy is None or not self.meets((*xy.min(0), *xy.max(0))):
                    continue
            rows.append(values)
            found.append(polygons)
            if len(rows) == 2000:
                yield self.batch(rows, found)
                rows, found = [], []
        if rows:
            yield self.batch(rows, found)

    @staticmethod
    def _feature(decoder: json.JSONDecoder, part: Range, raw: bytes, at: int) -> dict:
        """The feature that begins at a place; where it runs past what was read, more is."""
        length = 1 << 16
        while True:
            end = at + length
            text = raw[at:end] if end <= len(raw) else _bytes(part.path, part.start + at, length)
            try:
                return decoder.raw_decode(text.decode("utf-8", "ignore"))[0]
            except json.JSONDecodeError:
                if len(text) < length:
                    raise
                length *= 4

    @staticmethod
    def _polygons(geometry: dict) -> list[list[np.ndarray]] | None:
        kind, xy = geometry.get("type"), geometry.get("coordinates") or []
        parts = [xy] if kind == "Polygon" else xy if kind == "MultiPolygon" else None
        if parts is None:
            return None
        return [[shapes.opened(np.array([v[:2] for v in ring], dtype=np.float64)) for ring in p if ring] for p in parts if p]


class GeoJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geojson"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoJsonReader(schema, self.options)


def register(spark) -> None:
    for source in (Shapefile, GeoJson):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
