"""File sources and sinks: delimited, fixed-width and JSON text, tiles, snapshots."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraledger.operators.spatial import tile


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8", keys: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """Text columns; malformed lines give nulls.  ``keys`` keeps only the rows whose ``on`` it holds."""
    df = spark.read.option("header", "true").option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").schema(schema).csv(path)
    return df if keys is None else df.join(keys.select(on), on, "left_semi")


def fixed_width(spark: SparkSession, path: str, fields: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Columns cut from lines by (name, start, end), 0-based and half open, trimmed."""
    return spark.read.text(path).select(*[F.trim(F.substring("value", a + 1, b - a)).alias(n) for n, a, b in fields])


def zipped_lines(spark: SparkSession, path: str, suffix: str = ".csv", encoding: str = "latin-1") -> DataFrame:
    """(member, n, value): lines of the text files in zip archives; an archive is read by one task and streamed line by line."""

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                archive = zipfile.ZipFile(io.BytesIO(raw))
                for member in (m for m in archive.namelist() if m.endswith(suffix)):
                    with io.TextIOWrapper(archive.open(member), encoding=encoding, errors="replace", newline=None) as f:
                        held: list[tuple[str, int, str]] = []
                        for n, line in enumerate(f):
                            held.append((member, n, line.rstrip("\n")))
                            if len(held) == 10_000:
                                yield pd.DataFrame(held, columns=["member", "n", "value"])
                                held = []
                        if held:
                            yield pd.DataFrame(held, columns=["member", "n", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "member string, n long, value string")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if a finished one is there, else what ``make`` gives, written there first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def tile_range(df: DataFrame, box: tuple[float, float, float, float], zoom: int) -> DataFrame:
    """Rows of a tile table (z, x, y) that a box of degrees (west, south, east, north) touches: whole folders are passed over."""
    corner = lambda lon, lat: df.sparkSession.range(1).select(*[c.cast("int").alias(n) for c, n in zip(tile(F.lit(float(lon)), F.lit(float(lat)), zoom), "xy", strict=True)]).first()
    low, high = corner(box[0], box[3]), corner(box[2], box[1])
    return df.where((F.col("z") == zoom) & F.col("x").between(low["x"], high["x"]) & F.col("y").between(low["y"], high["y"]))


def metadata(df: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """One row of JSON text: record count, min and max of numbers, sorted names of categories."""
    bounds = F.struct(*[F.struct(F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in numbers])
    names = F.struct(*[F.sort_array(F.collect_set(c)).alias(c) for c in categories])  # few names a category
    one = df.agg(F.count("*").alias("record_count"), bounds.alias("statistics"), names.alias("categories"))
    return one.select(F.to_json(F.struct("record_count", "statistics", "categories")).alias("value"))


def snapshot(df: DataFrame, path: str, date: str) -> None:
    """The table, and a copy under its date."""
    df.write.mode("overwrite").parquet(path)
    df.write.mode("overwrite").parquet(f"{path}_{date.replace('-', '_')}")


def tiles(df: DataFrame, path: str, lon: Column, lat: Column, zooms: Sequence[int]) -> None:
    """Rows by (z, x) folder and clustered by y, so that a bounding box reads few files."""
    out = None
    for z in zooms:
        x, y = tile(lon, lat, z)
        part = df.withColumns({"z": F.lit(z), "x": x, "y": y})
        out = part if out is None else out.unionByName(part)
    out.repartition("z", "x").sortWithinPartitions("z", "x", "y").write.mode("overwrite").partitionBy("z", "x").parquet(path)


def geojson(df: DataFrame, geometry: str, digits: int = 2) -> DataFrame:
    """One feature a row as JSON text: infinite numbers are null, doubles rounded half to even."""
    props = []
    for f in df.schema.fields:
        if f.name != geometry:
            c = F.col(f.name)
            if f.dataType.typeName() in ("double", "float"):
                c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.bround(c, digits))
            props.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*props).alias("properties"))).alias("value"))


def dictionary(df: DataFrame) -> DataFrame:
    """(column, type): the schema as a table."""
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type")) for n, t in df.dtypes])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def decode_wkt(c: Column) -> Column:
    """Rings of a WKT polygon as array<array<struct<x,y>>>; null for anything else."""
    body = F.regexp_extract(F.upper(F.trim(c)), r"^POLYGON\s*\(\s*(\(.*\))\s*\)$", 1)
    number = lambda p, i: F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double")
    ring = lambda r: F.transform(F.split(F.regexp_replace(r, r"[()]", ""), ","), lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))
    rings = F.transform(F.split(body, r"\)\s*,\s*\("), ring)
    whole = F.forall(rings, lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.when((body != "") & whole, rings)


def decode_wkb(c: Column) -> Column:
    """Rings of a little-endian WKB polygon as array<array<struct<x,y>>>; null for anything else."""

    @F.pandas_udf("array<array<struct<x: double, y: double>>>")
    def rings(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for raw in s:
                try:
                    if raw is None or raw[0] != 1 or int.from_bytes(raw[1:5], "little") != 3:
                        out.append(None)
                        continue
                    at, poly = 9, []
                    for _ in range(int.from_bytes(raw[5:9], "little")):
                        n = int.from_bytes(raw[at : at + 4], "little")
                        xy = np.frombuffer(raw, dtype="<f8", count=2 * n, offset=at + 4).reshape(-1, 2)
                        poly.append([{"x": float(x), "y": float(y)} for x, y in xy])
                        at += 4 + 16 * n
                    out.append(poly)
                except (ValueError, IndexError):
                    out.append(None)
            yield pd.Series(out)

    return rings(c)
