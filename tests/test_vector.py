"""Vector files, journalled scans and stateful windows."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraledger.operators import shapes
from terraledger.sources import journal, vector
from terraledger.streaming import windows

SCHEMA = f"id long, name string, polygons {vector.POLYGONS}"


def parcels(n, seed=1):
    """(id, name, polygons): boxes, some with a hole, some of two parts, some null."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.randint(-500, 500), rng.randint(-500, 500)
        box = lambda a, b, w: [(a, b), (a + w, b), (a + w, b + w), (a, b + w)]
        first = [box(x, y, 20)] + ([box(x + 5, y + 5, 4)] if k % 3 == 0 else [])
        polygons = [first] + ([[box(x + 30, y, 7)]] if k % 4 == 0 else [])
        out.append((k, f"nå {k % 7}" if k % 5 else None, None if k % 11 == 10 else polygons))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, n, None if p is None else [[[{"x": float(a), "y": float(b)} for a, b in r] for r in q] for q in p]) for i, n, p in rows], SCHEMA)


def rings_of(row):
    """Polygons as sets of vertices and areas, whatever vertex their rings begin at."""
    if row["polygons"] is None:
        return None
    return sorted(sorted((sorted((v["x"], v["y"]) for v in r), abs(shapes.signed_area(np.array([(v["x"], v["y"]) for v in r])))) for r in p) for p in row["polygons"])


def extent(polygons):
    xy = np.array([v for p in polygons for r in p for v in r])
    return (*xy.min(0), *xy.max(0))


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    """The same parcels as shapefiles and as GeoJSON: feature lines, and one collection."""
    vector.register(spark)
    rows, root = parcels(200), tmp_path_factory.mktemp("vector")
    df = frame(spark, rows).repartition(3)
    vector.write_shapefiles(df, str(root / "shp"), "polygons", {"id": 8, "name": 12})
    closed = lambda r: [list(map(float, v)) for v in [*r, r[0]]]
    features = [{"type": "Feature", "properties": {"id": i, "name": n, "note": '{"type": "Feature" in a text}'}, "geometry": None if p is None else {"type": "MultiPolygon", "coordinates": [[closed(r) for r in q] for q in p]}} for i, n, p in rows]
    (root / "lines").mkdir()
    (root / "lines" / "a.geojson").write_text("\n".join(map(json.dumps, features)))
    (root / "all.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=2))
    return rows, {"shapefile": str(root / "shp"), "geojson": str(root / "lines"), "collection": str(root / "all.json")}


def scan(spark, stores, kind, **options):
    return spark.read.format("geojson" if kind == "collection" else kind).schema(SCHEMA).options(**options).load(stores[1][kind])


@pytest.mark.parametrize("kind", ["shapefile", "geojson", "collection"])
def test_round_trip(spark, stores, kind):
    small = {"records": "7", "bytes": "900"}
    got = {r["id"]: (r["name"], rings_of(r)) for r in scan(spark, stores, kind, **small).collect()}
    want = {r["id"]: (r["name"], rings_of(r)) for r in frame(spark, stores[0]).collect()}
    assert got == want and scan(spark, stores, kind, **small).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("kind", ["shapefile", "geojson", "collection"])
def test_filters(spark, stores, kind):
    box = (-300.0, -300.0, 350.0, 300.0)
    got = scan(spark, stores, kind, bbox=",".join(map(str, box))).where("id > 30 and name = 'nå 3' and id <> 59")
    meets = lambda b: b[0] <= box[2] and box[0] <= b[2] and b[1] <= box[3] and box[1] <= b[3]
    want = {i for i, n, p in stores[0] if i > 30 and n == "nå 3" and i != 59 and p and meets(extent(p))}
    assert {r["id"] for r in got.collect()} == want and want
    assert scan(spark, stores, kind).where("id = 1000000").count() == 0
    assert {r["id"] for r in scan(spark, stores, kind).where("name is null").collect()} == {i for i, n, _ in stores[0] if n is None}


def test_geometry_is_not_read_for_nothing(spark, stores, tmp_path):
    """Where no record passes its attributes, the file of shapes is not even opened."""
    for f in os.listdir(stores[1]["shapefile"]):
        if f.endswith((".shx", ".dbf")):
            (tmp_path / f).write_bytes(open(os.path.join(stores[1]["shapefile"], f), "rb").read())
    lone = spark.read.format("shapefile").schema(SCHEMA).load(str(tmp_path))
    assert lone.where("id < 0").count() == 0
    with pytest.raises(Exception, match="shp"):
        lone.where("id >= 0").count()


def test_types_that_do_not_fit_are_null(spark, stores):
    odd = spark.read.format("geojson").schema(f"id string, name int, absent double, polygons {vector.POLYGONS}").load(stores[1]["geojson"])
    assert {(r["id"], r["name"], r["absent"]) for r in odd.collect()} == {(str(i), None, None) for i, _, _ in stores[0]}


# ------------------------------------------------------------------ journal


def test_a_stopped_scan_goes_on(spark, tmp_path):
    made, whole = [], [(b, b * 10 + k) for b in range(9) for k in range(3)]

    def make(block, until=99):
        if block > until:
            raise OSError("the service went away")
        made.append(block)
        return spark.createDataFrame([r for r in whole if r[0] == block], "b int, v int")

    with pytest.raises(OSError):
        journal.advance(spark, range(9), lambda b: make(b, 4), str(tmp_path / "j"), at_once=2)
    assert journal.finished(spark, str(tmp_path / "j")) == {0, 1, 2, 3}
    made.clear()
    got = journal.advance(spark, range(9), make, str(tmp_path / "j"), at_once=2)
    assert sorted(map(tuple, got.collect())) == whole and made == [4, 5, 6, 7, 8]
    # rows of a block that did not reach the journal are replaced, not doubled
    extra = make(7).withColumn("block", F.lit(12).cast("long"))
    extra.write.mode("append").partitionBy("block").parquet(str(tmp_path / "j" / "rows"))
    assert journal.advance(spark, range(9), make, str(tmp_path / "j")).count() == len(whole)
    assert journal.advance(spark, [*range(9), 12], lambda b: make(3), str(tmp_path / "j")).count() == len(whole) + 3


# ------------------------------------------------------------------ windows

RULES = windows.Rules(width=500, gap=3000, bad=100.0, good=2, history=3)


def test_windows_by_hand(spark):
    steps = [(0, 1), (300, 5), (600, 200), (1200, 150), (1800, 3), (2400, 170), (3000, 2), (3600, 1), (9000, 9), (9100, 300), (9700, 400), (20000, 1)]
    rows = [("a", t, float(v), i) for i, (t, v) in enumerate(steps)] + [(None, 0, 1.0, 0), (None, 700, None, 1)]
    df = spark.createDataFrame(rows, "k string, t long, v double, i int").withColumn("ts", F.timestamp_millis("t"))
    got = [tuple(r) for r in windows.windows(df, "k", "ts", "v", "i", RULES).collect()]
    assert sorted(got, key=str) == sorted([
        (None, "window", 0, 700, 1, None, None),
        ("a", "window", 0, 600, 2, 200.0, 200.0), ("a", "window", 600, 1200, 1, 150.0, 200.0), ("a", "window", 1200, 1800, 1, 3.0, 200.0), ("a", "window", 1800, 2400, 1, 170.0, 170.0),
        ("a", "window", 2400, 3000, 1, 2.0, 170.0), ("a", "window", 3000, 3600, 1, 1.0, 170.0), ("a", "episode", 0, 2400, 3, 200.0, None),
        ("a", "window", 9000, 9700, 2, 400.0, 400.0), ("a", "episode", 9000, 9700, 1, 400.0, None)], key=str)


def test_stream_equals_table(spark, tmp_path):
    """Samples that arrive out of order, within the watermark, give the rows of the sorted table; later ones are dropped."""
    rng = random.Random(4)
    rows, t = [], {k: 0 for k in range(4)}
    for i in range(240):
        k = rng.randrange(4)
        t[k] += rng.choice([90, 200, 400, 900, 4000])
        rows.append((k, t[k], rng.choice([1.0, 50.0, 300.0]), i))
    rows.sort(key=lambda r: r[1])
    blocks = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    schema = "k int, t long, v double, i int"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    path = str(tmp_path / "in")
    late = max(b[-1][1] - b[0][1] for b in blocks) * 2
    for n, block in enumerate([*blocks, [(9, rows[-1][1] + 10 * late, 0.0, -1)], [(0, 1, 999.0, -2), (9, rows[-1][1] + 10 * late + 100, 0.0, -3)]]):
        rng.shuffle(block)
        spark.createDataFrame(block, schema).withColumn("ts", F.timestamp_millis("t")).coalesce(1).write.mode("append").parquet(f"{path}/{n}")
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    q = windows.stream_windows(stream, "k", "ts", "v", "i", RULES, f"{late} milliseconds").writeStream.format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        q.processAllAvailable()
        q.awaitTermination(120)
        got = sorted(map(tuple, spark.table("wins").where("k < 9").collect()), key=str)
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("t"))
    want = sorted((tuple(r) for r in windows.windows(df, "k", "ts", "v", "i", RULES).collect()), key=str)
    assert got == want and {r[1] for r in want} == {"window", "episode"}
