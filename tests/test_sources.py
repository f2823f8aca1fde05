"""Sources and sinks."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from terraledger.operators import mesh
from terraledger.sources import files, paged

ROWS = [{"id": i, "kind": "ab"[i % 2]} for i in range(25)]


def service(where, offset, limit):
    rows = [r for r in ROWS if not where or all({"=": a == b, ">": a > b}[s] for a, s, b in [_clause(r, w) for w in where.split(" and ")])]
    return len(rows) if limit is None else rows[offset : offset + limit]


def short(where, offset, limit):
    return 25 if limit is None else ROWS[offset : offset + limit - 1]


def _clause(row, text):
    name, sign, value = text.split(" ")
    return row[name], sign, type(row[name])(value.strip("'"))


def test_paged_scan_is_whole_and_filtered(spark, monkeypatch):
    paged.register(spark)
    read = lambda f: spark.read.format("paged").schema("id long, kind string").option("fetch", f"tests.test_sources:{f}").option("pagesize", "10").load()
    assert sorted(r["id"] for r in read("service").collect()) == list(range(25))
    assert read("service").rdd.getNumPartitions() == 3
    assert read("service").where("kind = 'a' and id > 10").count() == 7
    with pytest.raises(Exception, match=r"of \d+ rows"):
        read("short").collect()


def test_fixed_width_and_delimited(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0001 Oak St   12\n0002 Elm       7\n")
    got = files.fixed_width(spark, str(tmp_path / "a.txt"), [("id", 0, 4), ("street", 5, 14), ("n", 14, 17)]).collect()
    assert [tuple(r) for r in got] == [("0001", "Oak St", "12"), ("0002", "Elm", "7")]
    (tmp_path / "b.tsv").write_text("k\tv\na\t1\nb\t2\n")
    keys = spark.createDataFrame([("b",)], "k string")
    assert [tuple(r) for r in files.delimited(spark, str(tmp_path / "b.tsv"), "k string, v string", "\t", keys=keys, on="k").collect()] == [("b", "2")]


def test_geojson_and_tiles(spark, tmp_path):
    df = spark.createDataFrame([("g", 1.005, float("inf"), 10.0, 50.0)], "geometry string, a double, b double, lon double, lat double")
    assert '"a":1.0' in files.geojson(df, "geometry").first()[0] and '"b"' not in files.geojson(df, "geometry").first()[0]
    files.tiles(df, str(tmp_path / "t"), F.col("lon"), F.col("lat"), [3, 4])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("z", "x", "y").collect()) == [(3, 4, 2), (4, 8, 5)]
    files.snapshot(df, str(tmp_path / "s"), "2024-01-31")
    assert spark.read.parquet(str(tmp_path / "s_2024_01_31")).count() == 1
    assert files.dictionary(df).count() == 5


def test_wkb(spark):
    pts = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]
    raw = bytes([1]) + struct.pack("<III", 3, 1, len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts)
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(b"\x01\x02"),), (None,)], "g binary")
    got = [r[0] for r in df.select(files.decode_wkb(F.col("g"))).collect()]
    assert [(p["x"], p["y"]) for p in got[0][0]] == pts and got[1:] == [None, None]


def test_mesh_is_closed(spark):
    cells = spark.createDataFrame([(0, 0, 2.0), (1, 0, 3.0)], "a int, b int, h double")
    r = mesh.checked(mesh.prisms(cells, "a", "b", "h")).first()
    assert tuple(r) == (2, 24, 0, 5.0)
    assert mesh.stl_lines(mesh.prisms(cells, "a", "b", "h")).count() == 24


def test_carve_keeps_union_area(spark):
    boxes = spark.createDataFrame([(1, 0, 10, 0, 10), (2, 5, 15, 0, 9), (3, 0, 4, 0, 4), (4, 100, 101, 100, 101)], "lot long, x0 long, x1 long, y0 long, y1 long")
    got = {r["lot"]: r["kept"] for r in mesh.carved(boxes).collect()}
    assert got == {1: 100, 2: 45, 3: 0, 4: 1}


def by_id(where, ids, limit):
    return [r["id"] for r in ROWS] if ids is None else [r for r in ROWS if r["id"] in ids and r["id"] != (13 if where else None)]


def by_tile(where, box, limit):
    x0, y0, x1, y1 = box
    return [r for r in ROWS if x0 <= r["id"] % 5 <= x1 and y0 <= r["id"] // 5 <= y1]


def test_scans_by_id_by_tile_and_resumed(spark):
    paged.register(spark)
    read = lambda f, **o: spark.read.format("paged").schema("id long, kind string").option("fetch", f"tests.test_sources:{f}").options(**o).load()
    assert sorted(r["id"] for r in read("by_id", ids="1", pagesize="10").collect()) == list(range(25))
    with pytest.raises(Exception, match=r"9 of 10 rows"):
        read("by_id", ids="1", pagesize="10", where="id = 0").collect()
    tiles = read("by_tile", bbox="0,0,4,4", grid="2,2")
    assert tiles.rdd.getNumPartitions() == 4 and tiles.count() == 36
    assert sorted(r["id"] for r in tiles.dropDuplicates(["id"]).collect()) == list(range(25))
    assert sorted(r["id"] for r in read("service", pagesize="10", start="7", most="12").collect()) == list(range(7, 19))


def test_zip_cache_and_metadata(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "a,b\n1,caf\xe9\n".encode("latin-1"))
        z.writestr("two.txt", "no")
    assert [tuple(r) for r in files.zipped_lines(spark, str(tmp_path / "a.zip")).orderBy("n").collect()] == [("one.csv", 0, "a,b"), ("one.csv", 1, "1,caf\xe9")]
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert files.cached(spark, str(tmp_path / "c"), make).count() == files.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(made) == 1
    doc = json.loads(files.metadata(spark.createDataFrame([(1, "b"), (4, "a"), (None, "a")], "v int, k string"), ["v"], ["k"]).first()[0])
    assert doc == {"record_count": 3, "statistics": {"v": {"min": 1, "max": 4}}, "categories": {"k": ["a", "b"]}}


def test_tile_range_reads_few_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, -170.0 + i, 10.0) for i in range(0, 340, 10)], "id int, lon double, lat double")
    files.tiles(df, str(tmp_path / "t"), F.col("lon"), F.col("lat"), [4])
    got = files.tile_range(spark.read.parquet(str(tmp_path / "t")), (-50, 0, 0, 20), 4)
    assert sorted(r["id"] for r in got.collect()) == list(range(110, 191, 10))
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString()


def test_wkt(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3, 0 0), (1 1, 2 1, 1 2, 1 1))",), ("POINT (1 2)",), ("polygon((0 0,1 x,1 1))",), (None,)], "g string")
    got = [r[0] for r in df.select(files.decode_wkt(F.col("g"))).collect()]
    assert [[tuple(p) for p in ring] for ring in got[0]] == [[(0, 0), (4, 0), (4, 3), (0, 0)], [(1, 1), (2, 1), (1, 2), (1, 1)]]
    assert got[1:] == [None, None, None]


def test_mesh_exports(spark):
    t = mesh.prisms(spark.createDataFrame([(0, 0, 2.0)], "x int, y int, h double"), "x", "y", "h")
    obj = [r["value"] for r in mesh.obj_lines(t).orderBy("part", "n").collect()]
    assert sum(v.startswith("v ") for v in obj) == 8 and sum(v.startswith("f ") for v in obj) == 12
    raw = [bytes(r["record"]) for r in mesh.stl_records(t).collect()]
    assert len(raw) == 12 and all(len(r) == 50 for r in raw)
    normals = sorted(struct.unpack("<fff", r[:12]) for r in raw)
    assert normals == sorted(2 * [(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, -1.0)])
