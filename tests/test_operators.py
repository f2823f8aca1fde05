"""Hand-sized cases of the property operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraledger.functions import fields, rings, scalar
from terraledger.operators import assign, classify, components, lineage, mesh, metrics, ranks, spatial, stats, unions
from terraledger.plans import joins as _joins  # noqa: F401  registers its queries
from terraledger.plans.registry import QUERIES
from terraledger.streaming import telemetry


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_ratios_with_zero_land(spark):
    r = metrics.ratio_fields(spark.createDataFrame([(0.0, 5.0)], "land double, impr double")).first()
    assert (r["total"], r["impr_land_ratio"], r["impr_land_pct"], r["impr_pct_total"]) == (5, None, None, 100)


@pytest.mark.parametrize(("category", "land", "impr", "built", "foot", "code", "want"), [
    ("Vacant Parking", 1.0, 9.0, 0.0, False, "", "Vacant"), ("Parking Garage", 9.0, 1.0, 0.0, False, "", "Underdeveloped"), ("Single Family", 66.0, 34.0, 0.0, False, "", None),
    ("Single Family", 67.0, 33.0, 0.0, False, "", "Underdeveloped"), ("Single Family Home", 60.0, 40.0, 0.0, False, "", "Underdeveloped"), ("Shop", 50.0, 50.0, 0.0, False, None, "Underdeveloped"),
    ("Parking Lot", 1.0, 9.0, 0.0, False, "", "Parking Lot"), ("Shop", 5.0, 0.0, 0.0, False, "", "Vacant"), ("Shop", 5.0, None, None, False, None, "Vacant"), ("Shop", 5.0, 0.0, 10.0, False, "", None),
    ("Shop", 5.0, 0.0, 0.0, True, "", None), ("Shop", 5.0, 0.0, 0.0, False, "X9", None), ("Shop", 5.0, 0.0, 0.0, False, "1D1", None), ("Utility", 5.0, 0.0, 0.0, False, "", None)])
def test_refined_precedence(spark, category, land, impr, built, foot, code, want):
    cols = [F.col(x) for x in "clibfs"]
    got = one(spark, "c string, l double, i double, b double, f boolean, s string", [(category, land, impr, built, foot, code)], classify.refined(*cols))
    assert got == [(want,)]


@pytest.mark.parametrize(("tag", "building", "levels", "overlap", "area", "want"), [
    ("x", None, None, 0.5, 80_001, ("surface", "medium", "building_overlap")), ("x", None, None, 0.5, 80_000, ("uncertain", "low", "building_overlap")), ("x", None, 1, 0.9, 10, ("structure", "high", "building_overlap")),
    (None, None, None, 0.0, 10, ("surface", "high", "building_overlap")), (None, None, None, 0.2, 10, ("surface", "medium", "building_overlap")), ("surface", None, None, 0.2, 10, ("surface", "high", "osm_tag")),
    ("Rooftop", None, None, 0.0, 10, ("structure", "high", "osm_tag")), ("x", "garages", None, 0.0, 10, ("structure", "high", "osm_tag")), ("x", None, 2, 0.0, 10, ("structure", "high", "osm_tag"))])
def test_waterfall_gates(spark, tag, building, levels, overlap, area, want):
    w = classify.waterfall(F.lit(False), F.col("t"), F.col("b"), F.col("l"), F.lit(0.0), F.col("o"), F.col("a"))
    assert one(spark, "t string, b string, l int, o double, a int", [(tag, building, levels, overlap, area)], w["parking_type"], w["confidence"], w["source"]) == [want]


def test_fuel_gate(spark):
    w = classify.waterfall(F.lit(True), F.lit("x"), F.lit(""), F.lit(1), F.lit(0.0), F.lit(0.0), F.col("a"))
    assert one(spark, "a int", [(20_000,), (20_001,)], w["parking_type"]) == [("excluded",), ("surface",)]


def test_breaks_and_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert ranks.percentiles(df, ["v"], [50]).first()["p"] == [2.5]
    same = spark.createDataFrame([(7.0,)] * 9, "v double")
    assert ranks.percentiles(same, ["v"], stats.break_stops(5)).select(stats.rising(F.col("p"))).first()[0] == [7.0]
    flat = stats.mad_cap(same, "v", 3).first()
    assert (flat["cap"], flat["outliers"]) == (None, 0)
    cuts = F.array(F.lit(1.0), F.lit(2.0))
    assert [r[0] for r in df.select(stats.step_bin(F.col("v"), cuts)).collect()] == [1, 2, 2, 2]


def test_ranks_by_group(spark):
    rows = [(g, float(v)) for g, n in (("a", 7), ("b", 1), (None, 4)) for v in range(n)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["p"], r["n"]) for r in ranks.percentiles(df, ["v"], [0, 50, 90, 100], ["g"]).collect()}
    assert got == {"a": ([0, 3, 5.4, 6], 7), "b": ([0, 0, 0, 0], 1), None: ([0, 1.5, 2.7, 3], 4)}
    d = df.where("g is not null and v is not null").repartition(3)
    assert sorted((r["g"], r["place"]) for r in ranks.positions(d, ["g"], ["v"]).collect()) == [("a", i) for i in range(1, 8)] + [("b", 1)]


def test_nearest_widens_until_proved(spark):
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (5000, 0), (5000, 9), (90_000, 70_000)])]
    right = spark.createDataFrame(pts, "r long, rx double, ry double")
    left = spark.createDataFrame([(i + 100, x, y) for i, x, y in pts], "l long, lx double, ly double")
    got = spatial.nearest(left, right, 3, "l", "r", "lx", "ly", "rx", "ry", size=10).collect()
    for i, x, y in pts:
        want = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in pts)[:3]
        assert [(r["d2"], r["r"]) for r in sorted((r for r in got if r["l"] == i + 100), key=lambda r: r["place"])] == want


def test_status_classes(spark):
    got = one(spark, "s int", [(200,), (401,), (403,), (404,), (408,), (418,), (429,), (500,), (None,)], classify.status(F.col("s")))
    assert [g[0] for g in got] == [None, "unauthorized", "forbidden", "not_found", "timeout", "client_error", "rate_limited", "server_error", None]


def test_compact_money(spark):
    got = one(spark, "v double", [(1500.0,), (-1_250_000.0,), (2.6e9,), (999.4,)], scalar.compact(F.col("v")))
    assert [g[0] for g in got] == ["$2K", "$-1.3M", "$2.6B", "$999"]


def test_currency(spark):
    got = one(spark, "s string", [("($1,234)",), ("1,234",), ("12 Main",), ("",)], scalar.currency(F.col("s")))
    assert got == [(-1234.0,), (1234.0,), (None,), (None,)]


def test_clip_keeps_null(spark):
    assert one(spark, "v double", [(None,), (2.0,)], scalar.clip(F.col("v"), 0, 1)) == [(None,), (1.0,)]


def test_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "u long, v long")
    root = {r["node"]: r["root"] for r in components.connected(e).collect()}
    assert all(root[i] == 0 for i in range(41)) and root[101] == 100 and root[100] == 100


def test_episode_needs_two_good(spark):
    rows = [(1, t, b) for t, b in enumerate([1, 0, 1, 0, 0, 1])]
    got = telemetry.episodes(spark.createDataFrame(rows, "k int, t int, bad int"), "k", ["t"], F.col("bad") == 1).orderBy("first").collect()
    assert [(r["n_bad"], r["first"], r["last"]) for r in got] == [(2, 0, 2), (1, 5, 5)]


def test_stream_windows_match_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    df = spark.read.parquet(src)
    df.limit(400).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = telemetry.tumbling(stream, "ts", "1 day", ["event_type"], [F.count("*").alias("n")], late="1 day")
    w = q.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    got = {tuple(r) for r in spark.table("windows").select("start", "event_type", "n").collect()}
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {tuple(r) for r in telemetry.tumbling(batch, "ts", "1 day", ["event_type"], [F.count("*").alias("n")]).select("start", "event_type", "n").collect()}
    assert got == want


def test_greedy_equals_one_after_the_other(spark):
    rng = random.Random(3)
    for seed in range(3):
        cands = list(range(30))
        rank = {c: r for r, c in enumerate(rng.sample(cands, len(cands)))}
        members = [(c, m, rng.randint(1, 3)) for c in cands for m in rng.sample(range(40), rng.randint(1, 6))]
        weight = {m: w for _, m, w in members}
        members = [(c, m, weight[m]) for c, m, _ in members]
        want, free = set(), set(weight)
        for c in sorted(cands, key=rank.get):
            own = {m for k, m, _ in members if k == c} & free
            if sum(weight[m] for m in own) >= 4:
                want |= {(c, m) for m in own}
                free -= own
        got = assign.greedy(spark.createDataFrame(list(rank.items()), "cand long, rank long"), spark.createDataFrame(members, "cand long, member long, weight long"), least=4)
        assert {tuple(r) for r in got.collect()} == want


def test_development_and_address(spark):
    legal = ["Heron  Court, Phase 2, Lot 40", "Old Mill Townhomes, Common Area", "DOWNTOWN, LOT 5, 77 Quay Lofts Units 1-9", "COMMON AREA, NORTH BANK, BLOCK 2, HERON COURT", "DOWNTOWN, BLK 1", "", None, "WILLOW CONDOS -", "Common Area, Lot 2"]
    got = one(spark, "s string", [(x,) for x in legal], fields.development(F.col("s")))
    assert [g[0] for g in got] == ["HERON COURT", "OLD MILL", "DOWNTOWN | 77 QUAY LOFTS", "HERON COURT", "DOWNTOWN", "", "", "WILLOW", ""]
    text = ["12 Main St  Apt 4", "12 Oak Ave #5", "NONE (+2 more)", "none", "9 Elm St A12-3", "9 Pine Rd 7B", "5 High St (+3 more)", None, " "]
    got = one(spark, "s string", [(x,) for x in text], fields.base_address(F.col("s")))
    assert [g[0] for g in got] == ["12 MAIN ST", "12 OAK AVE", None, None, "9 ELM ST", "9 PINE RD", "5 HIGH ST", None, None]


def test_subdivisions(spark):
    text = ["The Oaks at Mill Creek, Phase 2", "CONDOMINIUM PUD", "2nd Filing B Lake 1999 View Point North", "Heron Unit 4", None, ""]
    got = one(spark, "s string", [(x,) for x in text], fields.subdivision_root(F.col("s")), fields.subdivision_family(F.col("s")))
    assert got == [("THE", "THE OAKS MILL"), (None, None), ("2ND", "FILING LAKE VIEW"), ("HERON", "HERON"), (None, None), (None, None)]


def test_expressions_and_nulls(spark):
    df = spark.createDataFrame([(None, None), (3.0, "b"), (12.0, "a")], "v double, k string")
    ask = lambda e: [r[0] for r in df.select(fields.expression(e)).collect()]
    assert ask(["to-number", ["get", "v"]]) == [0, 3, 12]
    assert ask(["==", ["get", "k"], "a"]) == [False, False, True] and ask(["!=", ["get", "k"], "a"]) == [True, True, False]
    assert ask(["-", ["to-number", ["get", "v"]]]) == [0, -3, -12]
    with pytest.raises(ValueError, match="no such operator"):
        fields.expression(["concat", "a"])
    assert ask(["step", ["to-number", ["get", "v"]], "lo", 3, "mid", 10, "hi"]) == ["lo", "mid", "hi"]
    assert ask(["interpolate", ["linear"], ["to-number", ["get", "v"]], 0, 0, 6, 60, 12, 0]) == [0, 30, 0]
    assert ask(["match", ["get", "k"], ["a", "c"], 1, "b", 2, 9]) == [9, 2, 1]
    assert ask(["case", [">", ["get", "v"], 5], "x", ["boolean", ["==", ["get", "k"], "b"]], "y", "z"]) == ["z", "y", "x"]


def test_rings(spark):
    square, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]
    df = spark.createDataFrame([([square, hole],), ([square[::-1]],)], "r array<array<struct<x:double,y:double>>>")
    r = F.col("r")
    assert [x[0] for x in df.select(rings.area(r)).collect()] == [15, 16]
    assert [x[0] for x in df.select(rings.holds(r, F.lit(1.5), F.lit(1.5))).collect()] == [False, True]
    assert [tuple(x[0]) for x in df.select(rings.centroid(r)).collect()] == [((32 - 1.5) / 15, (32 - 1.5) / 15), (2, 2)]
    assert [x[0] for x in df.select(rings.signed_area(F.element_at(rings.wound(r), 1))).collect()] == [16, 16]
    a, b = [x[0] for x in df.select(rings.shape_key(rings.filled(r))).collect()]
    assert a == b


def test_unions_are_exact(spark):
    rng = random.Random(5)
    rects = [(k, x, x + rng.randint(1, 9), y, y + rng.randint(1, 9)) for k in range(4) for x, y in [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(12)]]
    got = {r["k"]: r["covered"] for r in unions.union_area(spark.createDataFrame(rects, "k long, x0 long, x1 long, y0 long, y1 long"), ["k"]).collect()}
    for k in range(4):
        assert got[k] == len({(x, y) for g, x0, x1, y0, y1 in rects if g == k for x in range(x0, x1) for y in range(y0, y1)})


def test_percentiles_of_large_groups(spark, monkeypatch):
    """With a coarse sketch, groups large and small give the same as numpy."""
    monkeypatch.setattr(ranks, "ACCURACY", 100)
    monkeypatch.setattr(ranks, "SLACK", 4 / 100)
    rng = random.Random(8)
    draw = {"flat": lambda: rng.random(), "ties": lambda: float(rng.randrange(4)), "tail": lambda: rng.paretovariate(0.4), "few": lambda: rng.gauss(0, 1), "same": lambda: 3.0}
    rows = [(g, f(), rng.choice([None, f()])) for g, f in draw.items() for _ in range(150 if g == "few" else 4000)]
    df, ps = spark.createDataFrame(rows, "g string, v double, w double").repartition(6), [0, 0.5, 25, 50, 99.9, 100]
    for got in ranks.percentiles(df, ["v", "w"], ps, ["g"]).collect():
        xs = [r[1 if got["field"] == "v" else 2] for r in rows if r[0] == got["g"]]
        xs = [x for x in xs if x is not None]
        assert got["n"] == len(xs) and got["p"] == pytest.approx(np.percentile(xs, ps).tolist(), rel=1e-12)
    whole = ranks.percentiles(df, ["v"], ps).first()
    assert whole["p"] == pytest.approx(np.percentile([r[1] for r in rows], ps).tolist(), rel=1e-12)


def test_paged_texts_are_quoted():
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType

    from terraledger.sources.paged import PagedReader

    reader = PagedReader(StructType(), {"fetch": "a:b"})
    left = list(reader.pushFilters([EqualTo(("name",), "O'Hara"), GreaterThan(("n",), 3), EqualTo(("flag",), True)]))
    assert reader.where == ["name = 'O''Hara'", "n > 3"] and len(left) == 1


# ------------------------------------------------------------------ many shapes on one place


def crowd(seed, n, spread=12):
    """Rectangles with whole corners, many equal, some of equal area."""
    rng = np.random.default_rng(seed)
    x, y, w, h = rng.integers(0, spread, n) * 30, rng.integers(0, 3, n) * 30, rng.integers(1, 4, n) * 20, rng.integers(1, 4, n) * 20
    return [(int(k), *map(int, v)) for k, v in zip(rng.permutation(n), zip(x, x + w, y, y + h, strict=True), strict=True)]


BOXES = "lot long, x0 long, x1 long, y0 long, y1 long"


def test_carve_makes_no_pairs(spark):
    rows = crowd(31, 200)
    got = mesh.carved(spark.createDataFrame(rows, BOXES), size=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # the rectangles with what they keep
    taken, want = np.zeros((500, 200), dtype=bool), {}
    for k, x0, x1, y0, y1 in sorted(rows, key=lambda r: (-(r[2] - r[1]) * (r[4] - r[3]), r[0])):
        want[k] = ((x1 - x0) * (y1 - y0), int((~taken[x0:x1, y0:y1]).sum()))
        taken[x0:x1, y0:y1] = True
    assert {r["lot"]: (r["area"], r["kept"]) for r in got.collect()} == want


def test_carve_over_strips_of_the_grid(spark, monkeypatch):
    """Fractions of units and rectangles without area; painted a few columns at a time it is the same."""
    x = np.array([[0, 0.5, 2, 0], [3, 2.5, 6, 3.0]])
    y = np.array([[0, 0.5, 1, 0], [3, 4.5, 2, 3.0]])
    whole = mesh._painted(x, y)
    monkeypatch.setattr(mesh, "PAINT", 1)
    assert mesh._painted(x, y).tolist() == whole.tolist() == [9.0, 3.0, 3.0, 0.0]
    got = mesh.carved(spark.createDataFrame([(1, 5, 5, 0, 9), (2, 0, 9, 0, 9), (3, 0, 9, 0, 9)], BOXES)).collect()
    assert sorted((r["lot"], r["area"], r["kept"]) for r in got) == [(1, 0, 0), (2, 81, 81), (3, 81, 0)]


def test_first_meeting_joins_places_once(spark):
    left, right = crowd(32, 120), crowd(33, 90, spread=5)
    r = spark.createDataFrame(right, "bid long, bx0 long, bx1 long, by0 long, by1 long").withColumn("floors", F.col("bid") % 7)
    got = {v["lot"]: (v["bid"], v["floors"]) for v in spatial.first_meeting(spark.createDataFrame(left, BOXES), r, ("x0", "x1", "y0", "y1"), ("bx0", "bx1", "by0", "by1"), "bid", ["floors"]).collect()}
    want = {}
    for k, x0, x1, y0, y1 in left:
        met = [b for b, a0, a1, c0, c1 in right if x0 <= a1 and a0 <= x1 and y0 <= c1 and c0 <= y1]
        if met:
            want[k] = (min(met), min(met) % 7)
    assert got == want and len(got) < len(left)


def test_touching_groups(spark):
    """Equal rectangles are one node; groups are those of all pairs."""
    rows = [(k, k % 3, *b) for k, *b in crowd(34, 90, spread=40)]
    got = {(r["root"], r["n"]) for r in components.touching(spark.createDataFrame(rows, "lot long, kind long, x0 long, x1 long, y0 long, y1 long"), "lot", "kind", ("x0", "x1", "y0", "y1")).collect()}
    root = {r[0]: r[0] for r in rows}
    for _ in range(12):
        for k, g, x0, x1, y0, y1 in rows:
            for m, h, a0, a1, b0, b1 in rows:
                if g == h and x0 <= a1 and a0 <= x1 and y0 <= b1 and b0 <= y1:
                    root[k] = root[m] = min(root[k], root[m])
    assert got == {(v, list(root.values()).count(v)) for v in root.values()} and 1 < len(got) < 90


def test_token_overlap_pairs_names_first(spark, tmp_path):
    """Every two parts of one name are a pair, and pairs of parts go through no distinct."""
    rows = [(k, "B", "T" if k < 20 else "U", "hot bolt" if k % 2 else ("cold bolt" if k % 4 else "old ring x")) for k in range(24)] + [(90, "B", "T", None), (91, None, "T", "hot bolt")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    df = QUERIES["jn_24_token_overlap"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    words = {k: set(n.split()) if b and n else None for k, b, _, n in rows}
    kind = {k: t for k, _, t, _ in rows}
    want = sorted((a, b, round(len(words[a] & words[b]) / len(words[a]), 6)) for a in words for b in words if a < b and words[a] and words[b] and kind[a] == kind[b] and 2 * len(words[a] & words[b]) >= len(words[a]))
    assert sorted(map(tuple, df.collect())) == want and len(want) > 60


def test_neighbours_leave_their_tile_once(spark):
    """Only those of the nearest that are kept are moved on: no window over all that meet, ties by id, and columns of both sides come along."""
    rng = np.random.default_rng(35)
    pts = [(int(k), int(x), int(y), f"v{k}") for k, (x, y) in zip(rng.permutation(400), rng.integers(0, 60, (400, 2)) * 10, strict=True)]
    left, right = spark.createDataFrame(pts, "l long, lx long, ly long, name string"), spark.createDataFrame(pts, "r long, rx long, ry long, other string")
    got = spatial.nearest(left, right, 2, "l", "r", "lx", "ly", "rx", "ry", size=200, others=True)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString() and got.columns == [*left.columns, *right.columns, "d2", "place"]
    want = {(k, i + 1, *v) for k, x, y, _ in pts for i, v in enumerate(sorted(((x - a) ** 2 + (y - b) ** 2, m, n) for m, a, b, n in pts if m != k)[:2])}
    assert {(r["l"], r["place"], r["d2"], r["r"], r["other"]) for r in got.collect()} == want


def test_stored_rows_come_back(spark):
    df = lineage.stored(spark.range(5).selectExpr("id", "if(id = 2, null, id * 0.5) v"))
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 5 and df.where("v is null").count() == 1
