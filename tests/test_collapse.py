"""Collapse passes, layer tags, decoded geometry and condominium values against plain versions."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraledger.operators import collapse, components, condos, regions, shapes
from terraledger.sources import geometry

RULES = collapse.Rules(reach=1.0, ground_ratio=1.2, complex_ratio=1.5, child=60, parent=70, complex_units=3, complex_children=2, rest=60, support=200, anchor_units=3)
SCHEMA = "id long, kind string, family string, tokens array<string>, support boolean, land long, impr long, area double, units long, x0 double, x1 double, y0 double, y1 double"


def accounts(seed, n=140):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.randint(0, 70), rng.randint(0, 70), rng.randint(3, 12), rng.randint(3, 12)
        family = rng.choice(["OAK COURT", "OAK PARK", "ELM COURT", "ELM", None])
        out.append(dict(id=i, kind=rng.choice(["parcel", "condo", "condo"]), family=family, tokens=family.split() if family else [], support=rng.random() < 0.3, land=rng.randint(0, 99), impr=rng.randint(0, 99), area=float(w * h), units=rng.randint(1, 3), x0=float(x), x1=float(x + w), y0=float(y), y1=float(y + h)))
    return out


def near(a, b, reach=RULES.reach):
    return a["id"] != b["id"] and a["x0"] - reach <= b["x1"] and b["x0"] <= a["x1"] + reach and a["y0"] - reach <= b["y1"] and b["y0"] <= a["y1"] + reach


def plain_merge(rows, groups, kind, own_area):
    """``groups``: head id -> member ids."""
    by = {r["id"]: r for r in rows}
    gone = {m for ms in groups.values() for m in ms}
    out = [r for r in rows if r["id"] not in gone]
    for head, ids in groups.items():
        ms = sorted((by[m] for m in ids), key=lambda r: (r["id"] != head, -r["units"], r["id"]))
        total = lambda c: sum(r[c] for r in ms)
        area = by[head]["area"] if own_area and head in ids else total("area")
        out.append(dict(id=head, kind=kind, family=next((r["family"] for r in ms if r["family"]), None), tokens=next((r["tokens"] for r in ms if r["tokens"]), []), support=False, land=total("land"), impr=total("impr"), area=area, units=total("units"), x0=min(r["x0"] for r in ms), x1=max(r["x1"] for r in ms), y0=min(r["y0"] for r in ms), y1=max(r["y1"] for r in ms)))
    return out


def plain_claimed(rows, pairs, enough, kind):
    """``pairs``: head -> children; heads choose one after the other."""
    by, taken, groups = {r["id"]: r for r in rows}, set(), {}
    for head in sorted(pairs, key=lambda h: (-sum(by[c]["units"] for c in pairs[h]), -by[h]["area"], h)):
        free = [c for c in pairs[head] if c not in taken]
        if free and enough(sum(by[c]["units"] for c in free), len(free)):
            groups[head] = [head, *free]
            taken |= set(free)
    return plain_merge(rows, groups, kind, True)


def plain_clusters(rows, some, kind):
    groups, seen = {}, set()
    for r in sorted(some, key=lambda r: r["id"]):
        if r["id"] not in seen:
            todo, found = [r], {r["id"]}
            while todo:
                a = todo.pop()
                for b in some:
                    if b["id"] not in found and b["family"] == a["family"] and (near(a, b) or near(b, a)):
                        found.add(b["id"])
                        todo.append(b)
            seen |= found
            if len(found) > 1:
                groups[min(found)] = sorted(found)
    return plain_merge(rows, groups, kind, False)


def plain_passes(rows, lots):
    on = {}
    for r in rows:
        x, y = (r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2
        held = [k for k, a, b, c, d in lots if a <= x <= b and c <= y <= d]
        if held:
            on.setdefault(min(held), []).append(r["id"])
    sizes = {-1 - k: float((b - a) * (d - c)) for k, a, b, c, d in lots}
    rows = plain_merge(rows, {-1 - k: ids for k, ids in on.items() if len(ids) > 1}, "platted", False)
    for r in rows:
        r["area"] = sizes.get(r["id"], r["area"])
    yield rows
    pairs = {}
    for g in rows:
        if g["kind"] == "parcel":
            fit = [c for c in rows if c["kind"] == "condo" and c["family"] and near(g, c) and g["area"] >= max(c["area"], 1) * RULES.ground_ratio]
            families = {f: sum(c["units"] for c in fit if c["family"] == f) for f in {c["family"] for c in fit}}
            if families:
                best = min(families, key=lambda f: (-families[f], f))
                pairs[g["id"]] = [c["id"] for c in fit if c["family"] == best]
    rows = plain_claimed(rows, pairs, lambda w, n: w >= 2, "ground")
    yield rows
    rows = plain_clusters(rows, [r for r in rows if r["kind"] == "ground" and r["family"]], "campus")
    yield rows

    def words(heads, children, fits=lambda h, c: True):
        return {h["id"]: ids for h in heads if (ids := [c["id"] for c in children if near(h, c) and set(h["tokens"]) & set(c["tokens"]) and fits(h, c)])}

    small = lambda r, most: bool(r["tokens"]) and r["kind"] in ("condo", "platted") and 1 <= r["area"] <= most
    parents = [r for r in rows if not small(r, RULES.child) and r["tokens"] and r["area"] >= RULES.parent]
    rows = plain_claimed(rows, words(parents, [r for r in rows if small(r, RULES.child)], lambda h, c: h["area"] >= c["area"] * RULES.complex_ratio), lambda w, n: w >= RULES.complex_units and n >= RULES.complex_children, "complex")
    yield rows
    rows = plain_claimed(rows, words([r for r in rows if r["kind"] == "complex"], [r for r in rows if small(r, RULES.rest)]), lambda w, n: True, "complex")
    yield rows
    anchor = lambda r: bool(r["tokens"]) and (r["kind"] in collapse.MERGED or (r["kind"] == "condo" and r["units"] >= RULES.anchor_units))
    support = [r for r in rows if r["tokens"] and not anchor(r) and (r["support"] or r["kind"] in ("platted", "condo")) and 1 <= r["area"] <= RULES.support]
    rows = plain_claimed(rows, words([r for r in rows if anchor(r)], support), lambda w, n: True, "complex")
    yield rows
    yield plain_clusters(rows, [r for r in rows if anchor(r) and r["family"]], "campus")


@pytest.mark.parametrize("seed", [1, 2])
def test_seven_passes_equal_plain(spark, seed):
    rows = accounts(seed)
    lots = [(k, 20 * k % 60, 20 * k % 60 + 9, 17 * k % 60, 17 * k % 60 + 9) for k in range(6)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = collapse.passes(df, spark.createDataFrame(lots, "lot long, x0 long, x1 long, y0 long, y1 long"), RULES)
    sizes = [len(rows)]
    for (name, mine), want in zip(got, plain_passes(rows, lots), strict=True):
        key = lambda r: (r["id"], r["kind"], r["family"], tuple(r["tokens"]), r["land"], r["impr"], r["area"], r["units"], r["x0"], r["x1"], r["y0"], r["y1"])
        assert sorted(map(key, mine.collect()), key=str) == sorted(map(key, want), key=str), name
        sizes.append(len(want))
        assert [sum(r[c] for r in want) for c in ("land", "impr", "units")] == [sum(r[c] for r in rows) for c in ("land", "impr", "units")]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[4] and sizes[-1] < sizes[0] / 1.5


def test_passes_over_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [r.count() for _, r in collapse.passes(none, spark.createDataFrame([], "lot long, x0 long, x1 long, y0 long, y1 long"), RULES)] == [0] * 7


# ------------------------------------------------------------------ layers


def test_tags_by_layers(spark):
    rng = np.random.default_rng(3)
    polygons = [[np.array([(x, y), (x + w, y - 3), (x + w - 4, y + h), (x - 5, y + h - 2)]), np.array([(x + w / 3, y + h / 3), (x + w / 3, y + h / 2), (x + w / 2, y + h / 2)])] for x, y, w, h in rng.uniform(10, 60, (40, 4))]
    names = [None if k == 7 else f"zone {k}" for k in range(40)]
    shape = spark.createDataFrame([(n, k, [[{"x": float(a), "y": float(b)} for a, b in r] for r in p]) for k, (n, p) in enumerate(zip(names, polygons, strict=True))], f"name string, place int, rings {shapes.RINGS}")
    points = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 130, (300, 2)))] + [(999, None, 2.0)]
    layers = [("zone", shape, lambda c: c), ("code", shape.where("place % 2 = 0"), F.upper)]
    got = {r["k"]: (r["zone"], r["code"]) for r in regions.tagged(spark.createDataFrame(points, "k int, x double, y double"), "k", "x", "y", layers, size=20).collect()}
    for k, x, y in points:
        held = [i for i, p in enumerate(polygons) if x is not None and sum(shapes.inside(r, x, y) for r in p) % 2]
        first = lambda ids: (names[ids[0]] or "(None)") if ids else "(None)"
        even = first([i for i in held if i % 2 == 0])
        assert got[k] == (first(held), even if even == "(None)" else even.upper())
    assert len({v for v in got.values()}) > 20


# ------------------------------------------------------------------ geometry


def test_geometry_forms(spark):
    square, hole, other = np.array([(0.0, 0), (4, 0), (4, 4), (0, 4)]), np.array([(1.0, 1), (2, 1), (1, 2)]), np.array([(9.0, 9), (10, 9), (9, 10.5)])
    one, two = [[square, hole]], [[square, hole], [other]]
    z = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 4) + np.array([(0, 0, 5), (1, 0, 5), (0, 1, 5), (0, 0, 5)], dtype="<f8").tobytes()
    srid = struct.pack(">BII", 0, 3 | geometry.WITH_SRID, 4326) + struct.pack(">II", 1, 4) + np.array([(0, 0), (1, 0), (0, 1), (0, 0)], dtype=">f8").tobytes()
    cases = [
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 1 2, 1 1))", one), ("multipolygon(((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,1 2,1 1)),((9 9,10 9,9 10.5,9 9)))", two), ("SRID=4326;POLYGON Z((0 0 7, 4 0 7, 4 4 7, 0 4 7, 0 0 7))", [[square]]),
        (geometry.to_bytes(one).hex(), one), (geometry.to_bytes(two, big=True).hex().upper(), two), (z.hex(), [[np.array([(0.0, 0), (1, 0), (0, 1)])]]), (srid.hex(), [[np.array([(0.0, 0), (1, 0), (0, 1)])]]),
        ("POINT (1 2)", None), ("POLYGON ((0 0, 1))", None), ("POLYGON ((a b, c d))", None), ("", None), (None, None), ("0103", None), (geometry.to_bytes(one).hex()[:-2], None), ("zz", None)]
    plain = lambda ps: None if ps is None else [[r.tolist() for r in p] for p in ps]
    read = lambda v: None if v is None else [[[[q["x"], q["y"]] for q in r] for r in p] for p in v]
    got = geometry.decoded(spark.createDataFrame([(i, g) for i, (g, _) in enumerate(cases)], "i int, g string"), "g").orderBy("i").collect()
    assert [read(r["polygons"]) for r in got] == [plain(w) for _, w in cases]
    again = geometry.decoded(geometry.encoded(spark.createDataFrame(got), "polygons"), "wkb", "back").orderBy("i").collect()
    assert [read(r["back"]) for r in again] == [plain(w) for _, w in cases]
    text = geometry.decoded(spark.createDataFrame(got).where("polygons is not null").withColumn("t", geometry.as_text(F.col("polygons"))), "t", "back").orderBy("i").collect()
    assert [read(r["back"]) for r in text] == [plain(w) for _, w in cases if w]


# ------------------------------------------------------------------ condominiums


def test_condo_values_add_up(spark):
    rows = [
        ("A", 1, 10, "billing", 5, 7, 2.0, "x"), ("A", 1, 10, "unit", 100, 200, 0.0, "y"), ("A", 1, 10, "unit", 1, 1, 0.0, "z"), ("A", 1, 11, "unit", 40, 40, 0.0, "z"), ("A", 1, 12, "billing", 0, 0, 6.0, "x"),
        ("A", 2, 10, "unit", 9, 9, 1.0, "x"), ("B", 3, 1, "billing", 0, 0, 0.0, "x"), ("B", 3, 1, "billing", 0, 0, 0.0, "x"), ("B", 3, 1, "unit", 10, 10, 5.0, "w"), ("C", 0, 1, "plain", 3, 4, 1.0, "x"), ("C", 0, 1, None, 3, 4, 1.0, "x")]
    roll = spark.createDataFrame(rows, "boro string, condo int, block int, kind string, land int, total int, area double, tax string")
    lots, lost = condos.to_lots(roll, ["boro", "condo"], "block", "kind", ["land", "total"], "area", "tax")
    got = sorted((r["boro"], r["condo"], r["block"], r["land"], r["total"], r["n_units"], r["tax"]) for r in lots.collect())
    assert got == sorted([("A", 1, 10, 5 + 101 + 10.0, 7 + 201 + 10.0, 2.25, "y"), ("A", 1, 12, 30.0, 30.0, 0.75, "y"), ("B", 3, 1, 5.0, 5.0, 0.5, "w"), ("B", 3, 1, 5.0, 5.0, 0.5, "w"), ("C", 0, 1, 3.0, 4.0, 0.0, "x"), ("C", 0, 1, 3.0, 4.0, 0.0, "x")])
    assert [tuple(r) for r in lost.collect()] == [("A", 2, 9, 9, 1)]
    assert sum(g[3] for g in got) + 9 == sum(r[4] for r in rows)


def test_mixed_groups_equal_plain(spark):
    rng = random.Random(12)
    for _ in range(3):
        units = [(rng.randrange(40), rng.randrange(40)) for _ in range(22)]
        areas = [(rng.randrange(40), rng.randrange(12)) for _ in range(16)]
        parents = [(rng.randrange(40), rng.randrange(6)) for _ in range(20)]
        edges = [(("unit", a), ("unit", b)) for a, b in units]
        edges += [(("area", c), ("unit", u)) for u, c in areas if len({v for v, d in areas if d == c}) > 1]

        def roots(edges):
            root = {n: n for e in edges for n in e}
            while True:
                now = dict(root)
                for a, b in edges:
                    now[a] = now[b] = min(now[a], now[b])
                if now == root:
                    return root
                root = now

        first = roots(edges)
        bare = {n[1] for n, r in first.items() if n[0] == "unit" and not any(m[0] == "area" for m, q in first.items() if q == r)}
        want = roots([*edges, *((("parent", p), ("unit", u)) for u, p in parents if u in bare)])
        frame = lambda rows, names: spark.createDataFrame(rows, names)
        got = components.mixed(frame(units, "u long, v long"), frame(areas, "unit long, area long"), frame(parents, "unit long, parent long")).collect()
        assert {tuple(r["node"]): tuple(r["root"]) for r in got} == want and all(r["kind"] == r["node"]["kind"] for r in got)
