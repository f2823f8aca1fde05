"""Shape operators against plain versions on random input."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraledger.functions import rings as R
from terraledger.operators import borders, hexgrid, hulls, mesh, raster, repair, shapes, simplify


def polygon_frame(spark, polygons):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p]) for k, p in polygons]
    return spark.createDataFrame(rows, f"k long, rings {shapes.RINGS}")


def as_polygons(rows):
    return [[np.array([(p["x"], p["y"]) for p in ring]) for ring in r["rings"]] for r in rows]


def area(polygon):
    return abs(shapes.signed_area(polygon[0])) - sum(abs(shapes.signed_area(h)) for h in polygon[1:])


def holds(polygon, x, y):
    return sum(shapes.inside(r, x, y) for r in polygon) % 2 == 1


# ------------------------------------------------------------------ borders


def pixel_edges(mask):
    out = []
    h, w = mask.shape
    for y, x in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True):
        sides = [(y == 0 or not mask[y - 1, x], (x, y, x + 1, y)), (x == w - 1 or not mask[y, x + 1], (x + 1, y, x + 1, y + 1))]
        sides += [(y == h - 1 or not mask[y + 1, x], (x + 1, y + 1, x, y + 1)), (x == 0 or not mask[y, x - 1], (x, y + 1, x, y))]
        out += [e for free, e in sides if free]
    return np.array(out, dtype=float)


def test_traced_pixels():
    rng = np.random.default_rng(1)
    for _ in range(300):
        mask = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.55
        if mask.any():
            found = borders.trace(pixel_edges(mask))
            assert sum(area(p) for p in found) == mask.sum()
            for y, x in itertools.product(*map(range, mask.shape)):
                assert sum(holds(p, x + 0.5, y + 0.5) for p in found) == mask[y, x]
            assert all(len({tuple(v) for v in r}) == len(r) for p in found for r in p)


def test_outlines_of_boxes(spark):
    rng = np.random.default_rng(2)
    rows, masks = [], {}
    for k in range(30):
        mask = masks[k] = rng.random((6, 7)) < 0.6
        rows += [(k, int(x), int(x) + 1, int(y), int(y) + 1) for y, x in zip(*np.nonzero(mask), strict=True)]
    got = borders.traced(borders.outlines(spark.createDataFrame(rows, "k int, x0 int, x1 int, y0 int, y1 int"), ["k"]), ["k"]).collect()
    for k, mask in masks.items():
        mine = [r for r in got if r["k"] == k]
        want = borders.trace(pixel_edges(mask)) if mask.any() else []
        assert sorted(r["part"] for r in mine) == list(range(len(mine)))
        assert sorted(str([r.tolist() for r in p]) for p in as_polygons(mine)) == sorted(str([r.tolist() for r in p]) for p in want)


def test_an_open_border_is_an_error():
    with pytest.raises(ValueError, match="not closed"):
        borders.trace(np.array([(0, 0, 1, 0), (1, 0, 1, 1)], dtype=float))


# ------------------------------------------------------------------ simplification


def quilt(rng, n):
    """Cells of a shaken lattice whose sides are random walks that neighbours share; two are one ring in another."""
    node = {(i, j): np.array([10 * i, 10 * j]) + rng.uniform(-2, 2, 2) for i in range(n + 1) for j in range(n + 1)}
    side = {}
    for (i, j), a in node.items():
        for b in ((i + 1, j), (i, j + 1)):
            if b in node:
                t = np.linspace(0, 1, 9)[1:-1, None]
                side[(i, j), b] = a + (node[b] - a) * t + rng.normal(0, 0.4, (7, 2))
    out = []
    for i, j in itertools.product(range(n), repeat=2):
        p = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
        ring = np.vstack([node[p[0]], side[p[0], p[1]], node[p[1]], side[p[1], p[2]], node[p[2]], side[p[3], p[2]][::-1], node[p[3]], side[p[0], p[3]][::-1]])
        out.append((i * n + j, [ring[::-1] if (i + j) % 2 else ring]))
    island = np.array([(3.0, 3), (5, 3.1), (7, 3), (7.1, 5), (7, 7), (5, 7.05), (3, 7)])
    out[0] = (0, [*out[0][1], island])
    return [*out, (n * n, [np.roll(island, 3, axis=0)[::-1]])]


def distance(p, a, b):
    d = b - a
    t = np.clip((p - a) @ d / (d @ d), 0, 1) if d.any() else 0
    return float(np.hypot(*(p - a - t * d)))


@pytest.mark.parametrize("tolerance", [0.3, 1.0])
def test_simplified_borders_stay_common(spark, tolerance):
    polygons = quilt(np.random.default_rng(3), 5)
    got = {r["k"]: p for r, p in ((r, as_polygons([r])[0]) for r in simplify.simplified(polygon_frame(spark, polygons), "k", "rings", tolerance).collect())}
    assert len(got) == len(polygons) and sum(len(r) for p in got.values() for r in p) < sum(len(r) for _, p in polygons for r in p) / 1.3
    sides = {}
    for p in got.values():
        for r in p:
            for a, b in zip(r.tolist(), np.roll(r, -1, axis=0).tolist(), strict=True):
                sides[tuple(sorted((tuple(a), tuple(b))))] = sides.get(tuple(sorted((tuple(a), tuple(b)))), 0) + 1
    inner = {s for s, n in sides.items() if n == 2}
    assert set(sides.values()) == {1, 2} and len(inner) > len(sides) / 2
    for k, before in polygons:  # what was left out lies near what stayed
        for old, new in zip(before, got[k], strict=True):
            ends = list(zip(new, np.roll(new, -1, axis=0), strict=True))
            assert {tuple(v) for v in new} <= {tuple(v) for v in old}
            assert max(min(distance(p, a, b) for a, b in ends) for p in old) <= tolerance + 1e-9
    outline = lambda ps: sum(area(p) for p in ps)
    rim = 4 * 5 * 10 * tolerance
    assert abs(outline(got.values()) - outline(p for _, p in polygons)) < rim


def test_simplify_degenerate(spark):
    thin = [(0, 0), (10, 0.01), (20, 0), (10, -0.01)]
    hole = [(1, 1), (1.1, 1), (1.1, 1.001), (1, 1.001)]
    box = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]
    got = {r["k"]: r["rings"] for r in simplify.simplified(polygon_frame(spark, [(1, [thin]), (2, [box, hole])]), "k", "rings", 0.5).collect()}
    assert len(got[1][0]) == 4 and len(got[2]) == 1 and len(got[2][0]) == 4
    assert simplify.simplified(polygon_frame(spark, []), "k", "rings", 0.5).count() == 0


# ------------------------------------------------------------------ hulls


def plain_hull(p):
    p = np.unique(p, axis=0)
    out = set()
    for i, j in itertools.permutations(range(len(p)), 2):
        d = p[j] - p[i]
        c = d[0] * (p[:, 1] - p[i, 1]) - d[1] * (p[:, 0] - p[i, 0])
        if (c >= 0).all():
            on = p[c == 0]
            out |= {tuple(on[(on @ d).argmin()]), tuple(on[(on @ d).argmax()])}
    return out or {tuple(p[0])}


def plain_sides(h):
    best = []
    for i in range(len(h)):
        u = (h[(i + 1) % len(h)] - h[i]) / np.hypot(*(h[(i + 1) % len(h)] - h[i]))
        a, b = np.ptp(h @ u), np.ptp(h @ [-u[1], u[0]])
        best.append((a * b, *sorted((a, b))))
    return min(x[1:] for x in best if x[0] <= min(best)[0] * (1 + 1e-9))


def test_hulls_equal_plain(spark):
    rng = np.random.default_rng(5)
    groups = {k: rng.integers(0, rng.integers(2, 30), (rng.integers(1, 60), 2)).astype(float) for k in range(80)}
    rows = [(k if k else None, *map(float, p)) for k, ps in groups.items() for p in ps] + [(1, None, 2.0), (1, float("nan"), 2.0)]
    got = {r["k"] or 0: r for r in hulls.hulls(spark.createDataFrame(rows, "k int, x double, y double").repartition(5), ["k"], "x", "y", 8.0).collect()}
    assert set(got) == set(groups)
    for k, ps in groups.items():
        corners = np.array([(c["x"], c["y"]) for c in got[k]["corners"]])
        assert {tuple(c) for c in corners} == plain_hull(ps)
        foot = shapes.signed_area(np.array([(c["x"], c["y"]) for c in got[k]["footprint"]]))
        if len(corners) < 3:
            assert got[k]["short"] is None and got[k]["pad"] == 4
            length = np.hypot(*(corners[-1] - corners[0]))
            assert abs(foot - (8 * length + 16 * np.pi)) < 0.2
        else:
            short, pad = plain_sides(corners)[0], got[k]["pad"]
            assert got[k]["short"] == pytest.approx(short) and pad == pytest.approx(max(0, (8 - short) / 2))
            rim = np.hypot(*(np.roll(corners, -1, axis=0) - corners).T).sum()
            assert abs(foot - (shapes.signed_area(corners) + rim * pad + np.pi * pad * pad)) < 0.2


# ------------------------------------------------------------------ hexagons


def random_polygons(rng, n):
    """Stars with a hole."""
    out = []
    for k in range(n):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 9))
        star = np.column_stack([np.cos(turn), np.sin(turn)])
        at = rng.uniform(-50, 50, 2)
        out.append((k, [at + star * rng.uniform(20, 60, 9)[:, None], at + star[::-1] * 5] if (np.diff(turn) < 2).all() and turn[0] + 2 * np.pi - turn[-1] < 2 else [at + star * 20]))
    return out


def test_hex_pieces_add_up(spark):
    polygons = random_polygons(np.random.default_rng(7), 25)
    got = hexgrid.pieces(polygon_frame(spark, polygons), "rings", 11.0).select("k", "hq", "hr", "piece").collect()
    per = {}
    for r in got:
        per[r["k"]] = per.get(r["k"], 0) + r["piece"]
        assert 0 < r["piece"] <= hexgrid.area(11.0) + 1e-6
    assert {k: round(v, 6) for k, v in per.items()} == {k: round(area(p), 6) for k, p in polygons}


def test_pieces_far_from_the_origin(spark):
    """Two million rows of hexagons away the pieces are the same, without slivers beside them."""
    near, up = [(k, [np.round(r) for r in p]) for k, p in random_polygons(np.random.default_rng(7), 10)], 2000000
    far = [(k, [r + np.array([0.0, 1.5 * 25.0 * up]) for r in p]) for k, p in near]
    size = lambda polygons, up: {(r["k"], r["hq"] + up // 2, r["hr"] - up): r["piece"] for r in hexgrid.pieces(polygon_frame(spark, polygons), "rings", 25.0).where("piece > 1e-7").collect()}
    want, got = size(near, 0), size(far, up)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_polyfill_holds_centres(spark):
    polygons = random_polygons(np.random.default_rng(8), 25)
    got = {(r["k"], r["hq"], r["hr"]) for r in hexgrid.polyfill(polygon_frame(spark, polygons), "rings", 4.0).collect()}
    reach = range(-70, 71)
    want = {(k, q, r) for k, p in polygons for q in reach for r in reach if holds(p, (q + r / 2) * 3**0.5 * 4, r * 6.0)}
    assert got == want


def test_points_lie_inside(spark):
    polygons = random_polygons(np.random.default_rng(9), 40)
    for r in polygon_frame(spark, polygons).select("k", R.inside_point(F.col("rings")).alias("p")).collect():
        assert holds(polygons[r["k"]][1], r["p"]["x"], r["p"]["y"])


# ------------------------------------------------------------------ repair


def test_repair_keeps_the_even_odd_inside(spark):
    rng = np.random.default_rng(11)
    polygons = [(k, [rng.integers(0, 13, (rng.integers(3, 12), 2)).astype(float) for _ in range(rng.integers(1, 4))]) for k in range(120)]
    got = repair.valid(polygon_frame(spark, polygons), "k", grid=1e-6).collect()
    probes = rng.uniform(-1, 14, (60, 2))
    for k, p in polygons:
        mine = as_polygons(r for r in got if r["k"] == k)
        for x, y in probes:
            assert sum(holds(m, x, y) for m in mine) == holds(p, x, y)
        for m in mine:
            assert shapes.signed_area(m[0]) > 0 and all(shapes.signed_area(h) < 0 for h in m[1:])
            assert all(len({tuple(v) for v in r}) == len(r) for r in m)


def test_repair_of_nothing(spark):
    spike = [(0, 0), (5, 0), (0, 0)]
    bow = [(0, 0), (4, 4), (4, 0), (0, 4)]
    got = repair.valid(polygon_frame(spark, [(1, [spike]), (2, []), (3, [bow]), (4, [bow, bow])]), "k").collect()
    assert sorted((r["k"], area(as_polygons([r])[0])) for r in got) == [(3, 4.0), (3, 4.0)]


# ------------------------------------------------------------------ rasters


def plain_opened(mask, radius):
    padded = np.pad(mask, 2 * radius)
    inner = np.ones_like(padded)
    for dy, dx in raster.disk(radius):
        inner &= np.roll(padded, (-dy, -dx), (0, 1))
    out = np.zeros_like(padded)
    for dy, dx in raster.disk(radius):
        out |= np.roll(inner, (dy, dx), (0, 1))
    return out[2 * radius : -2 * radius, 2 * radius : -2 * radius]


def plain_labels(mask):
    label, n = np.zeros(mask.shape, dtype=int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not label[y, x]:
            n += 1
            todo = [(y, x)]
            label[y, x] = n
            while todo:
                a, b = todo.pop()
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not label[c, d]:
                        label[c, d] = n
                        todo.append((c, d))
    return label


def blobs(seed, shape, n):
    rng = np.random.default_rng(seed)
    mask = np.zeros(shape, dtype=bool)
    y, x = np.ogrid[: shape[0], : shape[1]]
    for _ in range(n):
        r = rng.integers(2, 14)
        mask |= (y - rng.integers(0, shape[0])) ** 2 + (x - rng.integers(0, shape[1])) ** 2 <= r * r
    return mask & (rng.random(shape) > 0.004)


def pixel_frame(spark, mask, at=0):
    return spark.createDataFrame([(int(y) + at, int(x) + at) for y, x in zip(*np.nonzero(mask), strict=True)], "y long, x long")


@pytest.mark.parametrize("side", [16, 32])
def test_raster_equals_the_whole_image(spark, side):
    mask, at = blobs(13, (90, 110), 26), -40  # tiles on both sides of zero
    t = raster.tiles(pixel_frame(spark, mask, at), side=side)
    assert {(r["y"] - at, r["x"] - at) for r in raster.pixels(t, side).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True))
    found = {(r["y"] - at, r["x"] - at) for r in raster.pixels(raster.opened(t, 3, side), side).collect()}
    want = plain_opened(mask, 3)
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))
    smooth = {(r["y"] - at, r["x"] - at) for r in raster.pixels(raster.smoothed(t, 5, side), side).collect()}
    padded = np.pad(mask, 2).astype(int)
    votes = sum(padded[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(5) for j in range(5))
    assert {p for p in smooth if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1]} == set(zip(*map(np.ndarray.tolist, np.nonzero(votes * 2 > 25)), strict=True))


@pytest.mark.parametrize("side", [16, 32])
def test_regions_over_seams(spark, side):
    mask = blobs(17, (90, 110), 22)
    want = plain_labels(mask)
    runs = raster.labelled(raster.tiles(pixel_frame(spark, mask), side=side), side).collect()
    mine = np.zeros_like(want, dtype=np.int64)
    for r in runs:
        mine[r["y"], r["x0"] : r["x1"]] = r["label"] + 1
    pairs = set(zip(want.ravel().tolist(), mine.ravel().tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == want.max() + 1
    got = raster.regions(spark.createDataFrame([tuple(r) for r in runs], "label long, y long, x0 long, x1 long")).collect()
    assert len(got) == want.max() and all(area(p) == r["pixels"] for r, p in zip(got, as_polygons(got), strict=True))


def test_raster_of_nothing(spark):
    t = raster.tiles(spark.createDataFrame([], "y long, x long"))
    assert raster.opened(t, 3).count() == 0 and raster.labelled(t).count() == 0


# ------------------------------------------------------------------ meshes


def test_heightfield_is_closed(spark):
    rng = np.random.default_rng(19)
    for n, top in ((1, 2), (4, 3), (9, 5)):
        h = rng.integers(0, top, (n, n))
        h[0, 0] = 1
        cells = spark.createDataFrame([(x - 2, y - 2, float(h[x, y])) for x in range(n) for y in range(n)], "x int, y int, h double")
        got = mesh.closed(mesh.heightfield(cells, "x", "y", "h")).first()
        assert (got["cells"], got["open_edges"], got["volume"]) == ((h > 0).sum(), 0, h.sum())
    flat = spark.createDataFrame([(x, y, 2.0) for x in range(3) for y in range(3)], "x int, y int, h double")
    assert mesh.heightfield(flat, "x", "y", "h").count() == 9 * 4 + 12 * 2  # tops and bottoms, and no wall inside


def test_repair_moves_no_rows(spark):
    """Sides are cut in the batch in which their polygon lies: no exchange, whatever the number of polygons."""
    v = repair.valid(polygon_frame(spark, [(1, [[(0, 0), (4, 4), (4, 0), (0, 4)]])]), "k")
    assert "Exchange" not in v._jdf.queryExecution().executedPlan().toString()


def test_repair_of_rings_of_many_sides(spark):
    """More sides than are paired without an order along x."""
    rng = np.random.default_rng(12)
    polygons = [(k, [rng.integers(0, 60, (90, 2)).astype(float)]) for k in range(3)]
    got = repair.valid(polygon_frame(spark, polygons), "k", grid=1e-6).collect()
    for k, p in polygons:
        mine = as_polygons(r for r in got if r["k"] == k)
        for x, y in rng.uniform(-1, 61, (80, 2)):
            assert sum(holds(m, x, y) for m in mine) == holds(p, x, y)
