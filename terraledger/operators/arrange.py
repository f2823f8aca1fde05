"""Sides of many shapes cut where they meet, traced to rings: all keys of a record batch at once.

A key's sides meet in one task in any case, where its rings are traced; so they
are cut there too, without a join.  Work is done in blocks of pairs of sides,
which bounds memory whatever the number of sides of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of sides looked at at a time; and sides of a key above which they are put in order along x, so that only those that may meet are paired.
PAIRS, SWEPT = 1 << 18, 64


def snapped(v: np.ndarray, grid: float) -> np.ndarray:
    return np.floor(v / grid + 0.5) * grid


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in columns that are in order."""
    new = np.arange(len(columns[0])) == 0
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def spans(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group begins and ends, in a column that is in order."""
    starts = np.flatnonzero(runs(group))
    return starts, np.append(starts, len(group))[1:]


def _blocks(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every row i and every j from first[i] to last[i] - 1, some ``PAIRS`` at a time."""
    n = np.maximum(last - first, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        m = n[at:to]
        i = np.repeat(np.arange(at, to), m)
        j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + first[i]
        yield i, j
        at = to


def _pairs(group: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sides i < j of one group whose extents meet; ``group`` is in order."""
    low, high = np.minimum(sides[:, :2], sides[:, 2:]), np.maximum(sides[:, :2], sides[:, 2:])
    order, starts, ends = np.arange(len(group)), *spans(group)
    last = np.repeat(ends, ends - starts)
    for a, b in zip(starts, ends, strict=True):
        if b - a > SWEPT:
            order[a:b] = a + np.argsort(low[a:b, 0], kind="stable")
            last[a:b] = a + np.searchsorted(low[order[a:b], 0], high[order[a:b], 0], "right")
    for p, q in _blocks(np.arange(len(group)) + 1, last):
        p, q = order[p], order[q]
        meet = (low[p] <= high[q]).all(1) & (low[q] <= high[p]).all(1)
        yield np.minimum(p, q)[meet], np.maximum(p, q)[meet]


def cut(group: np.ndarray, sides: np.ndarray, grid: float, box: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(side, edge): the pieces of each side (ax, ay, bx, by) between the places where it meets others of its group; an edge begins at its lesser end.

    With ``box`` (least and greatest corner) only places in it count.
    """
    at, xy = [np.arange(len(sides))] * 2, [sides[:, :2], sides[:, 2:]]
    for i, j in _pairs(group, sides):
        a, b, c, d = sides[i, :2], sides[i, 2:], sides[j, :2], sides[j, 2:]
        r, w, o = b - a, d - c, c - a
        turn = r[:, 0] * w[:, 1] - r[:, 1] * w[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (o[:, 0] * w[:, 1] - o[:, 1] * w[:, 0]) / turn, (o[:, 0] * r[:, 1] - o[:, 1] * r[:, 0]) / turn
        cross = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        place = snapped(a[cross] + r[cross] * t[cross, None], grid)
        i_, j_ = i[cross], j[cross]
        if box is not None:
            here = ((place >= box[0]) & (place <= box[1])).all(1)
            place, i_, j_ = place[here], i_[here], j_[here]
        at += [i_, j_]
        xy += [place, place]
        line = (turn == 0) & (o[:, 0] * r[:, 1] == o[:, 1] * r[:, 0])
        for owner, p, e, f in ((i, c, a, b), (i, d, a, b), (j, a, c, d), (j, b, c, d)):
            on = line & (p >= np.minimum(e, f)).all(1) & (p <= np.maximum(e, f)).all(1)
            at.append(owner[on])
            xy.append(p[on])
    side, p = np.concatenate(at), np.concatenate(xy)
    a, r = sides[side, :2], sides[side, 2:] - sides[side, :2]
    along = (p[:, 0] - a[:, 0]) * r[:, 0] + (p[:, 1] - a[:, 1]) * r[:, 1]
    order = np.lexsort((p[:, 1], p[:, 0], along, side))
    side, p = side[order], p[order]
    keep = runs(side, p[:, 0], p[:, 1])
    side, p = side[keep], p[keep]
    go = np.flatnonzero(side[1:] == side[:-1])
    a, b = p[go], p[go + 1]
    swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    return side[go], np.where(swap[:, None], np.hstack([b, a]), np.hstack([a, b]))


def odd(edges: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """One row of each (names..., edge) that is there an odd number of times, in order of these."""
    columns = [*names, *edges.T]
    order = np.lexsort(columns[::-1])
    starts = np.flatnonzero(runs(*[c[order] for c in columns]))
    return order[starts[np.diff(np.append(starts, len(order))) % 2 == 1]]


def steep(edges: np.ndarray) -> np.ndarray:
    """Edges whose ray runs along x."""
    return np.abs(edges[:, 3] - edges[:, 1]) >= np.abs(edges[:, 2] - edges[:, 0])


def past(group: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether the place just past each edge lies inside its group's edges, by the even-odd rule; ``group`` is in order, an edge is there once."""
    upright = steep(edges)
    u = np.where(upright, 0, 1)
    mu, mv = ((np.take_along_axis(edges, k[:, None], 1) + np.take_along_axis(edges, k[:, None] + 2, 1))[:, 0] / 2 for k in (u, 1 - u))
    starts, ends = spans(group)
    size = ends - starts
    hits = np.zeros(len(edges), dtype=np.int64)
    for i, j in _blocks(np.repeat(starts, size), np.repeat(ends, size)):
        ui = u[i]
        au, av, bu, bv = edges[j, ui], edges[j, 1 - ui], edges[j, 2 + ui], edges[j, 3 - ui]
        on = np.flatnonzero(((av > mv[i]) != (bv > mv[i])) & (i != j))
        i, au, av, bu, bv = i[on], au[on], av[on], bu[on], bv[on]
        hits += np.bincount(i[mu[i] < (bu - au) * (mv[i] - av) / (bv - av) + au], minlength=len(edges))
    return hits % 2 == 1


def turned(edges: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Edges directed so that the inside, which lies past them or else before, is on their left."""
    upright = steep(edges)
    rising = np.where(upright, edges[:, 3] > edges[:, 1], edges[:, 2] > edges[:, 0])
    turn = np.where(upright, rising == inside, rising != inside)
    return np.where(turn[:, None], edges[:, [2, 3, 0, 1]], edges)


def walks(group: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, length, vertices): the rings that directed edges make, one after the other; ``group`` is in order.

    At a vertex a walk takes the sharpest left turn, and a walk that comes back
    to one of its vertices is cut there, so rings touch others at most in
    single vertices.  Vertices in line with their neighbours are left out, and
    rings of fewer than three; a ring begins at its least vertex.
    """
    if not len(edges):
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros((0, 2))
    g, p = np.repeat(group, 2), edges.reshape(-1, 2)
    order = np.lexsort((p[:, 1], p[:, 0], g))
    new = runs(g[order], p[order, 0], p[order, 1])
    place = np.empty(len(p), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    ends = p[order[new]]
    a, b = place.reshape(-1, 2).T
    step = ends[b] - ends[a]
    angle = np.arctan2(step[:, 1], step[:, 0])
    order = np.lexsort((angle, a))
    first = np.searchsorted(a[order], np.arange(len(ends) + 1))
    out = first[b + 1] - first[b]
    if not out.all():
        raise ValueError("a border that is not closed")
    after = order[first[b]]
    for e in np.flatnonzero(out > 1):
        ways = order[first[b[e]] : first[b[e] + 1]]
        back = np.arctan2(-step[e, 1], -step[e, 0])
        after[e] = ways[int(np.searchsorted(angle[ways], back - 1e-12)) - 1]  # the next one clockwise; before the first comes the last
    start, following, seen = a.tolist(), after.tolist(), [False] * len(edges)
    rings: list[list[int]] = []
    owner: list[int] = []
    for begun in range(len(seen)):
        if seen[begun]:
            continue
        e, walk, at = begun, [], {}
        while not seen[e]:
            seen[e] = True
            v = start[e]
            if v in at:
                rings.append(walk[at[v] :])
                owner.append(begun)
                for u in rings[-1]:
                    del at[u]
                del walk[len(at) :]
            at[v] = len(walk)
            walk.append(v)
            e = following[e]
        if walk:
            rings.append(walk)
            owner.append(begun)
    length = np.array([len(r) for r in rings])
    ring = np.repeat(np.arange(len(rings)), length)
    xy = ends[np.array([v for r in rings for v in r])]
    begins = np.cumsum(length) - length
    here = np.arange(len(ring)) - begins[ring]
    near = lambda d: xy[begins[ring] + (here + d) % length[ring]]
    before, ahead = xy - near(-1), near(1) - xy
    bend = before[:, 0] * ahead[:, 1] != before[:, 1] * ahead[:, 0]
    bend &= np.bincount(ring[bend], minlength=len(rings))[ring] > 2
    ring, xy = ring[bend], xy[bend]
    if not len(ring):
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros((0, 2))
    left = np.flatnonzero(runs(ring))
    length = np.diff(np.append(left, len(ring)))
    least = np.lexsort((xy[:, 1], xy[:, 0], ring))[left] - left
    number = np.repeat(np.arange(len(left)), length)
    xy = xy[left[number] + (np.arange(len(ring)) - left[number] + least[number]) % length[number]]
    return group[np.array(owner)][ring[left]], length, xy


def areas(length: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Shoelace areas of rings that follow each other, over zero where a ring runs counter-clockwise."""
    if not len(length):
        return np.zeros(0)
    first = np.cumsum(length) - length
    number = np.repeat(np.arange(len(length)), length)
    p = xy - xy[first[number]]
    q = p[first[number] + (np.arange(len(xy)) - first[number] + 1) % length[number]]
    return np.add.reduceat(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], first) / 2
