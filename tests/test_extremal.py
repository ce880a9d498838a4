import random

import numpy as np
import pytest

from lumenframe.operators import extremal


def grid_of(seed, w=9, h=8, levels=12, missing=0.08):
    rnd = random.Random(seed)
    v = {(x, y): rnd.randrange(levels) for x in range(w) for y in range(h) if rnd.random() >= missing}
    for _ in range(4):  # flat patches, with holes
        cx, cy, level = rnd.randrange(w), rnd.randrange(h), rnd.randrange(levels)
        for x, y in list(v):
            if 0 < max(abs(x - cx), abs(y - cy)) <= 2:
                v[x, y] = level
    return v


def parts(cells, steps):
    """Connected sets of cells."""
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            x, y = todo.pop()
            for dx, dy in steps:
                if (x + dx, y + dy) in left:
                    left.remove((x + dx, y + dy))
                    own.add((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
        out.append(frozenset(own))
    return out


FOUR = [(1, 0), (0, 1), (-1, 0), (0, -1)]
EIGHT = [*FOUR, (1, 1), (-1, -1), (1, -1), (-1, 1)]


def plain(v, steps, delta, least, most, most_variation):
    """{component: (level, variation, stable)} by thresholding at every level, and parents."""
    nodes = {}
    for t in sorted(set(v.values())):
        for c in parts([p for p, g in v.items() if g <= t], steps):
            if max(v[p] for p in c) == t:
                nodes[c] = t
    parent = {c: min((d for d in nodes if c < d), key=len, default=None) for c in nodes}
    q = {c: (max(len(d) for d in nodes if c <= d and nodes[d] <= nodes[c] + delta) - len(c)) / len(c) for c in nodes}
    out = {}
    for c, t in nodes.items():
        able = (parent[c] is None or q[c] <= q[parent[c]]) and int(least * len(v)) <= len(c) <= int(most * len(v)) and q[c] <= most_variation
        below = [d for d in nodes if parent[d] == c]
        out[c] = (t, q[c], able and (not below or any(q[c] < q[d] for d in below)))
    return out, parent


def plain_diverse(nodes, parent, least):
    kept = {c: s for c, (_, _, s) in nodes.items()}
    for c in sorted(nodes, key=len, reverse=True):
        if not kept[c]:
            continue
        up = c
        while parent[up] is not None and len(parent[up]) < int(len(c) / (1 - least) + 0.5):
            up = parent[up]
            if kept[up] and nodes[up][1] <= nodes[c][1]:
                kept[c] = False
        small = int(len(c) * (1 - least) + 0.5)
        if any(d < c and len(d) > small and nodes[d][2] and nodes[d][1] < nodes[c][1] for d in nodes):
            kept[c] = False
    return {c for c, k in kept.items() if k}


@pytest.mark.parametrize("eight", [False, True])
def test_components_and_regions_equal_thresholding(spark, eight):
    grids = {i: grid_of(i) for i in range(6)} | {6: {(0, 0): 5}, 7: {(x, y): 3 for x in range(4) for y in range(4)}}
    df = spark.createDataFrame([(i, x, y, g, "z") for i, v in grids.items() for (x, y), g in v.items()] + [(8, 0, 0, None, "z")], "img int, x int, y int, v int, level string")
    args = dict(delta=2, least=0.02, most=0.6, most_variation=0.9, eight=eight)
    nodes = extremal.component_nodes(df, "img", "v", **args).collect()
    regions = {}
    for r in extremal.stable_regions(df, "img", "v", least_diversity=0.3, **args).collect():
        regions.setdefault((r.img, r.region), set()).add((r.x, r.y))
    for i, v in grids.items():
        want, parent = plain(v, EIGHT if eight else FOUR, 2, 0.02, 0.6, 0.9)
        seed = lambda c: min((y, x) for x, y in c)
        assert sorted((r.level, (r.seed_y, r.seed_x), r.area, round(r.variation, 9), r.stable) for r in nodes if r.img == i) == sorted((t, seed(c), len(c), round(q, 9), s) for c, (t, q, s) in want.items())
        assert {frozenset(p) for (k, _), p in regions.items() if k == i} == plain_diverse(want, parent, 0.3)
    assert any(len(p) > 3 for p in regions.values())


def test_features_equal_plain_ones(spark):
    grids = {i: grid_of(20 + i, 11, 10, 3) for i in range(5)}
    comps = {(i, k): c for i, v in grids.items() for k, c in enumerate(parts([p for p, g in v.items() if g < 2], FOUR))}
    members = spark.createDataFrame([(i, k, x, y) for (i, k), c in comps.items() for x, y in c], "img int, region int, x int, y int")
    pixels = spark.createDataFrame([(i, x, y, g) for i, v in grids.items() for (x, y), g in v.items()], "img int, x int, y int, v int")
    got = {(r.img, r.region): r for r in extremal.region_features(members, ["img", "region"], pixels, "img", "v").collect()}
    assert set(got) == set(comps)
    for k, c in comps.items():
        around = [(x, y) for x in range(-1, 13) for y in range(-1, 13)]
        outside = [p for p in around if p not in c]
        d = [min(abs(x - a) + abs(y - b) for a, b in outside) for x, y in c]
        xy = np.array(sorted(c), dtype=float)
        r = got[k]
        assert (r.area, r.x1, r.y1, r.x2, r.y2) == (len(c), *xy.min(0), *(xy.max(0) + 1))
        assert (r.perimeter, r.holes) == (d.count(1), len(parts(outside, EIGHT)) - 1)
        cov = np.cov(xy.T, bias=True)
        assert (r.cx, r.cy, r.m20, r.m11, r.m02) == pytest.approx((*xy.mean(0), cov[0, 0], cov[0, 1], cov[1, 1]), abs=1e-9)
        grey = [grids[k[0]][p] for p in c]
        assert (r.stroke_mean, r.stroke_sd, r.grey_mean, r.grey_sd) == pytest.approx((np.mean(d), np.std(d), np.mean(grey), np.std(grey)), abs=1e-9)
