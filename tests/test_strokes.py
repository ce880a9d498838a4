import math
import random

import pytest

from lumenframe.operators import extremal, regions, strokes
from tests.test_extremal import EIGHT, FOUR, grid_of, parts


def table(spark, grids):
    return spark.createDataFrame([(i, x, y, g) for i, v in grids.items() for (x, y), g in v.items()], "img int, x int, y int, v int")


def plain_edges(v, low, high):
    g = {}
    for x, y in v:
        at = lambda a, b: v.get((x + a, y + b), v[x, y])  # noqa: B023, E731
        gx = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
        gy = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
        if gx or gy:
            g[x, y] = (abs(gx) + abs(gy), strokes.DIRECTIONS[math.floor(math.degrees(math.atan2(gy, gx)) / 45 + 0.5) % 8])
    ridge = {p: m for p, (m, (dx, dy)) in g.items() if m >= low and all(g.get((p[0] + s * dx, p[1] + s * dy), (0,))[0] <= m for s in (1, -1))}
    kept = {p for c in parts(ridge, EIGHT) if any(ridge[p] >= high for p in c) for p in c}
    return {p: g[p][1] for p in kept}


def plain_widths(c):
    around = [(x, y) for x in range(-2, 40) for y in range(-2, 40) if (x, y) not in c]
    d = {(x, y): min(abs(x - a) + abs(y - b) for a, b in around) for x, y in c}
    w = {}
    for p in sorted(c, key=lambda p: -d[p]):
        w[p] = max([d[p], *(w[q] for dx, dy in EIGHT if (q := (p[0] + dx, p[1] + dy)) in c and d[q] > d[p])])
    return d, w


def test_edges_equal_plain_ones(spark):
    grids = {i: grid_of(40 + i, 12, 11, 200, 0.03) for i in range(4)}
    got = {(r.img, r.x, r.y): strokes.DIRECTIONS[r.direction] for r in strokes.edges(table(spark, grids), "v", 150, 500).collect()}
    assert got == {(i, *p): s for i, v in grids.items() for p, s in plain_edges(v, 150, 500).items()} and len(got) > 30


def test_widths_are_climbed_to(spark):
    """A thick bar with a thin one at its end: pixels of the thick one have its width, those of the thin one theirs."""
    bars = {(x, y) for x in range(12) for y in range(7)} | {(x, 3) for x in range(12, 25)}
    rnd = random.Random(3)
    noise = {(x, y) for x in range(16) for y in range(16) if rnd.random() < 0.8}
    df = spark.createDataFrame([(i, x, y) for i, c in enumerate((bars, noise)) for x, y in c], "img int, x int, y int")
    got = {(r.img, r.x, r.y): (r.d, r.w) for r in strokes.stroke_widths(df, ["img"]).collect()}
    for i, c in enumerate((bars, noise)):
        d, w = plain_widths(c)
        assert {p: got[i, *p] for p in c} == {p: (d[p], w[p]) for p in c}
    assert got[0, 6, 0] == (1, 4) and got[0, 20, 3] == (1, 1)
    assert strokes.stroke_widths(df.where("img > 5"), ["img"]).count() == 0


def test_chain_equals_plain_steps(spark):
    grids = {i: grid_of(60 + i, 14, 13, 60, 0.02) for i in range(4)}
    df = table(spark, grids)
    stable = dict(delta=3, least=0.02, most=0.9, most_variation=1.5, least_diversity=0.2)
    got = {r.img: [] for r in df.select("img").distinct().collect()}
    for r in strokes.stroke_components(df, "v", low=40, high=120, area=(3, 150), solidity=0.3, most_cv=0.6, **stable).collect():
        got[r.img].append((r.n, r.x1, r.y1, r.x2, r.y2, round(r.stroke_mean, 6), round(r.stroke_sd, 6)))
    mask = {}
    for r in extremal.stable_regions(df, "img", "v", **stable).collect():
        mask.setdefault(r.img, set()).add((r.x, r.y))
    n = 0
    for i, v in grids.items():
        e = {p: s for p, s in plain_edges(v, 40, 120).items() if p in mask.get(i, ())}
        left = mask.get(i, set()) - set(e) - {(x + s[0], y + s[1]) for (x, y), s in e.items()}
        want = []
        for c in parts(left, FOUR):
            xs, ys = [p[0] for p in c], [p[1] for p in c]
            sxx, syy, sxy = (sum(a * b for a, b in zip(p, q, strict=True)) / len(c) - sum(p) * sum(q) / len(c) ** 2 for p, q in ((xs, xs), (ys, ys), (xs, ys)))
            big, room = (sxx + syy) / 2, math.sqrt(4 * sxy * sxy + (sxx - syy) ** 2) / 2
            hull = regions.hull_area(list(c))
            if not 3 <= len(c) <= 150 or big + room <= 1e-12 or not 0.1 <= math.sqrt(max(1 - (big - room) / (big + room), 0)) <= 0.995 or not hull or len(c) / hull < 0.3:
                continue
            w = list(plain_widths(set(c))[1].values())
            mean = sum(w) / len(w)
            sd = math.sqrt(max(sum(k * k for k in w) / len(w) - mean * mean, 0))
            if sd <= 0.6 * mean:
                want.append((len(c), min(xs), min(ys), max(xs) + 1, max(ys) + 1, round(mean, 6), round(sd, 6)))
        assert len(got[i]) == len(want) and all(a == pytest.approx(b, abs=2e-6) for a, b in zip(sorted(got[i]), sorted(want), strict=True))
        n += len(want)
    assert n > 2


def test_rectangles_stay_inside(spark):
    c = spark.createDataFrame([(1, 5, 3, 2, 9, 8), (1, 5, 20, 20, 28, 29)], "img int, n long, x1 int, y1 int, x2 int, y2 int")
    s = spark.createDataFrame([(1, 30, 31)], "img int, width int, height int")
    assert list(strokes.text_rectangles(c, s).first()) == [1, 2, 0, 0, 30, 31]
