import random

import pytest

from lumenframe.operators import contrast
from tests.test_extremal import EIGHT, parts


def test_two_spots_give_two_boxes(spark):
    mask = {(x, y) for x in range(3) for y in range(2)} | {(7, 7), (8, 8), (8, 9)} | {(0, 9)}
    rnd = random.Random(4)
    noise = {(x, y) for x in range(14) for y in range(14) if rnd.random() < 0.3}
    df = spark.createDataFrame([(i, x, y) for i, m in enumerate((mask, noise)) for x, y in m] + [(0, 0, 0)], "img int, x int, y int")
    got = {}
    for r in contrast.spots(df).collect():
        got.setdefault(r.img, []).append((r.spot, r.n, r.x1, r.y1, r.x2, r.y2))
    assert sorted(got[0]) == [(1, 6, 0, 0, 2, 1), (2, 3, 7, 7, 8, 9), (3, 1, 0, 9, 0, 9)]
    want = sorted(parts(noise, EIGHT), key=lambda c: (-len(c), min((y, x) for x, y in c)))
    assert sorted(got[1]) == [(k, len(c), min(x for x, _ in c), min(y for _, y in c), max(x for x, _ in c), max(y for _, y in c)) for k, c in enumerate(want, 1)]


def test_a_coloured_disc_stands_out(spark):
    """A few rare colours are folded into near ones; the disc is the most salient colour and segment, the ground at the border is background."""
    rnd = random.Random(6)
    rows = []
    for x in range(16):
        for y in range(16):
            disc = (x - 8) ** 2 + (y - 8) ** 2 <= 16
            r, g, b = (220, 30, 30) if disc else (90, 95, 100)
            rows.append((1, x, y, *(min(255, max(0, c + rnd.randrange(-3, 4))) for c in (r, g, b)), int(disc)))
    rows += [(2, x, y, 9, 9, 9, 0) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int, segment int")
    c = contrast.quantised(df, few=2)
    s = {(r.img, r.colour): r.saliency for r in contrast.colour_contrast(contrast.palette(c)).collect()}
    of_disc = {(r.img, r.colour) for r in c.where("segment = 1").collect()}
    assert min(s[k] for k in of_disc) > max(v for k, v in s.items() if k not in of_disc) and s[2, 1] == 0
    seg = {(r.img, r.segment): r.saliency for r in contrast.segment_contrast(c, (16, 16)).collect()}
    assert seg == {(1, 1): 1.0, (1, 0): 0.0, (2, 0): 0.0}
    assert {(r.img, r.segment) for r in contrast.border_segments(df.where("img = 1"), (16, 16), share=0.07).collect()} == {(1, 0)}


def test_rare_colours_go_to_near_ones(spark):
    rows = [(1, i, 0, 200, 10, 10) for i in range(96)] + [(1, i, 1, 10, 200, 10) for i in range(60)] + [(1, 0, 2, 190, 40, 10), (1, 1, 2, 12, 170, 30)]
    got = {(r.x, r.y): r.colour for r in contrast.quantised(spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int"), few=1).collect()}
    assert got[0, 2] == got[5, 0] == 1 and got[1, 2] == got[5, 1] == 2
    assert sorted(got.values()).count(1) == 97 and len(got) == pytest.approx(158)
