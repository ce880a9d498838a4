"""Queries over whole tables, held against brute force on a small table of line items."""

import datetime
import math
import random

import pytest

import lumenframe.queries_regions  # noqa: F401
from lumenframe.queries import QUERIES

LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def items():
    """Order, part and supplier of each line; parts far above 40, one with more lines than any cap."""
    rnd = random.Random(11)
    parts = [3] * 12 + [41] * 20 + [907] * 25 + [5000] * 9 + [123_456_789] * 6
    rows = [(10 * i + rnd.randrange(10), p, rnd.randrange(1, 50), rnd.randrange(1, 8), float(rnd.randrange(1, 51)), rnd.randrange(1, 100_000) / 100) for i, p in enumerate(parts)]
    return [*rows, (rows[5][0], 907, 2, 3, 4.0, 5.55), (rows[-1][0], 5000, 2, 3, 4.0, 5.55)]  # orders of two parts


@pytest.fixture(scope="module")
def small_dir(spark, items, tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    day = datetime.datetime(1995, 1, 1)
    spark.createDataFrame([(*r, 0.0, 0.0, "N", "O", day) for r in items], LINEITEM).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def boxes_by_image(items):
    """image: its boxes (label, score, x1, y1, x2, y2) in order."""
    out = {}
    for o, p, s, line, q, price in sorted(items):
        x, y = o % 400, (o * 7 + s) % 300
        out.setdefault(p, []).append((line % 5, round(price * 100) % 1000 / 1000, x, y, int(x + 20 + q * 4), int(y + 20 + q * 3)))
    return out


def py_segments(v, k, least):
    """Segments of pixels {(x, y): v}: sets merged over edges by rising difference."""
    order = sorted(v, key=lambda p: (p[1], p[0]))
    at = {p: i for i, p in enumerate(order)}
    edges = sorted((abs(v[p] - v[q]), at[p], at[q]) for p in order for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in at)
    of, inner = {i: frozenset([i]) for i in at.values()}, {frozenset([i]): 0.0 for i in at.values()}

    def merge(a, b, w):
        both = a | b
        inner[both] = w
        of.update(dict.fromkeys(both, both))

    for w, i, j in edges:
        a, b = of[i], of[j]
        if a != b and all(w <= inner[s] + k / len(s) for s in (a, b)):
            merge(a, b, w)
    for w, i, j in edges:
        a, b = of[i], of[j]
        if a != b and min(len(a), len(b)) < least:
            merge(a, b, w)
    return {(x, y, min(of[i])) for (x, y), i in at.items()}


def test_graph_segments_of_all_images(spark, small_dir, items):
    got = {}
    for r in QUERIES["graph_segments"](spark, small_dir).collect():
        got.setdefault(r.image_id, set()).add((r.x, r.y, r.segment))
    want = {}
    for image, rows in boxes_by_image(items).items():
        cells = {}
        for _, score, x, y, *_ in rows:
            cells.setdefault((x // 40, y // 40), []).append(score * 255)
        want[image] = py_segments({p: sum(v) / len(v) for p, v in cells.items()}, 60.0, 2)
    assert got == want
    assert any(len({s for *_, s in v}) < len(v) for v in want.values())


def test_connected_components_of_all_rows(spark, small_dir, items):
    want = {}
    for o, p, *_ in items:
        a, b = 2 * o, 2 * p + 1
        both = want.get(a, {a}) | want.get(b, {b})
        want.update(dict.fromkeys(both, both))
    rows = QUERIES["connected_components"](spark, small_dir).collect()
    assert {r.node: r.component for r in rows} == {n: min(c) for n, c in want.items()}
    assert len(rows) == len(want) and len(set(map(frozenset, want.values()))) == 3


def py_merges(points):
    """Heights of average linkage from the mean of all distances between two clusters."""
    live, out = [[p] for p in points], []
    far = lambda a, b: sum(math.dist(p, q) for p in a for q in b) / len(a) / len(b)
    while len(live) > 1:
        h, i, j = min((far(a, b), i, j) for i, a in enumerate(live) for j, b in enumerate(live) if i < j)
        out.append((h, len(live[i]) + len(live[j])))
        live[i] += live.pop(j)
    return out


def test_dendrograms_of_all_points(spark, small_dir, items):
    got = {}
    for r in QUERIES["agglomerative_clusters"](spark, small_dir).collect():
        got.setdefault(r.image_id, []).append((r.step, r.height, r["size"]))
    for image, rows in boxes_by_image(items).items():
        want = py_merges([((x1 + x2) / 2, (y1 + y2) / 2) for _, _, x1, y1, x2, y2 in rows])
        own = sorted(got[image])
        assert len(own) == len(rows) - 1
        assert [h for _, h, _ in own] == pytest.approx([h for h, _ in want]) and [n for *_, n in own] == [n for _, n in want]


def test_jitter_of_all_boxes(spark, small_dir, items):
    want = set()
    for image, rows in boxes_by_image(items).items():
        for i, (_, _, *box) in enumerate(rows, 1):
            w, h = box[2] - box[0], box[3] - box[1]
            if box[2] > 640 or box[3] > 480 or w < 0.2 * h or h < 0.2 * w:
                continue
            for k in range(1, 13):
                for side in range(4):
                    by = math.floor((h if side % 2 else w) * k * 25 / 1000 + 0.5)
                    to = box[side] + (by if side > 1 else -by)
                    if to > 1 if side < 2 else to < (639, 479)[side - 2]:
                        want.add((image, i, k, side, *(to if c == side else v for c, v in enumerate(box))))
    got = [tuple(r) for r in QUERIES["box_jitter"](spark, small_dir).collect()]
    assert len(got) == len(want) and set(got) == want and max(r[1] for r in got) > 20


def test_voc_of_all_objects(spark, small_dir, items):
    want = {(str(image), i, str(label), *(max(v, 1) for v in box)) for image, rows in boxes_by_image(items).items() for i, (label, _, *box) in enumerate(rows)}
    got = QUERIES["voc_round_trip"](spark, small_dir).select("image", "ord", "label", "x1", "y1", "x2", "y2").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
