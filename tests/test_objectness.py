import random

import pytest

from lumenframe.operators import objectness as O


def plain_gradients(v, w, h):
    out = {}
    for y in range(h):
        for x in range(w):
            def side(a, b):
                pairs = [(v.get(a, None), v.get(b, None))]
                (p, q), own = pairs[0], v[x, y]
                if p is not None and q is not None:
                    return max(abs(i - j) for i, j in zip(p, q, strict=True))
                return 2 * max((abs(i - j) for o in (p, q) if o is not None for i, j in zip(o, own, strict=True)), default=0)

            out[x, y] = min(255, side((x - 1, y), (x + 1, y)) + side((x, y - 1), (x, y + 1)))
    return out


def plain_scores(v, w, h, signs):
    g = plain_gradients(v, w, h)
    weight = [sum(s if (word >> (63 - k)) & 1 else -s for word, s in signs) for k in range(64)]
    return {(x, y): sum(weight[8 * j + i] * (g[x + i, y + j] >> 4) for i in range(8) for j in range(8)) for x in range(w - 7) for y in range(h - 7)}


@pytest.fixture(scope="module")
def image():
    rnd = random.Random(11)
    v = {(x, y): (rnd.randrange(60), rnd.randrange(60)) for x in range(20) for y in range(13)}
    for x in range(9, 17):
        for y in range(3, 11):
            v[x, y] = (220, rnd.randrange(200, 256))
    return v


@pytest.fixture(scope="module")
def pixels(spark, image):
    return spark.createDataFrame([(7, x, y, a, b) for (x, y), (a, b) in image.items()] + [(8, 2, 2, 255, 0)], "img int, x int, y int, a int, b int")


def test_bit_scores_are_plain_dot_products(pixels, image):
    rnd = random.Random(1)
    for signs in (O.signs_of([rnd.uniform(-2, 2) for _ in range(64)], 3), O.signs_of([1.0] * 64, 1), O.signs_of([-1.0] + [1.0] * 62 + [-1.0], 2)):
        got = {(r.img, r.x, r.y): r.score for r in O.scores(pixels, ["a", "b"], (20, 13), signs).collect()}
        blank = {(x, y): (0, 0) for x in range(20) for y in range(13)} | {(2, 2): (255, 0)}
        want = {(k, *p): s for k, v in ((7, image), (8, blank)) for p, s in plain_scores(v, 20, 13, signs).items()}
        assert got == pytest.approx(want, abs=1e-6)


def test_signs_keep_what_they_can():
    w = [0.5 if k % 3 else -1.5 for k in range(64)]
    signs = O.signs_of(w, 2)
    back = [sum(s if (word >> (63 - k)) & 1 else -s for word, s in signs) for k in range(64)]
    assert back == pytest.approx(w, abs=0.35) and all(-(1 << 63) <= word < 1 << 63 for word, _ in signs)


def test_proposals_equal_plain_ones(pixels, image):
    rim = [1.0 if min(i, j, 7 - i, 7 - j) == 0 else -0.4 for i in range(8) for j in range(8)]
    signs, windows = O.signs_of(rim), {(10, 13): (0.5, 1.0), (10, 6): (2.0, -3.0)}
    got = sorted((r.width, r.height, r.x1, r.y1, r.x2, r.y2, round(r.score, 6)) for r in O.proposals(pixels.where("img = 7"), ["a", "b"], (20, 13), windows, signs, 5).collect())
    want = []
    for (w, h), (slope, intercept) in windows.items():
        nw, nh = O.resized((20, 13), (w, h))
        small = {(x, y): image[x * 20 // nw, y * 13 // nh] for x in range(nw) for y in range(nh)}
        kept = []
        for (x, y), s in sorted(plain_scores(small, nw, nh, signs).items(), key=lambda p: (-p[1], p[0][1] * nw + p[0][0])):
            if len(kept) < 5 and not any(abs(x - a) <= 2 and abs(y - b) <= 2 for a, b, _ in kept):
                kept.append((x, y, s))
        for x, y, s in kept:
            x1, y1 = x * 20 // nw, y * 13 // nh
            want.append((w, h, x1, y1, min(x1 + w, 20), min(y1 + h, 13), round(slope * s + intercept, 6)))
    assert [r[:6] for r in got] == [r[:6] for r in sorted(want)]
    assert [r[6] for r in got] == pytest.approx([r[6] for r in sorted(want)], abs=1e-5)
