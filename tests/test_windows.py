import cmath
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import windows as W


@pytest.fixture(scope="module")
def image():
    """Noise in a band, flat at the sides."""
    rnd = random.Random(3)
    return {(x, y): rnd.randrange(256) if 9 <= x < 33 and y < 20 else 10 * (x // 20) for x in range(40) for y in range(26) if rnd.random() < 0.98}


def plain_entropy(v, x1, y1, x2, y2):
    own = [v[x, y] // 43 for x in range(max(x1, 0), min(x2, 40)) for y in range(max(y1, 0), min(y2, 26)) if (x, y) in v]
    return -sum(own.count(b) / len(own) * math.log2(own.count(b) / len(own)) for b in set(own))


def plain_search(v, kind, x1, y1, x2, y2):
    rw, rh = x2 - x1, y2 - y1
    sw, sh = (int(rw * 0.4 + 0.5), int(rh * 0.75 + 0.5)) if kind == 1 else (rw, int(rh * 0.4 + 0.5))
    at = lambda c: math.floor(round(c, 6))
    ways = {1: [("left", int(x1 / (0.1 * rw)), lambda m: (at(x1 - m * rw * 0.1), y1)), ("right", int((40 - x2) / (0.1 * rw)), lambda m: (at(x2 - sw + m * rw * 0.1), y1))],
            2: [("down", int((26 - y2) / (0.1 * rh)), lambda m: (x1, at(y2 - sh + m * rh * 0.1)))], 3: [("up", int(y1 / (0.1 * rh)), lambda m: (x1, at(y1 - m * rh * 0.1)))]}[kind]
    reach = dict.fromkeys(("left", "right", "up", "down"), 0)
    for way, most, place in ways:
        for m in range(most + 1):
            x, y = place(m)
            e = plain_entropy(v, x, y, x + sw, y + sh)
            if m == 0:
                first = e
            elif first and 0.8333 < e / first < 1.2:
                reach[way] = m
            else:
                break
    r = lambda c: math.floor(c + 0.5)
    return r(x1 - reach["left"] * rw * 0.1), r(y1 - reach["up"] * rh * 0.1), r(x2 + reach["right"] * rw * 0.1), r(y2 + reach["down"] * rh * 0.1)


def test_search_equals_stepping(spark, image):
    rnd = random.Random(7)
    faces = []
    for i in range(40):
        x1, y1 = rnd.randrange(0, 30), rnd.randrange(0, 18)
        faces.append((1, i, 1 + i % 3, x1, y1, x1 + rnd.randrange(5, 40 - x1 + 1) if x1 < 35 else 40, y1 + rnd.randrange(4, 26 - y1 + 1)))
    df = spark.createDataFrame([(1, x, y, g) for (x, y), g in image.items()], "img int, x int, y int, v int")
    got = {r.ord: (r.x1, r.y1, r.x2, r.y2) for r in W.searched(spark.createDataFrame(faces, "img int, ord int, kind int, x1 int, y1 int, x2 int, y2 int"), df, "v", (40, 26)).collect()}
    want = {f[1]: plain_search(image, *f[2:]) for f in faces}
    assert got == want and sum(want[f[1]] != f[3:] for f in faces) > 8


def test_filters_equal_plain_sums():
    """The descriptor by sums of waves, without a fast transform."""
    rnd = np.random.default_rng(1)
    grey = rnd.integers(0, 256, (8, 9)).astype(float)
    x = W.even_contrast(grey)
    h, w = x.shape
    f = {(a, b): sum(x[j, i] * cmath.exp(-2j * math.pi * (a * j / h + b * i / w)) for j in range(h) for i in range(w)) for a in range(h) for b in range(w)}
    got = W.oriented_energies(grey, 2, (2, 1))
    want = []
    for scale, n in enumerate((2, 1)):
        for k in range(n):
            e = np.zeros((h, w))
            for j in range(h):
                for i in range(w):
                    total = 0
                    for (a, b), c in f.items():
                        fa, fb = (a if a < h / 2 else a - h), (b if b < w / 2 else b - w)
                        r, t = math.hypot(fa, fb), math.atan2(fa, fb) + math.pi / n * k
                        t = t - 2 * math.pi if t > math.pi else t
                        centre = 0.3 / 1.85**scale
                        total += c * math.exp(-3.5 * (r / h / centre - 1) * (r / w / centre - 1) - 2 * math.pi * 16 * n * n / 1024 * t * t) * cmath.exp(2j * math.pi * (a * j / h + b * i / w))
                    e[j, i] = abs(total) / (h * w)
            want += [e[j * h // 2 : (j + 1) * h // 2, i * w // 2 : (i + 1) * w // 2].mean() for i in range(2) for j in range(2)]
    assert got == pytest.approx(want, rel=1e-6)


def test_descriptors_tell_directions(spark):
    """Stripes down and across answer different filters."""
    rows = [(k, x, y, 200 if ((x if k else y) // 2) % 2 else 20) for k in (0, 1) for x in range(32) for y in range(32)]
    out = {r.img: np.array(r.descriptor).reshape(-1, 16).sum(1) for r in W.global_descriptors(spark.createDataFrame(rows, "img int, x int, y int, v int"), "v", (32, 32)).collect()}
    assert len(out[0]) == 20 and out[0][:8].argmax() != out[1][:8].argmax()


def test_ellipse(spark):
    df = spark.range(12 * 9).select((F.col("id") % 12).alias("x"), F.expr("id div 12").alias("y"))
    got = {(r.x, r.y) for r in df.where(W.in_ellipse((12, 9))).collect()}
    assert got == {(x, y) for x in range(12) for y in range(9) if ((x - 6) / 2) ** 2 + ((y - 4) / 3) ** 2 <= 1}


def test_repaired_half_faces_are_widened(spark, image):
    from lumenframe.operators.faces import repaired

    rows = spark.createDataFrame([(1, 0, "half", 0.9, 15, 2, 25, 16), (2, 0, "face", 0.9, 1, 1, 9, 9)], "image_id int, ord int, label string, score double, x1 int, y1 int, x2 int, y2 int")
    pixels = spark.createDataFrame([(1, x, y, g) for (x, y), g in image.items()], "image_id int, x int, y int, v int")
    got = {r.image_id: (r.kind, r.x1, r.y1, r.x2, r.y2) for r in repaired(rows, width=40, height=26, pixels=pixels).collect()}
    assert got == {1: ("half", *plain_search(image, 1, 15, 2, 25, 16)), 2: ("strong", 1, 1, 9, 9)} and got[1][1] < 15
