"""Objectness of windows: gradients of resized images, cut to their four high bits, against a template of signs.

A window of 8 x 8 gradients is four words of 64 bits, one for each high bit, made by running sums over rows and columns
(lags, no join). A template is a few words of signs with a weight each, so a score is bit counts and
products: whole-stage expressions. It equals the plain dot product of the signs' weights with the gradients' high bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.images import resampled
from lumenframe.operators.nms import spatial_peaks

#: Side of a window, and the bits of a gradient that count.
SIDE, BITS = 8, (4, 5, 6, 7)


def dense(pixels: DataFrame, size: tuple[int, int], values: Sequence[str], key: str = "img") -> DataFrame:
    """Every place of a width and height for each image; missing pixels are 0."""
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    places = pixels.select(key).distinct().withColumn("x", span(size[0])).withColumn("y", span(size[1]))
    return places.join(pixels.select(key, "x", "y", *values), [key, "x", "y"], "left").na.fill(0, list(values))


def normed_gradients(pixels: DataFrame, values: Sequence[str], key: str = "img") -> DataFrame:
    """key, x, y, g of a dense image: across and down the largest difference of a channel between both neighbours, twice that to the only neighbour at a border; their sum, 255 at most."""

    def change(line: str, along: str) -> Column:
        w = Window.partitionBy(key, line).orderBy(along)
        before, after = [F.lag(c).over(w) for c in values], [F.lead(c).over(w) for c in values]
        most = lambda a, b: F.greatest(*(F.abs(p - q) for p, q in zip(a, b, strict=True)), F.lit(0))
        own = [F.col(c) for c in values]
        return F.when(before[0].isNotNull() & after[0].isNotNull(), most(before, after)).otherwise(2 * F.greatest(F.coalesce(most(before, own), F.lit(0)), F.coalesce(most(after, own), F.lit(0))))

    return pixels.select(key, "x", "y", F.least(change("y", "x") + change("x", "y"), F.lit(255)).cast("int").alias("g"))


def window_words(gradients: DataFrame, key: str = "img") -> DataFrame:
    """key, x, y (the window's first pixel) and a word of 64 bits for each of BITS: row by row, the first pixel highest."""
    across, down = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    lagged = lambda c, w, step: sum((F.shiftleft(F.lag(c, k).over(w), step * k) for k in range(1, SIDE)), F.col(c))
    g = gradients.select(key, "x", "y", *(F.shiftright("g", b).bitwiseAND(F.lit(1)).cast("long").alias(f"b{b}") for b in BITS))
    g = g.select(key, "x", "y", *(lagged(f"b{b}", across, 1).alias(f"r{b}") for b in BITS))
    # Words are joined by bits, so that the sign bit is one like the others.
    word = lambda c: _or([F.col(c), *(F.shiftleft(F.lag(c, k).over(down), SIDE * k) for k in range(1, SIDE))])
    g = g.select(key, (F.col("x") - SIDE + 1).alias("x"), (F.col("y") - SIDE + 1).alias("y"), *(word(f"r{b}").alias(f"t{b}") for b in BITS))
    return g.where(" AND ".join(f"t{b} IS NOT NULL" for b in BITS))


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def signs_of(weights: Sequence[float], terms: int = 2) -> list[tuple[int, float]]:
    """A template of 64 weights as words of signs (as signed longs) and a weight for each: each term takes the signs of what is left and their mean size."""
    left, out = list(map(float, weights)), []
    for _ in range(terms):
        sign = [1 if v >= 0 else -1 for v in left]
        size = sum(v * s for v, s in zip(left, sign, strict=True)) / len(left)
        left = [v - size * s for v, s in zip(left, sign, strict=True)]
        word = int("".join("1" if s > 0 else "0" for s in sign), 2)
        out.append((word - (1 << 64) if word >> 63 else word, size))
    return out


def template_score(signs: list[tuple[int, float]]) -> Column:
    """The dot product of a template with a window's high bits, of the words t4 to t7."""
    total = F.lit(0.0)
    for word, weight in signs:
        total = total + F.lit(weight) * sum(((1 << i) * (2 * F.bit_count(F.col(f"t{b}").bitwiseAND(F.lit(word))) - F.bit_count(F.col(f"t{b}"))) for i, b in enumerate(BITS)), F.lit(0))
    return total


def scores(pixels: DataFrame, values: Sequence[str], size: tuple[int, int], signs: list[tuple[int, float]], key: str = "img") -> DataFrame:
    """key, x, y, score of every window of an image of a size."""
    return window_words(normed_gradients(dense(pixels, size, values, key), values, key), key).select(key, "x", "y", template_score(signs).alias("score"))


def resized(size: tuple[int, int], window: tuple[int, int]) -> tuple[int, int]:
    """The size of an image in which a window of width and height has SIDE pixels a side."""
    return tuple(max(SIDE, int(SIDE * n / w + 0.5)) for n, w in zip(size, window, strict=True))


def proposals(pixels: DataFrame, values: Sequence[str], size: tuple[int, int], windows: dict[tuple[int, int], tuple[float, float]], signs: list[tuple[int, float]], per_window: int = 100, apart: int = 2, key: str = "img") -> DataFrame:
    """key, box, score, width and height of the best windows over all sizes, from {(width, height): (slope, intercept)}.

    In an image resized so that a window has SIDE pixels a side, the best places no two of which lie within ``apart`` stay, and
    each size has its own line from the template's score to a score that can be compared.
    """
    found = None
    for (w, h), (slope, intercept) in sorted(windows.items()):
        new = resized(size, (w, h))
        s = scores(resampled(dense(pixels, size, values, key), size, new, key), values, new, signs, key)
        points = s.select(F.col(key).alias("image_id"), "x", "y", "score", (F.col("y").cast("long") * new[0] + F.col("x")).alias("ord"))
        best = spatial_peaks(points, apart, per_window)
        x1, y1 = F.floor(F.col("x") * size[0] / F.lit(new[0])).cast("int"), F.floor(F.col("y") * size[1] / F.lit(new[1])).cast("int")
        boxes = best.select(F.col("image_id").alias(key), x1.alias("x1"), y1.alias("y1"), F.least(x1 + w, F.lit(size[0])).alias("x2"), F.least(y1 + h, F.lit(size[1])).alias("y2"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.col("score").alias("raw"), (slope * F.col("score") + intercept).alias("score"))
        found = boxes if found is None else found.unionByName(boxes)
    return found
