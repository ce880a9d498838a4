"""Windows over pixels: integral histograms, the search for the borders of a face by the entropy of its grey levels, and global descriptors by oriented filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import entropy
from lumenframe.operators.objectness import dense

# Steps of grey, share of a side in a step, bounds of the ratio of entropies, and the sides of the first window.
LEVELS, STRIDE, LOW, HIGH, PART, TALL = 6, 0.1, 0.8333, 1.2, 0.4, 0.75
#: Kinds of search: a half face to both sides, an eye downwards, a mouth upwards.
HALF, EYE, MOUTH = 1, 2, 3


def integral_histogram(pixels: DataFrame, value: str, size: tuple[int, int], levels: int = LEVELS, key: str = "img") -> DataFrame:
    """key, x, y, c: for each level how many pixels it has in the rectangle from the corner of the image up to (x, y); missing pixels have none."""
    step = int(255.0 / levels + 0.5)
    own = pixels.select(key, "x", "y", (F.floor(F.col(value) / step) + 1).cast("int").alias("bin"))
    d = dense(own, size, ["bin"], key)
    for order, line in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(key, line).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.select(key, "x", "y", *(F.sum(F.when(F.col("bin") == k + 1, 1).otherwise(0) if order == "x" else F.col(f"c{k}")).over(w).alias(f"c{k}") for k in range(levels)))
    return d.select(key, "x", "y", F.array(*(F.col(f"c{k}") for k in range(levels))).alias("c"))


def window_histograms(windows: DataFrame, integral: DataFrame, size: tuple[int, int], key: str = "img") -> DataFrame:
    """windows (key and any columns, x1, y1, x2, y2 exclusive) with p, the shares of the levels of their part inside the image: four corners of the integral each."""
    inside = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c), F.lit(n)))
    w = windows.withColumn("window", F.struct(*windows.columns)).select(key, "window", inside("x1", size[0]).alias("x1"), inside("y1", size[1]).alias("y1"), inside("x2", size[0]).alias("x2"), inside("y2", size[1]).alias("y2"))
    corner = lambda x, y, sign: F.struct((F.col(x) - 1).alias("x"), (F.col(y) - 1).alias("y"), F.lit(sign).alias("sign"))
    corners = F.explode(F.array(corner("x2", "y2", 1), corner("x1", "y2", -1), corner("x2", "y1", -1), corner("x1", "y1", 1)))
    j = w.withColumn("k", corners).select(key, "window", F.col("k.x").alias("x"), F.col("k.y").alias("y"), F.col("k.sign").alias("sign"))
    # A corner before the first row or column has nothing below it.
    j = j.join(integral, [key, "x", "y"], "left").select("window", F.posexplode_outer(F.transform("c", lambda v: v * F.col("sign"))).alias("level", "n"))
    g = j.groupBy("window", "level").agg(F.sum("n").alias("n")).where("level IS NOT NULL")
    g = g.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("h"))
    total = F.aggregate("h", F.lit(0).cast("long"), lambda s, v: s + v["n"])
    return g.select("window.*", F.transform("h", lambda v: v["n"] / total).alias("p"))


def searched(faces: DataFrame, pixels: DataFrame, value: str, size: tuple[int, int], key: str = "img") -> DataFrame:
    """faces (key, ord, kind, x1, y1, x2, y2) with borders moved: windows step outwards from the face while the entropy of their grey levels stays near that of the first.

    Half faces are searched to the left and right, eyes downwards, mouths upwards; a way ends before the first window that differs.
    """
    f = faces.select(key, "ord", "kind", "x1", "y1", "x2", "y2").withColumns({"rw": F.col("x2") - F.col("x1"), "rh": F.col("y2") - F.col("y1")})
    half = F.col("kind") == HALF
    f = f.withColumns({"sw": F.when(half, F.floor(F.col("rw") * PART + 0.5)).otherwise(F.col("rw")).cast("int"), "sh": F.when(half, F.floor(F.col("rh") * TALL + 0.5)).otherwise(F.floor(F.col("rh") * PART + 0.5)).cast("int")})
    way = lambda name, room, side: F.struct(F.lit(name).alias("way"), F.floor(room / (STRIDE * F.col(side))).cast("int").alias("most"))
    ways = F.when(half, F.array(way("left", F.col("x1"), "rw"), way("right", size[0] - F.col("x2"), "rw")))
    ways = ways.when(F.col("kind") == EYE, F.array(way("down", size[1] - F.col("y2"), "rh"))).otherwise(F.array(way("up", F.col("y1"), "rh")))
    steps = f.withColumn("w", F.explode(ways)).where("w.most >= 1").withColumn("m", F.explode(F.sequence(F.lit(0), F.col("w.most"))))
    out = lambda side: F.col("m") * F.col(side) * STRIDE
    wx = F.when(F.col("w.way") == "left", F.col("x1") - out("rw")).when(F.col("w.way") == "right", F.col("x2") - F.col("sw") + out("rw")).otherwise(F.col("x1"))
    wy = F.when(F.col("w.way") == "up", F.col("y1") - out("rh")).when(F.col("w.way") == "down", F.col("y2") - F.col("sh") + out("rh")).otherwise(F.col("y1"))
    wx, wy = F.floor(F.round(wx, 6)).cast("int"), F.floor(F.round(wy, 6)).cast("int")
    windows = steps.select(key, "ord", F.col("w.way").alias("way"), "m", wx.alias("x1"), wy.alias("y1"), (wx + F.col("sw")).alias("x2"), (wy + F.col("sh")).alias("y2"))
    e = window_histograms(windows, integral_histogram(pixels, value, size, key=key), size, key).select(key, "ord", "way", "m", entropy(F.col("p")).alias("e"))
    w = Window.partitionBy(key, "ord", "way")
    first = F.max(F.when(F.col("m") == 0, F.col("e"))).over(w)
    ratio = F.col("e") / F.nullif(first, F.lit(0.0))
    bad = F.when((F.col("m") > 0) & ~F.coalesce((ratio < HIGH) & (ratio > LOW), F.lit(False)), F.col("m"))
    reach = e.withColumn("bad", bad).groupBy(key, "ord").pivot("way", ["left", "right", "up", "down"]).agg(F.coalesce(F.min("bad") - 1, F.max("m")))
    j = f.join(reach, [key, "ord"], "left").na.fill(0, ["left", "right", "up", "down"])
    moved = lambda c, way, side, sign: F.floor(F.col(c) + sign * F.col(way) * F.col(side) * STRIDE + 0.5).cast("int").alias(c)
    return j.select(key, "ord", "kind", moved("x1", "left", "rw", -1), moved("y1", "up", "rh", -1), moved("x2", "right", "rw", 1), moved("y2", "down", "rh", 1))


# Oriented filters


def oriented_filters(height: int, width: int, orientations: tuple[int, ...]) -> np.ndarray:
    """Gains by filter, row and column frequency: scales from fine to coarse, each with a number of orientations."""
    fx, fy = np.fft.fftfreq(width) * width, np.fft.fftfreq(height) * height
    radius, angle = np.hypot(fx[None], fy[:, None]), np.arctan2(fy[:, None], fx[None] + 0 * fy[:, None])
    out = []
    for scale, n in enumerate(orientations):
        centre, spread = 0.3 / 1.85**scale, 16 * n**2 / 32.0**2
        for k in range(n):
            turned = (angle + np.pi / n * k + np.pi) % (2 * np.pi) - np.pi
            out.append(np.exp(-3.5 * (radius / height / centre - 1) * (radius / width / centre - 1) - 2 * np.pi * spread * turned * turned))
    return np.array(out)


def low_pass(height: int, width: int, cycles: float = 4.0) -> np.ndarray:
    fx, fy = np.fft.fftfreq(width) * width, np.fft.fftfreq(height) * height
    return np.exp(-(fx[None] ** 2 + fy[:, None] ** 2) * np.log(2) / cycles**2)


def even_contrast(grey: np.ndarray, padding: int = 5) -> np.ndarray:
    """Logarithm of grey without its slow part, over the local deviation; the image is continued by mirroring."""
    x = np.pad(np.log(grey + 1.0), padding, mode="symmetric")
    low = low_pass(*x.shape)
    passed = lambda v: np.fft.ifft2(np.fft.fft2(v) * low)
    x = x - passed(x).real
    x = x / (0.2 + np.sqrt(np.abs(passed(x * x))))
    return x[padding:-padding, padding:-padding]


def oriented_energies(grey: np.ndarray, blocks: int = 4, orientations: tuple[int, ...] = (8, 8, 4)) -> np.ndarray:
    """Mean response of each filter in each of blocks x blocks parts, by columns of parts."""
    seen = np.fft.fft2(even_contrast(grey))
    h, w = grey.shape
    ys, xs = [i * h // blocks for i in range(blocks + 1)], [i * w // blocks for i in range(blocks + 1)]
    out = []
    for gain in oriented_filters(h, w, orientations):
        e = np.abs(np.fft.ifft2(seen * gain))
        out += [e[ys[j] : ys[j + 1], xs[i] : xs[i + 1]].mean() for i in range(blocks) for j in range(blocks)]
    return np.array(out)


def global_descriptors(pixels: DataFrame, value: str, size: tuple[int, int], key: str = "img", blocks: int = 4, orientations: tuple[int, ...] = (8, 8, 4)) -> DataFrame:
    """key and descriptor, blocks^2 numbers for each filter, of images of a size of at least 8 x 8; missing pixels are 0. An image is a group."""
    kind = pixels.schema[key].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        grey = np.zeros((size[1], size[0]))
        grey[pdf["y"], pdf["x"]] = pdf[value]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "descriptor": [oriented_energies(grey, blocks, orientations)]})

    inside = pixels.select(key, "x", "y", value).where((F.col("x") < size[0]) & (F.col("y") < size[1]) & F.col(value).isNotNull())
    return inside.groupBy(key).applyInPandas(run, f"{key} {kind}, descriptor array<double>")


def in_ellipse(size: tuple[int, int]) -> Column:
    """Whether a pixel is in the upright ellipse at the centre of an image, a sixth as wide and a third as high as it to each side."""
    w, h = size
    x, y = (F.col("x") - w // 2) / float(w // 6), (F.col("y") - h // 2) / float(h // 3)
    return x * x + y * y <= 1
