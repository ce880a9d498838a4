"""Strokes: edges of grey images, regions without what lies across their edges, and widths of strokes; the second text chain.

Pixels are rows (image, x, y, value). Neighbourhoods are joins by shifted places; the width of a stroke is climbed to
along the distance to the border, one distance a round, so rounds are as many as half the widest stroke.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import regions
from lumenframe.operators.extremal import border_distances, stable_regions
from lumenframe.operators.images import around
from lumenframe.session import written

# Weights of the derivative across, by the neighbour's place; the other direction is its transpose.
SOBEL = {(-1, -1): -1, (-1, 0): -2, (-1, 1): -1, (1, -1): 1, (1, 0): 2, (1, 1): 1}
# Steps of the eight directions, by angle in steps of 45 degrees, x to the right and y down.
DIRECTIONS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def derivatives(pixels: DataFrame, value: str, key: str = "img") -> DataFrame:
    """key, x, y, gx, gy: derivatives of 3 x 3 neighbours; a missing neighbour counts as the pixel itself."""
    at = lambda dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col(value)))
    places = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    name = lambda dx, dy: f"n_{dx + 1}_{dy + 1}"
    g = around(pixels, value, key).groupBy(key, "x", "y").agg(*(at(dx, dy).alias(name(dx, dy)) for dx, dy in places)).where(f"{name(0, 0)} IS NOT NULL")
    of = lambda dx, dy: F.coalesce(name(dx, dy), name(0, 0))
    gx = sum((w * of(dx, dy) for (dx, dy), w in SOBEL.items()), F.lit(0))
    gy = sum((w * of(dy, dx) for (dx, dy), w in SOBEL.items()), F.lit(0))
    return g.select(key, "x", "y", gx.alias("gx"), gy.alias("gy"))


def direction(gx: str = "gx", gy: str = "gy"):
    """The nearest of eight directions, 0 to the right and 2 down; null without a gradient."""
    return F.when((F.col(gx) != 0) | (F.col(gy) != 0), F.pmod(F.floor(F.atan2(gy, gx) / F.lit(0.7853981633974483) + 0.5), F.lit(8)).cast("int"))


def stepped(direction: str, axis: int):
    """The step of a direction along x (0) or y (1)."""
    return F.array(*(F.lit(s[axis]) for s in DIRECTIONS))[F.col(direction)]


def edges(pixels: DataFrame, value: str, low: float, high: float, key: str = "img") -> DataFrame:
    """key, x, y, direction of edge pixels: gradients that no neighbour along their direction exceeds, at least ``high``, or at least ``low`` and connected with such."""
    g = derivatives(pixels, value, key).withColumns({"m": F.abs("gx") + F.abs("gy"), "direction": direction()})
    g = g.where(F.col("direction").isNotNull())
    sides = g.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumns({"sx": F.col("x") + F.col("side") * stepped("direction", 0), "sy": F.col("y") + F.col("side") * stepped("direction", 1)})
    other = g.select(key, F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("m").alias("other"))
    ridge = sides.join(other, [key, "sx", "sy"], "left").groupBy(key, "x", "y", "m", "direction").agg(F.max(F.coalesce("other", F.lit(0))).alias("most")).where("m >= most").where(F.col("m") >= low)
    ridge = written(ridge.select(key, "x", "y", "m", "direction"), "edges")
    blobs = regions.labelled_blobs(ridge, key)
    joined = ridge.join(blobs, [key, "x", "y"], "left")
    strong = joined.where(F.col("m") >= high).select(key, "blob").where("blob IS NOT NULL").distinct().withColumn("strong", F.lit(True))
    return joined.join(strong, [key, "blob"], "left").where((F.col("m") >= high) | F.col("strong")).select(key, "x", "y", "direction")


def without_edges(mask: DataFrame, edge: DataFrame, key: str = "img") -> DataFrame:
    """The mask (key, x, y) less its edge pixels and the pixel that lies next to each along its gradient."""
    inside = edge.join(mask, [key, "x", "y"], "left_semi")
    grown = inside.select(key, (F.col("x") + stepped("direction", 0)).alias("x"), (F.col("y") + stepped("direction", 1)).alias("y"))
    return mask.join(inside.select(key, "x", "y").union(grown), [key, "x", "y"], "left_anti")


def stroke_widths(members: DataFrame, keys: list[str]) -> DataFrame:
    """members (keys, x, y) with d, the distance to the border, and w, the largest distance that a climb over ever farther neighbours reaches: half the width of the stroke that a pixel is in."""
    d = written(border_distances(members, keys), "border-distances")
    top = d.agg(F.max("d")).first()[0] or 0
    settled = written(d.where(F.col("d") == top).withColumn("w", F.col("d")), "stroke-widths")
    for level in range(top - 1, 0, -1):
        own = d.where(F.col("d") == level)
        beside = own.withColumn("s", F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in DIRECTIONS))))
        beside = beside.select(*keys, "x", "y", "d", (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.dy")).alias("ny"))
        higher = settled.select(*keys, F.col("x").alias("nx"), F.col("y").alias("ny"), "w")
        climbed = beside.join(higher, [*keys, "nx", "ny"], "left").groupBy(*keys, "x", "y", "d").agg(F.greatest(F.max("w"), F.col("d")).alias("w"))
        settled = written(settled.unionByName(climbed), "stroke-widths")
    return settled


def stroke_components(pixels: DataFrame, value: str, key: str = "img", low: float = 20, high: float = 100, area=(75, 600), eccentricity=(0.1, 0.995), solidity: float = 0.4, most_cv: float = 0.5, **stable) -> DataFrame:
    """key, blob, n, x1, y1, x2, y2, stroke_mean, stroke_sd of the components of stable regions, cut at their edges, whose shape is plausible and whose stroke is even."""
    mask = written(stable_regions(pixels, key, value, **stable).select(key, "x", "y").distinct(), "text-mask")
    cut = without_edges(mask, edges(pixels, value, low, high, key), key)
    blobs = written(regions.labelled_blobs(cut, key, diagonal=False), "text-blobs")
    shape = regions.blob_shapes(blobs, [key, "blob"]).join(regions.solidity(blobs, [key, "blob"]).select(key, "blob", "solidity"), [key, "blob"])
    good = regions.components(shape, area, eccentricity, solidity).select(key, "blob")
    w = stroke_widths(blobs.join(good, [key, "blob"], "left_semi"), [key, "blob"])
    g = w.groupBy(key, "blob").agg(F.count("*").alias("n"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.avg("w").alias("stroke_mean"), F.stddev_pop("w").alias("stroke_sd"))
    return g.where(F.col("stroke_sd") <= most_cv * F.col("stroke_mean"))


def text_rectangles(components: DataFrame, sizes: DataFrame, key: str = "img", margin: int = 5) -> DataFrame:
    """key and the rectangle around the components of an image, with a margin, within the image (key, width, height)."""
    r = regions.bounding(components, [key]).join(sizes, key)
    inside = lambda c, side: F.greatest(F.lit(0), F.least(c, F.col(side)))
    return r.select(key, "n", *(inside(F.col(c) - margin, side).alias(c) for c, side in (("x1", "width"), ("y1", "height"))), *(inside(F.col(c) + margin, side).alias(c) for c, side in (("x2", "width"), ("y2", "height"))))
