"""Operators on grids of pixels as rows (img, x, y, ...): neighbourhoods are joins by shifted places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The binomial kernel of 3 x 3.
BINOMIAL = {(dx, dy): (2 - abs(dx)) * (2 - abs(dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}


def around(pixels: DataFrame, value: str, key: str = "img", radius: int = 1) -> DataFrame:
    """Each pixel sent to the places it is a neighbour of: key, x, y, dx, dy, value. Places outside the image are dropped later, with their centre."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    x = pixels.select(key, "x", "y", value, F.explode(steps).alias("dx")).withColumn("dy", F.explode(steps))
    return x.select(key, (F.col("x") - F.col("dx")).alias("x"), (F.col("y") - F.col("dy")).alias("y"), "dx", "dy", value)


def smoothed(pixels: DataFrame, value: str, key: str = "img") -> DataFrame:
    """The binomial mean of the neighbours that exist."""
    weight = F.lit(0)
    for (dx, dy), w in BINOMIAL.items():
        weight = F.when((F.col("dx") == dx) & (F.col("dy") == dy), w).otherwise(weight)
    g = around(pixels, value, key).groupBy(key, "x", "y").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("smooth"), F.max((F.col("dx") == 0) & (F.col("dy") == 0)).alias("centre"))
    return g.where("centre").drop("centre")


def median_filtered(pixels: DataFrame, value: str, key: str = "img") -> DataFrame:
    """The median of the neighbours that exist, the upper of two in the middle."""
    g = around(pixels, value, key).groupBy(key, "x", "y").agg(F.sort_array(F.collect_list(value)).alias("v"), F.max((F.col("dx") == 0) & (F.col("dy") == 0)).alias("centre"))
    return g.where("centre").select(key, "x", "y", F.col("v")[F.floor(F.size("v") / 2).cast("int")].alias("median"))


def resampled(pixels: DataFrame, size: tuple[int, int], new: tuple[int, int], key: str = "img") -> DataFrame:
    """Nearest-neighbour resize from one (width, height) to another: every pixel goes to the places that read it."""
    (w, h), (nw, nh) = size, new
    first = lambda c, old, now: F.ceil(F.col(c) * now / F.lit(old)).cast("int")
    last = lambda c, old, now: (F.ceil((F.col(c) + 1) * now / F.lit(old)) - 1).cast("int")
    span = lambda c, old, now: F.when(first(c, old, now) <= last(c, old, now), F.sequence(first(c, old, now), last(c, old, now)))
    other = [c for c in pixels.columns if c not in (key, "x", "y")]
    x = pixels.withColumn("tx", F.explode(span("x", w, nw))).withColumn("ty", F.explode(span("y", h, nh)))
    return x.select(key, F.col("tx").alias("x"), F.col("ty").alias("y"), *other)


def region(pixels: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """The pixels of a rectangle, counted from its corner."""
    return pixels.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2)).withColumns({"x": F.col("x") - x1, "y": F.col("y") - y1})


def mean_colour_saliency(pixels: DataFrame, channels: dict[str, Column], key: str = "img") -> DataFrame:
    """Squared distance of each pixel to the mean of its image, over the given channels."""
    p = pixels.withColumns(channels)
    mean = p.groupBy(key).agg(*(F.avg(c).alias(f"m_{c}") for c in channels))
    gap = sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in channels), F.lit(0.0))
    return p.join(mean, key).withColumn("saliency", gap).drop(*channels, *(f"m_{c}" for c in channels))


def hot_cells(cells: DataFrame, weights: DataFrame, key: str = "img", share: float = 0.5) -> DataFrame:
    """key, x, y, heat, top: cells of a class-activation map (key, x, y, channel, a) that exceed a share of the largest."""
    heat = cells.join(weights, "channel").groupBy(key, "x", "y").agg(F.sum(F.col("a") * F.col("w")).alias("heat"))
    top = heat.groupBy(key).agg(F.max("heat").alias("top"))
    return heat.join(top, key).where(F.col("heat") > share * F.col("top"))


def activation_boxes(cells: DataFrame, weights: DataFrame, key: str = "img", share: float = 0.5) -> DataFrame:
    """Class-activation map: weighted sums over channels of cells (key, x, y, channel, a), and the box of the cells that reach a share of the largest."""
    hot = hot_cells(cells, weights, key, share)
    return hot.groupBy(key).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("n"), F.max("top").alias("top"))


def gradients(pixels: DataFrame, value: str, key: str = "img") -> DataFrame:
    """Larger of the absolute central differences in both directions; a neighbour that is missing counts as the pixel itself."""
    g = around(pixels, value, key).groupBy(key, "x", "y").agg(*(F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col(value))).alias(n) for n, dx, dy in (("own", 0, 0), ("l", -1, 0), ("r", 1, 0), ("u", 0, -1), ("d", 0, 1))))
    at = lambda n: F.coalesce(n, "own")
    return g.where("own IS NOT NULL").select(key, "x", "y", F.greatest(F.abs(at("r") - at("l")), F.abs(at("d") - at("u"))).alias("gradient"))


def blur_measures(pixels: DataFrame, value: str, key: str = "img") -> DataFrame:
    """Mean gradient of an image and the share of it that smoothing leaves: sharp images lose much."""
    before = gradients(pixels, value, key).groupBy(key).agg(F.avg("gradient").alias("before"))
    after = gradients(smoothed(pixels, value, key), "smooth", key).groupBy(key).agg(F.avg("gradient").alias("after"))
    return before.join(after, key).withColumn("left", F.col("after") / F.nullif(F.col("before"), F.lit(0.0)))
