"""Saliency by contrast of colours and of segments, and the separate spots of a mask.

Pixels are rows (image, x, y, r, g, b), segments and colours are numbers beside them. An image has at most ``MOST`` colours after
quantisation, so pairs of colours are a bounded join within an image; pairs of segments meet by way of the colours of one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.pixels import lab
from lumenframe.operators.regions import labelled_blobs
from lumenframe.session import written

# Steps of a channel, share of the pixels whose colours stay, most and fewest colours of an image.
LEVELS, SHARE, MOST, FEW = 12, 0.95, 256, 10


def colour_code(levels: int = LEVELS) -> Column:
    step = lambda c: F.floor(F.col(c) / 255.0 * (levels - 0.0001))
    return ((step("r") * levels + step("g")) * levels + step("b")).cast("int")


def quantised(pixels: DataFrame, key: str = "img", levels: int = LEVELS, share: float = SHARE, most: int = MOST, few: int = FEW) -> DataFrame:
    """pixels with colour, a rank by frequency in the image: the rare colours beyond ``share`` of the pixels become the nearest frequent one."""
    coded = pixels.withColumn("code", colour_code(levels))
    n = coded.groupBy(key, "code").agg(F.count("*").alias("n"))
    by_rank = Window.partitionBy(key).orderBy(F.desc("n"), F.desc("code"))
    whole = Window.partitionBy(key)
    n = n.withColumns({"rank": F.row_number().over(by_rank), "upto": F.sum("n").over(by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "all": F.sum("n").over(whole), "kinds": F.count("*").over(whole)})
    # A colour stays while it and all rarer ones hold as many pixels as may be given up.
    n = n.withColumn("stays", (F.col("rank") == 1) | (F.col("all") - F.col("upto") + F.col("n") >= F.rint(F.col("all") * (1 - share))))
    n = n.withColumn("keep", F.least(F.count_if("stays").over(whole), F.lit(most)))
    n = n.withColumn("keep", F.when(F.col("keep") <= few, F.least(F.lit(few), F.col("kinds"))).otherwise(F.col("keep")))
    n = written(n.select(key, "code", "rank", (F.col("rank") <= F.col("keep")).alias("kept")), "colours")
    part = lambda c: (F.floor(F.col(c) / (levels * levels)), F.floor(F.col(c) / levels) % levels, F.col(c) % levels)
    other = n.where("kept").select(key, F.col("code").alias("near"), F.col("rank").alias("colour"))
    gap = sum(((p - q) * (p - q) for p, q in zip(part("code"), part("near"), strict=True)), F.lit(0))
    moved = n.where("NOT kept").join(other, key).groupBy(key, "code").agg(F.min(F.struct(gap.alias("gap"), "colour")).alias("m")).select(key, "code", "m.colour")
    return coded.join(n.where("kept").select(key, "code", F.col("rank").alias("colour")).unionByName(moved), [key, "code"]).drop("code")


def palette(coloured: DataFrame, key: str = "img") -> DataFrame:
    """key, colour, n, and l, a, bb of the mean of its pixels."""
    return coloured.groupBy(key, "colour").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "rgb")).withColumns(lab()).select(key, "colour", "n", "l", "a", "bb")


def colour_gaps(colours: DataFrame, key: str = "img") -> DataFrame:
    """key, colour, other, n (pixels of the other) and gap, their distance, for all pairs of colours of an image, each with itself too."""
    o = colours.select(key, F.col("colour").alias("other"), "n", *(F.col(c).alias(f"o_{c}") for c in ("l", "a", "bb")))
    gap = F.sqrt(sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in ("l", "a", "bb")), F.lit(0.0)))
    return colours.select(key, "colour", "l", "a", "bb").join(o, key).select(key, "colour", "other", "n", gap.alias("gap"))


def stretched(rows: DataFrame, value: str, key: str) -> Column:
    """A value from 0 for the least to 1 for the largest of its image; 0 where all are equal."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)


def colour_contrast(colours: DataFrame, key: str = "img", delta: float = 0.25) -> DataFrame:
    """key, colour, saliency from 0 to 1: distance to all pixels of the image, then the mean over the ``delta`` share of most similar colours, nearer ones weighing more."""
    gaps = written(colour_gaps(colours, key), "colour-gaps")
    raw = gaps.groupBy(key, "colour").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("s"), F.count("*").alias("kinds"))
    nearest = gaps.join(raw.select(key, F.col("colour").alias("other"), "s", "kinds"), [key, "other"])
    w = Window.partitionBy(key, "colour")
    nearest = nearest.withColumn("k", F.row_number().over(w.orderBy("gap", "other"))).where(F.col("k") <= F.greatest(F.rint(F.col("kinds") * delta), F.lit(2)))
    nearest = nearest.withColumns({"total": F.sum("gap").over(w), "size": F.count("*").over(w)})
    smooth = nearest.groupBy(key, "colour").agg(F.coalesce(F.sum(F.col("s") * (F.col("total") - F.col("gap"))) / F.nullif(F.max(F.col("total") * F.col("size")), F.lit(0.0)), F.max("s")).alias("smooth"))
    return smooth.withColumn("saliency", stretched(smooth, "smooth", key)).drop("smooth")


def segment_contrast(coloured: DataFrame, size: tuple[int, int], key: str = "img", sigma: float = 0.4) -> DataFrame:
    """key, segment, saliency from 0 to 1, of pixels with segment and colour: contrast with the other segments' colours, more for large and near ones, less far from the centre."""
    width, height = size
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    seg = coloured.groupBy(key, "segment").agg(
        F.count("*").alias("n"), (F.avg(x) / width).alias("cx"), (F.avg(y) / height).alias("cy"), (F.avg(F.abs(x - width / 2)) / width).alias("ox"), (F.avg(F.abs(y - height / 2)) / height).alias("oy")
    )
    seg = written(seg, "segments")
    share = coloured.groupBy(key, "segment", "colour").agg(F.count("*").alias("m")).join(seg.select(key, "segment", "n"), [key, "segment"]).select(key, "segment", "colour", (F.col("m") / F.col("n")).alias("f"))
    share = written(share, "segment-colours")
    gaps = colour_gaps(palette(coloured, key), key).select(key, "colour", "other", "gap")
    # From each segment to each colour of the image, then to each segment by its colours.
    to_colour = share.withColumnRenamed("segment", "t").join(gaps, [key, "colour"]).groupBy(key, "t", "other").agg(F.sum(F.col("f") * F.col("gap")).alias("g"))
    pairs = share.join(to_colour.withColumnRenamed("other", "colour"), [key, "colour"]).where("segment != t").groupBy(key, "segment", "t").agg(F.sum(F.col("f") * F.col("g")).alias("dd"))
    o = seg.select(key, F.col("segment").alias("t"), F.col("n").alias("tn"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    pairs = pairs.join(seg, [key, "segment"]).join(o, [key, "t"])
    near = F.exp(-((F.col("cx") - F.col("tx")) * (F.col("cx") - F.col("tx")) + (F.col("cy") - F.col("ty")) * (F.col("cy") - F.col("ty"))) / sigma)
    centred = F.exp(-9.0 * (F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy")))
    s = pairs.groupBy(key, "segment").agg((F.sum(F.col("tn") * F.col("dd") * near) * F.max(centred)).alias("s"))
    s = seg.select(key, "segment").join(s, [key, "segment"], "left").na.fill(0.0, ["s"])
    return s.withColumn("saliency", stretched(s, "s", key)).drop("s")


def border_segments(segments: DataFrame, size: tuple[int, int], key: str = "img", share: float = 0.02, least: float = 0.4) -> DataFrame:
    """key, segment of those that are likely background: many pixels at the border for how far they spread along it."""
    width, height = size
    wide, high = max(1, round(width * share)), max(1, round(height * share))
    mean = segments.groupBy(key, "segment").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    j = segments.join(mean, [key, "segment"])
    at_side = lambda c, gap, n: F.when(F.col(c) < gap, 1).otherwise(0) + F.when(F.col(c) >= n - gap, 1).otherwise(0)
    g = j.groupBy(key, "segment").agg(
        F.sum(at_side("x", wide, width)).alias("bx"), F.sum(at_side("y", high, height)).alias("by"), (F.avg(F.abs(F.col("x") - F.col("mx"))) + 1e-8).alias("vx"), (F.avg(F.abs(F.col("y") - F.col("my"))) + 1e-8).alias("vy")
    )
    likely = F.col("bx") / (4.0 * high) / F.col("vy") + F.col("by") / (4.0 * wide) / F.col("vx")
    return g.where(likely > least).select(key, "segment")


def spots(mask: DataFrame, key: str = "img") -> DataFrame:
    """key, spot (1 for the largest, ties by the first pixel), n and box of each separate spot of a mask (key, x, y); a pixel touches its eight neighbours."""
    m = mask.select(key, "x", "y").distinct()
    blobs = labelled_blobs(m, key)
    # Pixels on their own are spots too; their numbers are apart from those of the others.
    alone = m.join(blobs, [key, "x", "y"], "left_anti").select(key, "x", "y", (-1 - (F.col("y").cast("long") * 65536 + F.col("x"))).alias("blob"))
    every = blobs.select(key, "x", "y", F.col("blob").cast("long").alias("blob")).unionByName(alone)
    g = every.groupBy(key, "blob").agg(F.count("*").alias("n"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.min(F.struct("y", "x")).alias("first"))
    return g.withColumn("spot", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).select(key, "spot", "n", "x1", "y1", "x2", "y2")
