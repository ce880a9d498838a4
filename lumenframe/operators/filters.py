"""Row and group filters over detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_images(images: DataFrame, least: int = 32) -> DataFrame:
    """Decoded images of three channels of eight bits and at least ``least`` pixels a side."""
    return images.where((F.col("width") >= least) & (F.col("height") >= least) & (F.col("channels") == 3) & (F.col("depth") == 8))


def decoded_images(images: DataFrame) -> DataFrame:
    """origin, width, height, channels and depth of Spark's image source; images that can't be decoded are dropped."""
    i = F.col("image")
    # The modes of one, three and four channels of eight bits.
    depth = F.when(i["mode"].isin(0, 16, 24), 8).otherwise(0)
    return images.where(i.isNotNull() & (i["height"] > 0)).select(i["origin"].alias("origin"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), depth.alias("depth"))


def reject_groups(rows: DataFrame, key: str, listed: Column, banned: Column, share: float = 0.4) -> DataFrame:
    """Rows of the groups in which at most a share is listed and nothing is banned."""
    bad = rows.groupBy(key).agg(F.count_if(listed).alias("listed"), F.count_if(banned).alias("banned"), F.count("*").alias("n"))
    return rows.join(bad.where((F.col("banned") > 0) | (F.col("listed") > share * F.col("n"))).select(key), key, "left_anti")


def all_or_nothing(rows: DataFrame, mapping: DataFrame, key: str, label: str) -> DataFrame:
    """Rows with mapped labels (mapping: label, mapped) of the groups whose labels are all mapped."""
    x = rows.join(mapping, label, "left")
    missing = x.where("mapped IS NULL").select(key).distinct()
    return x.join(missing, key, "left_anti")


def proposals(boxes: DataFrame, width: int, height: int, share: float = 0.2, least: int = 32, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Boxes that are, after clipping, no smaller than a share of the image and neither too flat nor too tall."""
    from lumenframe.functions.boxes import clamped

    side = max(int(share * min(width, height)), least)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.withColumns(clamped(width, height)).where((w >= side) & (h >= side) & (w >= low * h) & (w <= high * h))


def detector_output(boxes: DataFrame, width: int, height: int, most: int, confidence: float = 0.2, share: float = 0.1, least: int = 32) -> DataFrame:
    """The ``most`` best boxes of each image with some confidence, of plausible size and shape after clipping; adds rank."""
    from lumenframe.operators.ranking import top

    return top(proposals(boxes.where(F.col("score") >= confidence), width, height, share, least, 0.125, 8.0), most)


def steady_groups(rows: DataFrame, key: str, value: str, order: str | None = None, most: float = 0.5) -> DataFrame:
    """Groups whose coefficient of variation, with the population's deviation, is at most ``most``.

    Without an order the two sides are compared by the sums of values and of their squares. Those of whole numbers don't round (while the
    squares' sum times the count is below 2^53), so neither does the verdict where the sides are equal. With an order, for values that are
    not whole, deviations are added in it: verdicts at the limit then depend on rounding, but not on how rows arrive.
    """
    x = F.col(value).cast("double")
    if order is None:
        g = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(x).alias("sd"), F.count("*").alias("n"), F.count(x).alias("c"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
        return g.where((F.col("s") >= 0) & (F.col("c") * F.col("q") <= (1 + most * most) * F.col("s") * F.col("s"))).drop("c", "s", "q")
    own = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(F.col(order).alias("ord"), x.alias("x")))))
    g = rows.groupBy(key).agg(F.avg(value).alias("mean"), own.alias("own"), F.count("*").alias("n"))
    near = "(s.mean + (e.x - s.mean) / (s.n + 1))"
    spread = F.expr(f"aggregate(own, named_struct('n', 0D, 'mean', 0D, 'sum', 0D), (s, e) -> named_struct('n', s.n + 1, 'mean', {near}, 'sum', s.sum + (e.x - {near}) * (e.x - s.mean)), s -> sqrt(s.sum / nullif(s.n, 0D)))")
    return g.select(key, "mean", spread.alias("sd"), "n").where(F.col("sd") <= most * F.col("mean"))


def single_object(rows: DataFrame, key: str, width: int, height: int, least: int = 64, share: float = 0.3) -> DataFrame:
    """The boxes that are alone in their image and large in it."""
    one = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("label_id", "x1", "y1", "x2", "y2"))).where("n = 1").drop("n")
    return one.where((F.col("x2") - F.col("x1") >= max(least, share * width)) & (F.col("y2") - F.col("y1") >= max(least, share * height)))
