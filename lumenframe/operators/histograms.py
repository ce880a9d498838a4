"""Histograms of pixel values and what follows from them; pixels are rows, so all are plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """key, bin, n, p."""
    h = pixels.groupBy(key, F.col(value).alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def entropy(hist: DataFrame, key: str) -> DataFrame:
    return hist.groupBy(key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def equalised(hist: DataFrame, key: str, top: int = 255) -> DataFrame:
    """key, bin, level: the cumulative share of each bin, scaled and rounded half up."""
    w = Window.partitionBy(key).orderBy("bin")
    all_ = Window.partitionBy(key)
    return hist.select(key, "bin", F.floor(top * F.sum("n").over(w) / F.sum("n").over(all_) + 0.5).cast("long").alias("level"))


def otsu(hist: DataFrame, key: str) -> DataFrame:
    """key, threshold: the bin that maximises the variance between the classes, the lowest of equals."""
    w, all_ = Window.partitionBy(key).orderBy("bin"), Window.partitionBy(key)
    x = hist.select(key, "bin", F.sum("n").over(w).alias("w"), F.sum(F.col("bin") * F.col("n")).over(w).alias("u"), F.sum("n").over(all_).alias("t"), F.sum(F.col("bin") * F.col("n")).over(all_).alias("m"))
    gap = F.col("m").cast("double") * F.col("w") - F.col("u").cast("double") * F.col("t")
    x = x.where("w < t").withColumn("v", gap * gap / (F.col("w").cast("double") * (F.col("t") - F.col("w"))))
    return x.groupBy(key).agg(F.min(F.struct((-F.round("v", 3)).alias("neg"), "bin")).alias("m")).select(key, F.col("m.bin").alias("threshold"))


def contrast(hist: DataFrame, key: str, cut: int = 200) -> DataFrame:
    """key, bin, saliency (0 to 255 by the least and greatest distance), salient: distance of a level to all pixels of its image."""
    other = hist.select(key, F.col("bin").alias("bin_b"), F.col("n").alias("n_b"))
    d = hist.join(other, key).groupBy(key, "bin").agg(F.sum(F.abs(F.col("bin") - F.col("bin_b")) * F.col("n_b")).alias("d"))
    w = Window.partitionBy(key)
    low, high = F.min("d").over(w), F.max("d").over(w)
    s = F.coalesce(255.0 * (F.col("d") - low) / F.nullif(high - low, F.lit(0)), F.lit(0.0))
    return d.select(key, "bin", F.round(s, 6).alias("saliency"), (F.round(s, 6) >= cut).alias("salient"))


def top_bins(pixels: DataFrame, key: str, parts: list[str], k: int = 2) -> DataFrame:
    """The k most frequent combinations of parts, with their shares."""
    h = pixels.groupBy(key, *parts).agg(F.count("*").alias("n"))
    h = h.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(key)), 6))
    w = Window.partitionBy(key).orderBy(F.desc("n"), *parts)
    return h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def widest_channel(pixels: DataFrame, key: str, channels: list[str]) -> DataFrame:
    g = pixels.groupBy(key).agg(*((F.max(c) - F.min(c)).alias(c) for c in channels))
    best = F.array_max(F.array(*(F.struct(F.col(c).alias("range"), F.lit(-i).alias("i"), F.lit(c).alias("channel")) for i, c in enumerate(channels))))
    return g.select(key, best["channel"].alias("channel"), best["range"].alias("range"))


def main_colour(pixels: DataFrame, key: str, width: int = 64, lightness: float = 0.8, fallback: int = 185) -> DataFrame:
    """key, r, g, b: the mean of the fullest bin of colours that is neither too light nor too dark, else a fixed grey.

    The mean of a bin starts with one pixel's worth of 128 that does not count as a pixel.
    """
    b = [F.floor(F.col(c) / width).cast("int").alias(f"{c}_bin") for c in ("r", "g", "b")]
    h = pixels.groupBy(key, *b).agg(F.count("*").alias("n"), *(F.floor((F.sum(c) + 128) / F.count("*")).cast("int").alias(c) for c in ("r", "g", "b")))
    light = (F.col("r") + F.col("g") + F.col("b")) / 3.0 / 255.0
    ok = h.where((light <= lightness) & (light > 0.2))
    best = ok.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), "r_bin", "g_bin", "b_bin", "r", "g", "b")).alias("m"))
    x = pixels.select(key).distinct().join(best, key, "left")
    return x.select(key, *(F.coalesce(F.col(f"m.{c}"), F.lit(fallback)).alias(c) for c in ("r", "g", "b")))


def last_channel_entropy(pixels: DataFrame, key: str, channel: str = "r", blocks: int = 8) -> DataFrame:
    """key, score (0 to 127): entropy of the bins of the last channel, which alone tells the bin, normalised to length one."""
    width = int(256 / blocks + 0.5)
    h = pixels.groupBy(key, F.floor(F.col(channel) / width).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    h = h.withColumn("p", F.col("n") / length)
    e = F.least(-F.sum(F.col("p") * F.log2("p")), F.lit(2.0))
    return h.groupBy(key).agg(F.floor(F.round(e * 63.5, 9) + 0.5).cast("int").alias("score"))


def histogram_distances(hist: DataFrame, key: str) -> DataFrame:
    """a, b, distance of each image and the next: one less the share of their histograms that they have in common."""
    a = hist.select(F.col(key).alias("a"), "bin", F.col("p").alias("pa"))
    b = hist.select((F.col(key) - 1).alias("a"), "bin", F.col("p").alias("pb"))
    both = a.join(b, ["a", "bin"]).groupBy("a").agg(F.sum(F.least("pa", "pb")).alias("common"))
    pairs = hist.select(F.col(key).alias("a")).distinct().join(hist.select((F.col(key) - 1).alias("a")).distinct(), "a")
    return pairs.join(both, "a", "left").select("a", (F.col("a") + 1).alias("b"), (1 - F.coalesce("common", F.lit(0.0)) / (1 + 1e-6)).alias("distance"))
