"""Joins of boxes with boxes. All first meet on the image, so no pair across images is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.boxes import iou

BOX = ("x1", "y1", "x2", "y2")


def renamed(boxes: DataFrame, prefix: str, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return boxes.select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in boxes.columns if c not in keys))


def pairs(a: DataFrame, b: DataFrame, mode: str, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """All pairs within the keys, with columns a_*, b_* and iou."""
    return renamed(a, "a_", keys).join(renamed(b, "b_", keys), list(keys)).withColumn("iou", iou("a_", "b_", mode))


def best_truth(pred: DataFrame, truth: DataFrame, mode: str = "eval") -> DataFrame:
    """For each prediction the truth of its image with the largest overlap, the first of equals."""
    p = pairs(pred, truth, mode)
    best = p.groupBy("image_id", "a_ord").agg(F.min(F.struct((-F.col("iou")).alias("neg"), F.col("b_ord").alias("truth"))).alias("m"))
    return best.select("image_id", F.col("a_ord").alias("ord"), F.col("m.truth").alias("truth_ord"), (-F.col("m.neg")).alias("iou"))


def without_overlap(rows: DataFrame, others: DataFrame, least: float, mode: str = "augment") -> DataFrame:
    """Rows that no other box of the image overlaps by ``least`` or more."""
    hit = pairs(rows, others, mode).where(F.col("iou") >= least).select("image_id", F.col("a_ord").alias("ord")).distinct()
    return rows.join(hit, ["image_id", "ord"], "left_anti")


def with_support(rows: DataFrame, others: DataFrame, least: float, times: int = 1, mode: str = "eval") -> DataFrame:
    """Rows that at least ``times`` other boxes of the image, themselves excepted, overlap by ``least`` or more."""
    p = pairs(rows, others, mode).where((F.col("iou") >= least) & (F.col("a_ord") != F.col("b_ord")))
    hit = p.groupBy("image_id", F.col("a_ord").alias("ord")).agg(F.count("*").alias("n")).where(F.col("n") >= times).drop("n")
    return rows.join(hit, ["image_id", "ord"], "left_semi")


def recall_curve(ranked: DataFrame, truth: DataFrame, steps: list[int], least: float = 0.5, mode: str = "eval", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of truths found, and mean best overlap, by the first k proposals of each image (column rank)."""
    p = pairs(ranked.where(F.col("rank") <= max(steps)), truth, mode)
    best = p.groupBy("image_id", "b_ord").agg(*(F.max(F.when(F.col("a_rank") <= k, F.col("iou"))).alias(f"k{k}") for k in steps))
    t = truth.select("image_id", F.col("ord").alias("b_ord"), *by).join(best, ["image_id", "b_ord"], "left")
    long = t.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"k{k}", F.lit(0.0)).alias("best")) for k in steps))).alias("s")).select(*by, "s.*")
    return long.groupBy(*by, "k").agg(F.avg(F.when(F.col("best") >= least, 1.0).otherwise(0.0)).alias("recall"), F.avg("best").alias("mean_best"), F.count("*").alias("n_truth"))


def cooccurrence(rows: DataFrame, cluster: str, item: str) -> DataFrame:
    """How many clusters hold two items together, for each pair i < j; counted over the distinct members of a cluster."""
    d = rows.select(cluster, item).distinct()
    other = d.withColumnRenamed(item, "j")
    return d.withColumnRenamed(item, "i").join(other, cluster).where("i < j").groupBy("i", "j").agg(F.count("*").alias("n"))


def anti_first(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "ord")
    return rows.withColumn("rank", F.row_number().over(w))
