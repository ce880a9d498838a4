"""Greedy non-maximum suppression as an ordered fold over the boxes of an image and label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.boxes import iou_sql


def nms(boxes: DataFrame, most: float = 0.3, keys: tuple[str, ...] = ("image_id", "label_id")) -> DataFrame:
    """Boxes, from the highest score and the lowest ord down, that overlap no box kept before by more than ``most``."""
    row = F.struct((-F.col("score")).alias("neg"), "ord", "x1", "y1", "x2", "y2")
    g = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    fold = f"aggregate(rows, slice(rows, 1, 0), (kept, r) -> IF(exists(kept, k -> {iou_sql('k.', 'r.', 'nms')} > {most}D), kept, concat(kept, array(r))))"
    return g.select(*keys, F.explode(F.expr(fold)).alias("r")).select(*keys, F.col("r.ord").alias("ord"), (-F.col("r.neg")).alias("score"), "r.x1", "r.y1", "r.x2", "r.y2")


def spatial_peaks(points: DataFrame, radius: int, most: int) -> DataFrame:
    """For each image the up to ``most`` best points (x, y, score, ord) no two of which lie within radius in both coordinates."""
    row = F.struct((-F.col("score")).alias("neg"), "ord", "x", "y")
    g = points.groupBy("image_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    fold = f"aggregate(rows, slice(rows, 1, 0), (kept, r) -> IF(size(kept) >= {most} OR exists(kept, k -> abs(k.x - r.x) <= {radius} AND abs(k.y - r.y) <= {radius}), kept, concat(kept, array(r))))"
    return g.select("image_id", F.explode(F.expr(fold)).alias("r")).select("image_id", "r.ord", "r.x", "r.y", (-F.col("r.neg")).alias("score"))
