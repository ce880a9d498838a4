"""Plans over detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.boxes import rescaled
from lumenframe.operators.ranking import best_per_label, top, with_default

# Names of the labels of the derived detections; label 4 is in no dictionary.
NAMES = {0: "person.face", 1: "animal.cat", 2: "vehicle.car", 3: "goods.bottle"}


def dictionary(spark: SparkSession, names: dict[int, str] = NAMES) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "label_id int, label string")


def named(boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """Detections with a score of at least ``least`` and a name."""
    return boxes.where(F.col("score") >= least).join(F.broadcast(dictionary(boxes.sparkSession)), "label_id").drop("label_id")


def detect(raw: DataFrame, width: int, height: int, least: float = 0.5, overlap: float = 0.3, k: int = 100, ratio: float = 1.0) -> DataFrame:
    """The whole plan over raw rows (image_id, ord, scores by class with the background first, deltas, box of the region).

    Best class of each region, threshold, decoded box, suppression within class, names, default row, the k best, and, unless
    the image was not resized, original coordinates.
    """
    from lumenframe.functions.boxes import SIDES, decoded
    from lumenframe.operators.nms import nms

    images = raw.select("image_id").distinct()
    kinds = F.slice("scores", 2, 1_000)
    r = raw.withColumn("score", F.array_max(kinds)).where(F.col("score") >= least).withColumn("label_id", F.array_position(kinds, F.col("score")).cast("int") - 1)
    r = r.select("image_id", "ord", "label_id", "score", *(v.alias(c) for c, v in decoded(width, height).items())).where("x1 < x2 AND y1 < y2")
    rows = top(nms(r, overlap).join(F.broadcast(dictionary(raw.sparkSession)), "label_id").drop("label_id"), k)
    if ratio != 1.0:
        rows = rows.withColumns(rescaled(ratio))
    out = with_default(rows, images, int(width / ratio + 0.5), int(height / ratio + 0.5))
    return out.select("image_id", F.coalesce("rank", F.lit(1)).alias("rank"), "label", "score", *SIDES)


def best_labels(boxes: DataFrame, least: float = 0.95, k: int = 2, ratio: float = 0.5, width: int = 1600, height: int = 1200) -> DataFrame:
    """Threshold, dictionary, best row per label, top k, original coordinates, default row."""
    images = boxes.select("image_id").distinct()
    rows = top(best_per_label(named(boxes, least)), k).withColumns(rescaled(ratio))
    out = with_default(rows, images, width, height)
    return out.select("image_id", F.coalesce("rank", F.lit(1)).alias("rank"), "label", "score", "x1", "y1", "x2", "y2")


def merged_prediction(boxes: DataFrame) -> DataFrame:
    """Best row per label without the label other; of these, the largest box of each image."""
    best = best_per_label(named(boxes).where("label NOT LIKE 'other%'"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    big = best.groupBy("image_id").agg(F.max(F.struct(area.alias("area"), (-F.col("ord")).alias("neg"), "label", "score")).alias("m"))
    return big.select("image_id", (-F.col("m.neg")).alias("ord"), "m.label", "m.score", "m.area")
