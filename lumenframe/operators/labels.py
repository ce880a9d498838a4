"""Label maps, merges with score ranges, cascades and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The twenty public VOC names and the taxonomy names they stand for.
VOC = {
    "aeroplane": "vehicle.airplane", "bicycle": "vehicle.bicycle", "bird": "animal.bird", "boat": "vehicle.boat", "bottle": "goods.bottle",
    "bus": "vehicle.bus", "car": "vehicle.car", "cat": "animal.cat", "chair": "furniture.chair", "cow": "animal.cow",
    "diningtable": "furniture.table", "dog": "animal.dog", "horse": "animal.horse", "motorbike": "vehicle.motorbike", "person": "person.body",
    "pottedplant": "furniture.pottedplant", "sheep": "animal.sheep", "sofa": "furniture.sofa", "train": "vehicle.train", "tvmonitor": "electronics.monitor",
}

# Label repairs on reading annotations; None drops the row.
REPAIRS = {"furniture.diningtable": "furniture.table", "None": "other.other", "cat": "animal.cat", "dog": "animal.dog", "person.other": None}

# Coarse class of each of the 73 fine classes, 0 for other.
MERGED_73 = [1, 8, 2, 0, 8, 3, 8, 8, 8, 4, 0, 5, 6, 8, 8, 8, 8, 7, 19, 9, 15, 19, 15, 0, 19, 10, 11, 0, 12, 13, 0, 0, 0, 11, 16, 15, 0, 0, 15, 19, 18, 0, 17, 25, 20, 14, 21, 25, 22, 23, 24, 28, 26, 27, 28, 0, 33, 33, 33, 29, 0, 0, 33, 33, 33, 30, 31, 34, 32, 33, 33, 35, 36]
# Least score by fine class, as (first class, last class, least score, whether equality is enough).
RANGES_73 = [(0, 8, 0.7, True), (9, 9, 0.6, True), (10, 27, 0.7, True), (28, 28, 0.5, True), (29, 39, 0.7, True), (40, 40, 0.8, True), (41, 42, 0.7, True), (43, 47, 0.6, True), (48, 50, 0.6, False), (51, 70, 0.7, True), (71, 71, 0.6, True), (72, 72, 0.7, True)]


# Of the 90-class model, the class that each stands for (55 is other) and its least score.
MERGED_90 = [0, 55, 2, 55, 4, 5, 55, 7, 8, 9, 10, 11, 12, 13, 14, 15, 55, 55, 18, 19, 20, 21, 22, 55, 55, 25, 55, 27, 28, 29, 30, 55, 32, 33, 34, 35, 55, 55, 38, 55, 40, 55, 42, 55, 55, 45, 46, 47, 55, 55, 50, 55, 55, 53, 54, 55, 55, 57, 55, 59, 55, 61, 55, 63, 64, 65, 66, 67, 55, 69, 70, 71, 55, 73, 74, 55, 55, 55, 55, 79, 55, 55, 55, 55, 84, 85, 55, 87, 88, 89]
LEAST_90 = [0.91, 0.91, 0.91, 1.0, 0.95, 0.8, 1.0, 0.96, 0.95, 0.8, 0.95, 0.95, 0.93, 0.97, 0.92, 0.96, 1.0, 1.0, 0.99, 0.8, 1.0, 0.9, 0.8, 1.0, 1.0, 0.9, 1.0, 0.92, 0.9, 0.9, 0.9, 0.9, 0.92, 0.9, 0.9, 0.94, 1.0, 0.8, 0.9, 1.0, 0.9, 1.0, 0.9, 0.9, 1.0, 0.9, 0.7, 0.9, 1.0, 1.0, 0.93, 1.0, 1.0, 0.9, 0.94, 1.0, 0.8, 0.93, 0.8, 0.85, 0.9, 0.93, 0.9, 0.9, 0.8, 0.95, 0.9, 0.9, 1.0, 0.9, 0.9, 0.85, 1.0, 0.8, 0.9, 1.0, 1.0, 1.0, 1.0, 0.94, 1.0, 1.0, 1.0, 1.0, 0.8, 0.97, 0.93, 0.85, 0.93, 0.92]
# The same for six coarse classes: food, goods, other, people, pet, scene.
MERGED_6, LEAST_6 = [9, 55, 55, 63, 73, 84], [0.91, 0.8, 0.8, 0.66, 0.94, 0.85]
# Model of the quality of each of 37 classes: other, food, scene, street, pet, goods, people; -1 for none. Classes from the 35th on are not judged.
QUALITY_MODEL = [0, 1, 1, 1, 1, 1, 1, 1, 1, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 6, 6, 6, 6, 3, 6, 4, 4, 4, 2, 2, 2, 2, 2, -1, -1, -1]


def label_map(spark: SparkSession, pairs: dict[str, str | None] | None = None) -> DataFrame:
    """label, mapped: a fixed dictionary of bounded size."""
    return spark.createDataFrame(list((pairs or VOC).items()), "label string, mapped string")


def mapped_inner(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Spark broadcasts the mapping if its size allows."""
    return rows.join(mapping, "label").drop("label").withColumnRenamed("mapped", "label")


def mapped_keep(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    return rows.join(mapping, "label", "left").withColumn("label", F.coalesce("mapped", "label")).drop("mapped")


def repaired(rows: DataFrame, repairs: dict[str, str | None] = REPAIRS) -> DataFrame:
    """Rows with repaired labels; labels that map to None go, labels not named stay."""
    label = F.col("label")
    for old, new in repairs.items():
        if new is not None:
            label = F.when(F.col("label") == old, new).otherwise(label)
    gone = [k for k, v in repairs.items() if v is None]
    return rows.where(~F.col("label").isin(gone)).withColumn("label", label)


def merged_with_ranges(rows: DataFrame, spark: SparkSession, merged: list[int] = MERGED_73, ranges: list[tuple] = RANGES_73) -> DataFrame:
    """Adds coarse, the coarse class of fine where score reaches the least of its range, else 0."""
    table = [(k, merged[k], low, eq) for a, b, low, eq in ranges for k in range(a, b + 1)]
    t = spark.createDataFrame(table, "fine int, to int, low double, eq boolean")
    ok = (F.col("score") > F.col("low")) | (F.col("eq") & (F.col("score") == F.col("low")))
    return rows.join(F.broadcast(t), "fine", "left").withColumn("coarse", F.when(ok, F.col("to")).otherwise(0)).drop("to", "low", "eq")


def cascade(first: DataFrame, fallback: DataFrame, key: str, other: int = 0) -> DataFrame:
    """coarse of first, or of fallback where first says other."""
    b = fallback.select(key, F.col("coarse").alias("second"))
    return first.join(b, key, "left").withColumn("coarse", F.when(F.col("coarse") == other, F.coalesce("second", F.lit(other))).otherwise(F.col("coarse"))).drop("second")


def checked_dictionary(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: an empty result means that the dictionary may be joined."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merged_with_least(rows: DataFrame, merged: list[int], least: list[float], other: int, small: int, side: int = 64) -> DataFrame:
    """Adds coarse, what fine stands for where score reaches its least, else other; the class ``small`` counts as other on boxes with a side below ``side``."""
    tiny = (F.col("fine") == small) & ((F.col("x2") - F.col("x1") < side) | (F.col("y2") - F.col("y1") < side))
    at = F.when(tiny, F.lit(merged.index(other))).otherwise(F.col("fine")).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at + 1)
    return rows.withColumn("coarse", F.when(F.col("score") >= pick(least), pick(merged)).otherwise(other))


def quality_verdict(rows: DataFrame) -> DataFrame:
    """Adds model, quality and quality_score: the verdict of the model that class37 leads to (quality_label, quality_raw), which a blur model (blur_label, blur_raw) overrules where it is sure of good quality."""
    model = F.element_at(F.array(*map(F.lit, QUALITY_MODEL)), F.col("class37") + 1)
    rows = rows.withColumn("model", model)
    label, score = F.when(F.col("model") >= 0, F.col("quality_label")).otherwise(1), F.when(F.col("model") >= 0, F.col("quality_raw")).otherwise(2.0)
    asked = (F.col("model") >= 0) & (F.col("quality_label") == 2) & (F.col("quality_raw") >= 0.8)
    good = (F.col("blur_label") == 2) & (F.col("blur_raw") >= 0.9)
    judged = F.col("class37") < 34
    quality = F.when(~judged, 1).when(asked, F.when(good, 2).otherwise(0)).otherwise(label)
    points = F.when(~judged, 2.0).when(asked, F.when(good, F.col("blur_raw")).otherwise(2.0)).otherwise(score)
    return rows.withColumn("quality", quality).withColumn("quality_score", points)
