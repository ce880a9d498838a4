"""The repair of face detections from parts of faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.matching import BOX, pairs, without_overlap, with_support
from lumenframe.operators.ranking import with_default
from lumenframe.operators.windows import HALF, searched


def lone_parts(faces: DataFrame, parts: DataFrame, apart: float = 0.1, together: float = 0.005) -> DataFrame:
    """Parts that no whole face overlaps, and that another such part overlaps."""
    free = without_overlap(parts, faces, apart, "eval")
    return with_support(free, free, together)


def repaired(rows: DataFrame, face: str = "face", half: str = "half", parts: tuple[str, ...] = ("eye", "mouth", "nose"), low: float = 0.3, high: float = 0.7, width: int = 640, height: int = 480, pixels: DataFrame | None = None) -> DataFrame:
    """image_id, kind, label, score and box: strong faces, weak faces that two parts confirm, and faces made from parts, else from halves.

    A face made from parts is the rectangle around the lone parts of its image with the best of their scores; with grey pixels
    (image_id, x, y, v) at hand a half face is widened to where the grey levels change. Images without any face get a row that covers them.
    """
    rows = rows.where(F.col("score") >= low)
    cols = ["image_id", "kind", "label", "score", *BOX]
    faces, pieces = rows.where(F.col("label") == face), rows.where(F.col("label").isin(*parts))
    lone = lone_parts(faces, pieces)
    made = lone.groupBy("image_id").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).where("n >= 2")
    made = made.withColumns({"kind": F.lit("parts"), "label": F.lit(face)}).select(*cols)
    halves = without_overlap(rows.where(F.col("label") == half), faces, 0.3, "eval").join(made.select("image_id"), "image_id", "left_anti")
    if pixels is not None:
        wide = searched(halves.select("image_id", "ord", F.lit(HALF).alias("kind"), *BOX), pixels, "v", (width, height), "image_id")
        halves = halves.drop(*BOX).join(wide.drop("kind"), ["image_id", "ord"])
    halves = halves.withColumns({"kind": F.lit("half"), "label": F.lit(face)}).select(*cols)
    strong = faces.where(F.col("score") >= high).withColumn("kind", F.lit("strong")).select(*cols)
    weak = faces.where(F.col("score") < high)
    near = pairs(weak, pieces, "eval").where("iou >= 0.05").groupBy("image_id", F.col("a_ord").alias("ord")).agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    weak = weak.join(near, ["image_id", "ord"], "left_semi").withColumn("kind", F.lit("weak")).select(*cols)
    found = made.unionByName(halves).unionByName(strong).unionByName(weak)
    out = with_default(found, rows.select("image_id").distinct(), width, height, "other")
    return out.withColumn("kind", F.coalesce("kind", F.lit("none"))).select(*cols)
