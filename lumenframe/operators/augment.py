"""Boxes made from boxes: jitters, negative patches, landmarks and rotated corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import boxes as B


def jittered(b: DataFrame, width: int, height: int) -> DataFrame:
    """Each sane box with one side moved outwards by 1 to 12 fortieths of its length, as far as it stays in the image."""
    s = b.where(B.sane(width, height))
    # Distances depend on k alone, so they are worked out before the sides multiply the rows.
    j = s.select("image_id", "ord", *B.SIDES, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k"))
    j = j.withColumns({"bw": F.expr("CAST(floor((x2 - x1) * k * 25 / 1000.0D + 0.5D) AS INT)"), "bh": F.expr("CAST(floor((y2 - y1) * k * 25 / 1000.0D + 0.5D) AS INT)")})
    j = j.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(3))))
    move = lambda c, side, by, sign: (F.col(c) + sign * F.when(F.col("side") == side, F.col(by)).otherwise(0)).alias(c)
    ok = F.expr(f"CASE side WHEN 0 THEN x1 - bw > 1 WHEN 1 THEN y1 - bh > 1 WHEN 2 THEN x2 + bw < {width - 1} ELSE y2 + bh < {height - 1} END")
    return j.where(ok).select("image_id", "ord", "k", "side", move("x1", 0, "bw", -1), move("y1", 1, "bh", -1), move("x2", 2, "bw", 1), move("y2", 3, "bh", 1))


def grown(b: DataFrame, width: int, height: int, steps: int = 2) -> DataFrame:
    """Each sane box with all sides moved outwards by 1 to ``steps`` times 7.5 % of its length, as far as all stay in the image."""
    j = b.where(B.sane(width, height)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    j = j.withColumns({"bw": F.expr("CAST(floor((x2 - x1) * k * 75 / 1000.0D + 0.5D) AS INT)"), "bh": F.expr("CAST(floor((y2 - y1) * k * 75 / 1000.0D + 0.5D) AS INT)")})
    j = j.where(f"x1 - bw > 1 AND y1 - bh > 1 AND x2 + bw < {width - 1} AND y2 + bh < {height - 1}")
    return j.select("image_id", "ord", "k", *(F.expr(f"{c} {sign} {by}").alias(c) for c, sign, by in (("x1", "-", "bw"), ("y1", "-", "bh"), ("x2", "+", "bw"), ("y2", "+", "bh"))))


def patches(b: DataFrame, width: int, height: int) -> DataFrame:
    """Four neighbours of the largest box of each image that share a fifth of it, as far as they lie in the image."""
    top = b.groupBy("image_id").agg(F.max(F.struct(((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("a"), (-F.col("ord")).alias("neg"), *B.SIDES)).alias("m")).select("image_id", *(f"m.{c}" for c in B.SIDES))
    e = top.withColumns({"w": F.expr("x2 - x1"), "h": F.expr("y2 - y1")})
    far = {"up": "y1 - h * 8 / 10.0D", "down": "y2 + h * 8 / 10.0D", "le": "x1 - w * 8 / 10.0D", "ri": "x2 + w * 8 / 10.0D"}
    e = e.withColumns({k: F.expr(f"CAST({v} AS INT)") for k, v in far.items()})
    one = lambda name, ok, *c: F.when(F.expr(ok), F.struct(F.lit(name).alias("side"), *(F.expr(x).alias(k) for x, k in zip(c, B.SIDES, strict=True))))
    all_ = F.array(one("up", "up > 0", "x1", "up", "x2", "up + h"), one("down", f"down < {height}", "x1", "down - h", "x2", "down"), one("left", "le > 0", "le", "y1", "le + w", "y2"), one("right", f"ri < {width}", "ri - w", "y1", "ri", "y2"))
    return e.select("image_id", F.explode(F.array_compact(all_)).alias("p")).select("image_id", "p.*")


def landmark_points(feature: Column) -> Column:
    """Ten coordinates, x and y in turn, from a network's ten numbers and the corners and size of a face."""
    return F.transform(F.slice(feature, 1, 10), lambda f, i: F.when(i % 2 == 1, F.col("y1") + F.floor((f + 0.5) * (F.col("y2") - F.col("y1")) + 0.5)).otherwise(F.col("x1") + F.floor((f + 0.5) * (F.col("x2") - F.col("x1")) + 0.5)).cast("int"))


def eye_angle(points: Column) -> Column:
    """Degrees of the line through the eyes; a vertical one has 90 with the sign of its height, one point has 0."""
    w, h = points[2] - points[0], points[1] - points[3]
    return F.when(w != 0, F.degrees(F.atan(h.cast("double") / F.nullif(w, F.lit(0))))).otherwise(90.0 * F.signum(h.cast("double")))


def rotated_corners(angle: Column) -> dict[str, Column]:
    """Four corners of a box turned by degrees about its centre, which is rounded to pixels."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cx, cy = F.floor(F.col("x1") + w * 0.5 + 0.5), F.floor(F.col("y1") + h * 0.5 + 0.5)
    a, b = F.cos(F.radians(angle)) * 0.5, F.sin(F.radians(angle)) * 0.5
    p0x, p0y, p1x, p1y = cx - a * w - b * h, cy + b * w - a * h, cx + a * w - b * h, cy - b * w - a * h
    return {"p0x": p0x, "p0y": p0y, "p1x": p1x, "p1y": p1y, "p2x": 2 * cx - p0x, "p2y": 2 * cy - p0y, "p3x": 2 * cx - p1x, "p3y": 2 * cy - p1y}


def resized(width: str, height: str, longest: int) -> dict[str, Column]:
    """Size and ratio of an image whose longer side is brought down to ``longest``; smaller images stay."""
    ratio = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return {"ratio": ratio, "new_width": F.floor(F.col(width) * ratio + 0.5).cast("int"), "new_height": F.floor(F.col(height) * ratio + 0.5).cast("int")}
