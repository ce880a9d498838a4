"""Best rows, top-k rows and default rows of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_per_label(rows: DataFrame, keys: tuple[str, ...] = ("image_id", "label")) -> DataFrame:
    """The row with the highest score, then the lowest ord, of each group; an aggregation without a sort of groups."""
    other = [c for c in rows.columns if c not in keys]
    rest = [c for c in other if c not in ("score", "ord")]
    best = rows.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("neg"), "ord", *rest)).alias("m"))
    return best.select(*keys, (-F.col("m.neg")).alias("score"), "m.ord", *(f"m.{c}" for c in rest))


def top(rows: DataFrame, k: int, key: str = "image_id") -> DataFrame:
    """The k rows of each group with the highest scores; adds rank."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def largest(rows: DataFrame, key: str = "image_id") -> DataFrame:
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return rows.groupBy(key).agg(F.max_by("ord", F.struct(area, -F.col("ord"))).alias("ord"), F.max(area).alias("area"))


def with_default(rows: DataFrame, images: DataFrame, width: int, height: int, label: str = "other.other") -> DataFrame:
    """Adds a row that covers the image, with score 0, for images without any row."""
    fill = {"label": F.lit(label), "score": F.lit(0.0), "x1": F.lit(0), "y1": F.lit(0), "x2": F.lit(width - 1), "y2": F.lit(height - 1)}
    x = images.select("image_id").join(rows, "image_id", "left")
    return x.withColumns({c: F.coalesce(c, v) for c, v in fill.items()})


def representatives(rows: DataFrame, key: str, cluster: str, order: str, score: str, n: int) -> DataFrame:
    """key, cluster, first (least order) and best (highest score, then least order) of clusters 0 to n - 1; an empty cluster gives the last of its group."""
    own = rows.groupBy(key, cluster).agg(F.min(order).alias("first"), F.max(F.struct(F.col(score), (-F.col(order)).alias("neg"))).alias("m"))
    last = rows.groupBy(key).agg(F.max(order).alias("last")).withColumn(cluster, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = last.join(own, [key, cluster], "left")
    return x.select(key, cluster, F.coalesce("first", "last").alias("first"), F.coalesce(-F.col("m.neg"), F.col("last")).alias("best"))
