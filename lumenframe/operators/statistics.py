"""Dataset statistics and evaluation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_shares(rows: DataFrame, key: str = "image_id", label: str = "label") -> DataFrame:
    """label, n, share of all rows, n_total, labels_per_image: one aggregation by label and totals of bounded size."""
    by = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("n_total"), F.count_distinct(key).alias("n_images"))
    x = by.crossJoin(F.broadcast(total))
    return x.select(label, "n", F.round(F.col("n") / F.col("n_total"), 4).alias("share"), "n_total", "n_images", F.round(F.col("n_total") / F.col("n_images"), 4).alias("labels_per_image"))


def confusion(rows: DataFrame, truth: Column, guess: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn, recall and precision."""
    g = rows.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn")
    )
    zero = F.lit(0)
    return g.withColumn("recall", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), zero), 6)).withColumn("precision", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), zero), 6))


def group_features(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Mean, population deviation and their ratio of each value."""
    aggs = []
    for v in values:
        mean, sd = F.avg(v), F.stddev_pop(v)
        aggs += [F.round(mean, 6).alias(f"{v}_mean"), F.round(sd, 6).alias(f"{v}_sd"), F.round(sd / F.nullif(mean, F.lit(0.0)), 6).alias(f"{v}_cv")]
    return rows.groupBy(key).agg(*aggs)


def variance_cut(values: DataFrame, ordered: str, value: str, share: float = 0.9, most: int = 1000) -> DataFrame:
    """k: how many of the largest values, at most ``most``, are needed for more than a share of their sum."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc(value), ordered)
    x = values.select(F.row_number().over(w).alias("k"), F.sum(value).over(w).alias("upto"), F.sum(value).over(Window.partitionBy(F.lit(1))).alias("all"))
    return x.agg(F.least(F.coalesce(F.min(F.when(F.col("upto") > share * F.col("all"), F.col("k"))), F.lit(most)), F.lit(most)).alias("k"))
