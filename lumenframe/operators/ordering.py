"""Operators for which the order of rows is data, without bringing a table into one partition.

The table is range-partitioned by the whole key and written once with each row's place in its part, so equal
first keys are split too and ranges do not depend on a second run. What crosses a part (its size, its last row)
is one row each; all else is done part by part. The result does not depend on where the cuts fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import written

#: Rows of a part.
PART = 2_000_000
_PLACE = (1 << 33) - 1


def placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds part, which grows with the keys, and place, from 0 within its part."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART))
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.monotonically_increasing_id())
    return written(s.select(*df.columns, F.shiftright("part", 33).alias("part"), F.col("part").bitwiseAND(F.lit(_PLACE)).alias("place")), "placed")


def row_numbers(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Numbers the rows from 1 in the order of keys, and adds their total."""
    b = placed(df, keys)
    sizes = b.groupBy("part").agg(F.count("*").alias("size"))
    w = Window.orderBy("part")
    before = sizes.select("part", (F.sum("size").over(w) - F.col("size")).alias("before"), F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    return b.join(F.broadcast(before), "part").withColumn(name, F.col("place") + 1 + F.col("before")).drop("part", "place", "before")


def first_of_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    b = placed(df, keys)
    last = b.groupBy("part").agg(F.max_by(value, "place").alias("last"))
    before = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    w = Window.partitionBy("part").orderBy("place")
    x = b.join(F.broadcast(before), "part").withColumn("prev", F.when(F.col("place") == 0, F.col("before")).otherwise(F.lag(value).over(w)))
    return x.where(~F.col("prev").eqNullSafe(F.col(value))).drop("part", "place", "before", "prev")


def every_tenth(numbered: DataFrame, extra: Column | None = None) -> DataFrame:
    """split: test for every tenth row (counted from 1 in n), if the extra condition holds."""
    test = F.col("n") % 10 == 0
    return numbered.withColumn("split", F.when(test if extra is None else test & extra, "test").otherwise("train"))


def prefix_split(numbered: DataFrame, share: float = 0.1) -> DataFrame:
    """split: the first share of the rows is val, the next test, the rest train; shares are rounded half up."""
    k = F.floor(F.col("total") * share + 0.5)
    return numbered.withColumn("split", F.when(F.col("n") <= k, "val").when(F.col("n") <= 2 * k, "test").otherwise("train"))


def first_per_label(df: DataFrame, label: str, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each label, in the order of keys."""
    w = Window.partitionBy(label).orderBy(*keys)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def shuffled_rank(df: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """A fixed pseudo-random order in place of a random one: sort key from the contents and a seed."""
    return df.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))))


def quota_sample(rows: DataFrame, order: list[str], labels: str, scores: str, most: int, least: float = 0.8, n_labels: int | None = None) -> DataFrame:
    """The keys of the rows that the quota scan over arrays of labels and scores keeps.

    The scan reads rows in order; a row goes if every one of its labels is over quota, otherwise its labels
    with a score of at least ``least`` count; it ends once n_labels labels are full. As long as a label
    is not full, every row that holds it is kept, so it is full right after the row with its ``most``-th
    such score. That row is found by rank, of which no task needs more than ``most`` rows for a label, and a row is kept if
    it holds a label that is not full before it.
    """
    key = F.struct(*order)
    o = rows.select(*order, F.posexplode(F.arrays_zip(F.col(labels).alias("own_label"), F.col(scores).alias("own_score"))).alias("k", "o"))
    o = o.select(*order, "k", F.col("o")["own_label"].alias("own_label"), F.col("o")["own_score"].alias("own_score"))
    w = Window.partitionBy("own_label").orderBy(*order, "k")
    full = o.where(F.col("own_score") >= least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    full = full.where(F.col("r") == most).select("own_label", key.alias("till"))
    kept = o.join(full, "own_label", "left").where(F.col("till").isNull() | (key <= F.col("till"))).select(*order).distinct()
    if n_labels is None:
        return kept
    end = full.withColumn("k", F.row_number().over(Window.orderBy("till"))).where(F.col("k") == n_labels).agg(F.max("till").alias("till"))
    return kept.crossJoin(F.broadcast(end)).where(F.col("till").isNull() | (key <= F.col("till"))).drop("till")


def capped_single(objects: DataFrame, image: str, label: str, most: int, n_labels: int | None = None) -> DataFrame:
    """Images of a scan that counts the objects of each label and skips an image of one distinct label whose count has passed ``most``.

    Images with several labels are always kept and count. The scan ends once n_labels labels have passed. No task needs
    more than most + 1 images for a label: each holds at least one object.
    """
    per = objects.groupBy(image, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(label).orderBy(image)
    early = per.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most + 1)
    passed = early.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") > most).groupBy(label).agg(F.min(image).alias("till"))
    kinds = per.groupBy(image).agg(F.count("*").alias("kinds"), F.min(label).alias(label))
    kept = kinds.join(passed, label, "left").where((F.col("kinds") > 1) | F.col("till").isNull() | (F.col(image) <= F.col("till"))).select(image, "kinds")
    if n_labels is None:
        return kept
    end = passed.withColumn("k", F.row_number().over(Window.orderBy("till"))).where(F.col("k") == n_labels).agg(F.max("till").alias("till"))
    return kept.crossJoin(F.broadcast(end)).where(F.col("till").isNull() | (F.col(image) <= F.col("till"))).drop("till")
