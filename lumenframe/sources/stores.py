"""Stores of rows in the shared folder: by label, by key, and signatures appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task writes to a folder.
FOLDER_ROWS = 500_000


def write_by(rows: DataFrame, path: str, *keys: str) -> None:
    """One folder for each value of the keys; rows of one folder meet in few tasks first, so that there are few files. A folder's task gets ``FOLDER_ROWS`` rows or so, however many it has."""
    parts = rows.select(F.ceil(F.count("*") / FOLDER_ROWS)).first()[0] or 1
    salt = [F.pmod(F.xxhash64(*rows.columns), F.lit(parts))] if parts > 1 else []
    rows.repartition(*keys, *salt).write.mode("append").partitionBy(*keys).parquet(path)


def read_by(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class KeyValueStore:
    """Ordered (key, value) rows in batches: a later batch wins; a null value deletes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.batch = spark, path, 0

    def put(self, rows: DataFrame) -> None:
        """One transaction: a folder that is complete or absent. Rows are range-sorted, so that a scan prunes by their bounds."""
        self.batch += 1
        rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.path}/batch={self.batch}")

    def scan(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """key, value from first to last, inclusive; unordered, as a table is."""
        t = self.spark.read.parquet(self.path)
        if first is not None:
            t = t.where(F.col("key") >= first)
        if last is not None:
            t = t.where(F.col("key") <= last)
        g = t.groupBy("key").agg(F.max_by(F.struct("value"), "batch").alias("v"))
        return g.select("key", "v.value").where("value IS NOT NULL")

    def get(self, key: str) -> DataFrame:
        return self.scan(key, key)


def append_signatures(rows: DataFrame, path: str) -> None:
    """(class_id, code, id, feat) to the store, one folder for each class."""
    write_by(rows.select("class_id", "code", "id", "feat"), path, "class_id")


def new_signatures(rows: DataFrame, stored: DataFrame | None, partial: int = 2, total: int = 8) -> DataFrame:
    """Insert if new: the rows (class_id, code, id, feat) that resemble neither a stored row of their class and code nor an earlier row, in order of id, that is itself inserted."""
    from lumenframe.operators.signatures import left_out, near_pairs

    keys = ["class_id", "code"]
    fresh = rows
    if stored is not None:
        fresh = rows.join(near_pairs(rows, stored, keys, partial, total).select(*keys, "id").distinct(), [*keys, "id"], "left_anti")
    return fresh.join(left_out(near_pairs(fresh, None, keys, partial, total), keys), [*keys, "id"], "left_anti")
