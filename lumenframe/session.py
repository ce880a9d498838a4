"""Tables and the shared folder of a session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOXES_SQL = """boxes AS (
  SELECT CAST(l_partkey AS BIGINT) AS image_id, CAST(l_linenumber % 5 AS INT) AS label_id,
    CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS ord,
    CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS score,
    CAST(l_orderkey % 400 AS INT) AS x1, CAST((l_orderkey * 7 + l_suppkey) % 300 AS INT) AS y1,
    CAST(l_orderkey % 400 + 20 + l_quantity * 4 AS INT) AS x2, CAST((l_orderkey * 7 + l_suppkey) % 300 + 20 + l_quantity * 3 AS INT) AS y2
  FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table for each partition of a shuffle: what a task sorts then doesn't grow with the table.
PART_ROWS = 500_000


#: Bytes, as shuffled, up to which adaptive execution joins partitions. Boxes are packed well there: 64 MB of them were 1.1 GB of a task's sort.
JOINED_BYTES = 16 << 20


def _bytes(text: str) -> int:
    """Bytes that a setting such as 64m, 64MB or 67108864b names."""
    number = text.strip().lower().removesuffix("b")
    unit = number[-1:] if number[-1:] in ("k", "m", "g", "t") else ""
    return int(number.removesuffix(unit)) << 10 * " kmgt".index(unit or " ")


def spread(rows: DataFrame) -> DataFrame:
    """The rows, whose shuffles get as many partitions as their number asks for; adaptive execution joins those that turn out small, up to a size."""
    name, conf = "spark.sql.shuffle.partitions", rows.sparkSession.conf
    want = -(-rows.count() // PART_ROWS)
    if want > int(conf.get(name)):
        conf.set(name, str(want))
    joined = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if want > 1 and _bytes(conf.get(joined)) > JOINED_BYTES:
        conf.set(joined, f"{JOINED_BYTES}b")
    return rows


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Bounds the bytes of an Arrow batch, and with them what a Python worker holds of wide rows at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections derived from lineitem: about thirty for an image, at every scale."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    e = F.expr
    return spread(table(spark, sf_dir, "lineitem")).select(
        F.col("l_partkey").cast("long").alias("image_id"),
        e("CAST(l_linenumber % 5 AS INT)").alias("label_id"),
        F.row_number().over(w).cast("long").alias("ord"),
        e("CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 1000 AS DOUBLE) / 1000").alias("score"),
        e("CAST(l_orderkey % 400 AS INT)").alias("x1"),
        e("CAST((l_orderkey * 7 + l_suppkey) % 300 AS INT)").alias("y1"),
        e("CAST(l_orderkey % 400 + 20 + l_quantity * 4 AS INT)").alias("x2"),
        e("CAST((l_orderkey * 7 + l_suppkey) % 300 + 20 + l_quantity * 3 AS INT)").alias("y2"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see."""
    at = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lumenframe-shared"
    return f"{at.rstrip('/')}/lumenframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A written table in the shared folder, which ends lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
