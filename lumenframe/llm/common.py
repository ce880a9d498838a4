"""Session helpers shared by the operators: worker imports, the shared folder, written tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import sys
import types
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between Spark and Python: bounded memory also where texts are long.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: Rows that the Parquet reader decodes at a time: texts and blocks are wide.
READ_LIMIT, READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 512
#: What Python workers are told so that they give freed memory back: they outlive stages and share their executor's memory.
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "131072", "ARROW_DEFAULT_MEMORY_POOL": "system"}
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started, and bounds what moves at a time."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    for name, most in ((BATCH_LIMIT, BATCH_BYTES), (READ_LIMIT, READ_ROWS)):
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(name, str(most))
    return spark


def row_struct(df: DataFrame, columns: list[str] | None = None, name: str = "own_row") -> Column:
    """The caller's columns as one struct, so that their names can't clash with those that an operator uses inside."""
    return F.struct(*(F.col(f"`{c}`") for c in (df.columns if columns is None else columns))).alias(name)


def unpacked_rows(df: DataFrame, columns: list[str], name: str = "own_row") -> DataFrame:
    """The columns that row_struct() put away."""
    return df.select(*(F.col(name).getField(c).alias(c) for c in columns))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    name = "_lumenframe_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def forget(keep: str | None = None) -> None:
    """Gives back what earlier operators hold in this worker process, but for caches of the kind to keep."""
    import ctypes
    import gc

    import pyarrow as pa

    held = worker_cache()
    for k in [k for k in held if isinstance(k, tuple) and k[0] != keep]:
        del held[k]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_column(batch):
    """The texts of an Arrow batch: its column text, or the field of own_row where that holds the texts."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("own_row").field("text")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one under the warehouse where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        at = f"{warehouse.rstrip('/')}/lumenframe-shared"
    return f"{at.rstrip('/')}/lumenframe/{spark.sparkContext.applicationId}"


_swept: set[str] = set()


def swept_at_exit(spark: SparkSession) -> None:
    """Deletes the application's folder when the driver's Python ends: what is left there nobody can name any more."""
    at, jvm = shared_dir(spark), spark._jvm
    if at in _swept:
        return
    _swept.add(at)

    def sweep() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone before
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)

    atexit.register(sweep)


def scratch_path(spark: SparkSession, name: str) -> str:
    swept_at_exit(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenframe_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lumenframe_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallel(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Deals a table of a few input splits over the cores, so that per-row work is spread; large tables pass unchanged."""
    want = at_least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str, rows: int, limit: int = 500_000) -> DataFrame:
    """Joins on a key; the id side, whose row count has been measured, is broadcast up to a fixed limit and shuffled beyond it."""
    return df.join(F.broadcast(ids) if rows <= limit else ids, key, how)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
