"""The polling service as Structured Streaming: micro-batches are labelled, deduplicated and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.signatures import PARTIAL, TOTAL


def label_stream(items: DataFrame, label: Column, score: Column, least: float) -> DataFrame:
    """Adds label and score; what reaches no label gets null and -1."""
    ok = score >= least
    return items.withColumn("label", F.when(ok, label).otherwise(F.lit("null"))).withColumn("score", F.when(ok, score).otherwise(F.lit(-1.0)))


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the table it wrote."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def poll_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Files as they arrive, a bounded number for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def new_in_stream(stream: DataFrame, key: str = "code", partial: int = PARTIAL, total: int = TOTAL) -> DataFrame:
    """Insert-if-new over a stream of signatures (code, id, feat): a row is new if no row of its bucket so far is near; the bucket's signatures are its state.

    Adds is_new and duplicate_of, the first row that it resembles. State grows with the new signatures of a bucket, as the store itself does.
    """
    import numpy as np
    import pandas as pd

    def step(own, frames, state):
        known_ids, feats = (list(x) for x in state.get) if state.exists else ([], [])
        known, n = np.array(feats, dtype=np.int32) if feats else np.zeros((0, 0), dtype=np.int32), len(feats)
        for pdf in frames:
            out = []
            for i, f in sorted(zip(pdf["id"].tolist(), (list(map(int, x)) for x in pdf["feat"]), strict=True)):
                # All known signatures of the bucket are compared at once.
                gap = np.abs(known[:n] - np.array(f, dtype=np.int32)) if n else np.zeros((0, 1))
                hits = np.flatnonzero((gap.max(1, initial=0) <= partial) & (gap.sum(1) <= total))
                hit = known_ids[hits[0]] if len(hits) else None
                if hit is None:
                    if n == len(known):
                        known = np.concatenate([known.reshape(n, len(f)), np.zeros((max(n, 64), len(f)), dtype=np.int32)])
                    known[n], n = f, n + 1
                    known_ids.append(i)
                out.append((own[0], i, hit is None, hit))
            yield pd.DataFrame(out, columns=[key, "id", "is_new", "duplicate_of"]).astype({"duplicate_of": "Int64"})
        state.update((known_ids, known[:n].tolist()))

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, id long, is_new boolean, duplicate_of long", "ids array<long>, feats array<array<int>>", "append", "NoTimeout")


def scheduled(spark: SparkSession, pool: str):
    """Runs the jobs of a block in a scheduler pool, of which a configuration says whether it is first in, first out or fair."""
    import contextlib

    @contextlib.contextmanager
    def inside():
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            yield
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    return inside()


def first_of_each(items: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Insert-if-new: one row of each key, with state kept no longer than the watermark."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
