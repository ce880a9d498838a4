"""Moving rows in compressed Arrow blocks.

Shuffling millions of short texts row by row costs an own header, and weak compression, for
each. Here a task packs the rows of a batch that go to one bucket into one zstd-compressed
Arrow stream; Spark then shuffles (bucket, kind, block) rows. Buckets are sized by the caller
so that one fits a task; kinds order the rows of a bucket, so that a task can read a small
side before it streams the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket int, kind int, block binary"
_OPTIONS = {"compression": "zstd"}


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(**_OPTIONS)) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def blocks_by_bucket(batch: pa.RecordBatch, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """The rows of a batch as (bucket, kind, block)."""
    order = np.argsort(bucket, kind="stable")
    if not len(order):
        return
    sorted_buckets = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1], [True]]))
    whole = batch.take(pa.array(order))
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(sorted_buckets[s]), kind, packed(pa.RecordBatch.from_struct_array(pa.concat_arrays([whole.slice(s, e - s).to_struct_array()])))


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "kind", "block"])


def gathered(batches: Iterator[pa.RecordBatch], size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined to about size bytes: what is shared within one is settled there."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def emitted(rows: Iterator[tuple[int, int, bytes]], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about size bytes."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[2])
        if n > size:
            yield as_batch(held)
            held, n = [], 0
    if held:
        yield as_batch(held)


def dealt(blocks: DataFrame, partitions: int, ordered: bool = False) -> DataFrame:
    out = blocks.repartition(partitions, "bucket")
    return out.sortWithinPartitions("bucket", "kind") if ordered else out.sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """The (kind, block) rows of each bucket in turn; each must be read to its end."""
    rows = ((b, k, x) for batch in batches for b, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        bucket = ahead[0]

        def own(bucket=bucket):
            nonlocal ahead
            while ahead is not None and ahead[0] == bucket:
                now = ahead
                yield now[1], now[2]
                ahead = next(rows, None)

        yield bucket, own()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one number, from which numbers of buckets follow."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()[0] or 0)


def buckets_for(total: int, each: int, least: int) -> int:
    return max(least, -(-total // each))


def id_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a long id, from its mixed bits."""
    from lumenframe.llm.kernels import U64, mix

    return (mix(ids.astype(np.int64).view(np.uint64) + U64(0x51ED270B)) % U64(n)).astype(np.int32)
