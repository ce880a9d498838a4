"""Packing along a space-filling curve.

1. Each text becomes a hashed vector of its words, projected to ``DIMS`` signs-of-hash sums and
   squashed to ``BITS`` bits a dimension; the Hilbert index of that cell is its key.
2. The same pass encodes the text, and the encoded table is written to the shared folder with the number of the
   range that each document falls to: by its key, and by a hash of doc_id where keys are equal. Borders of
   the ranges come from a sample of at most ``SAMPLE`` rows; they decide how even the ranges are, not the result. Where there are
   more ranges than the sample has hundreds of rows, each is cut again by quantiles of the sort keys written for it.
3. One row for each range gives where its tokens start in the whole stream. The ids are range-sorted, and documents
   are cut where the stream passes a multiple of the sequence length, so neighbours on the curve
   share sequences and only the very last sequence is padded.

Copies have equal keys; the hash of doc_id lets ranges split even a key that holds a third of all
rows. Nothing but the sample and the totals of ranges leaves the executors.

Defined results: a null text counts as empty and gives one piece, its closing id; a text of any
length is cut into as many sequences as it fills; repeated rows are packed each; the order of
rows equal in key and hash is arbitrary but each id lies in exactly one piece; a null doc_id is packed
too; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import forget, parallel, table, written
from lumenframe.llm.kernels import MIX_1, U64, blocks, mix, word_hashes
from lumenframe.llm.moving import buckets_for
from lumenframe.llm.tokens import byte_encoder

DIMS, BITS = 4, 8
#: Bytes of text in a range, and most rows of the sample from which borders are taken.
RANGE, SAMPLE = 32 << 20, 1_000_000


def projections(texts: list[bytes]) -> np.ndarray:
    """Integer cell of each text: the hashed word-count vector times DIMS random sign vectors, scaled by its length."""
    out = np.zeros((len(texts), DIMS))
    for i, j in blocks(texts):
        words, count = word_hashes(texts[i:j])
        at = np.concatenate([[0], np.cumsum(count)])
        # Four independent signs from the parts of one mixed hash.
        mixed = mix(words ^ U64(MIX_1)).view(np.uint16).reshape(-1, 4)
        for d in range(DIMS):
            sign = mixed[:, d] / 32768.0 - 1.0
            total = np.concatenate([[0.0], np.cumsum(sign)])
            out[i:j, d] = (total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(count, 1))
    cell = (1 / (1 + np.exp(-1.5 * out)) * (1 << BITS)).astype(np.int64)
    return np.clip(cell, 0, (1 << BITS) - 1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of integer coordinates (Skilling's transpose form, vectorised over rows)."""
    x = [cells[:, d].astype(np.int64).copy() for d in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for d in range(n):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | (((x[d] ^ t) >> b) & 1)
    return key


def sort_keys(raw: list[bytes], tie: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The curve's key of each text, and the key to sort by: the curve's, then bits of a hash of doc_id."""
    key = hilbert(projections(raw))
    return key, (key << 31) | (tie.to_numpy().view(np.uint64) >> U64(33)).astype(np.int64)


def range_bounds(src: DataFrame, rows: int, ranges: int) -> np.ndarray:
    """Borders of about as many ranges of sort keys, from a sample of (tie, text)."""
    share = min(1.0, 100 * ranges / max(rows, 1))
    cuts = [i / ranges for i in range(1, ranges)]
    if not cuts:
        return np.empty(0, dtype=np.int64)

    def run(batches):
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sort_keys(raw, b.column("tie"))[1])], names=["sort_key"])

    picked = src.select("tie", "text").where(F.pmod(F.xxhash64("tie", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = picked.mapInArrow(run, "sort_key long").agg(F.percentile_approx("sort_key", cuts, 100_000)).first()[0]
    return np.unique(np.array(found or [], dtype=np.int64))


def cut_again(ids: DataFrame, parts: int) -> DataFrame:
    """ids with every range in about as many parts: range_no counts the parts, in order of sort keys. The join is left to Spark, which knows the sizes."""
    borders = ids.groupBy("range_no").agg(F.percentile_approx("sort_key", [i / parts for i in range(1, parts)], 100 * parts).alias("borders"))
    # Sorted borders: those up to the key are counted; equal ones leave a part empty.
    part = F.size(F.filter("borders", lambda x: x <= F.col("sort_key")))
    return ids.join(borders, "range_no").withColumn("range_no", (F.col("range_no").cast("long") * parts + part)).drop("borders")


def encoded(src: DataFrame, tokenizer: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """doc_id, curve_key, sort_key, range_no, n and ids (packed, with the closing one) of (doc_id, tie, text)."""
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        forget("byte")
        enc = byte_encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for b in batches:
            for part in (b.slice(x, 1000) for x in range(0, b.num_rows, 1000)):
                texts = [t or "" for t in part.column("text").to_pylist()]
                key, own = sort_keys([t.encode("utf-8", "surrogatepass") for t in texts], part.column("tie"))
                ids = [enc.packed(t) + end for t in texts]
                n = np.array([len(x) // enc.width for x in ids], dtype=np.int64)
                where = np.searchsorted(bounds, own, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key), pa.array(own), pa.array(where), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "curve_key", "sort_key", "range_no", "n", "ids"])

    return src.mapInArrow(run, f"doc_id {id_type}, curve_key long, sort_key long, range_no int, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids (packed), ids_crc32, doc_tokens, sequence_id, offset, curve_key of docs (doc_id, text)."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    src = parallel(docs.select("doc_id", F.xxhash64("doc_id").alias("tie"), "text"))
    # The number of ranges follows the bytes of text; several fall to a partition.
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    parts = partitions or buckets_for(size or 0, RANGE, int(spark.conf.get("spark.sql.shuffle.partitions")))
    again = -(-4 * parts // (SAMPLE // 100))
    ids = written(encoded(src, tokenizer, end_id, range_bounds(src, rows, -(-4 * parts // again))), "packing-encoded", "snappy")
    if again > 1:
        ids = written(cut_again(ids, again), "packing-ranges", "snappy")
    # A row for each range, however many documents there are.
    totals = ids.groupBy("range_no").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ids.join(F.broadcast(totals.select("range_no", before.alias("first"))), "range_no")
    placed = placed.repartitionById(parts, (F.col("range_no") % parts).cast("int")).sortWithinPartitions("range_no", "sort_key").drop("sort_key")
    schema = f"doc_id {id_type}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long"

    def cut(batches):
        now, upto = None, 0
        for b in batches:
            for part in (b.slice(x, 500) for x in range(0, b.num_rows, 500)):
                out: list[tuple] = []
                for r, (own, first, n, blob) in enumerate(zip(*(part.column(c).to_pylist() for c in ("range_no", "first", "n", "ids")), strict=True)):
                    if own != now:  # places go on within a range and start anew with each
                        now, upto = own, first
                    width, at = len(blob) // n, 0
                    while at < n:
                        seq, off = divmod(upto + at, length)
                        k = min(n - at, length - off)
                        piece = blob[at * width : (at + k) * width]
                        wide = piece if width == 4 else np.frombuffer(piece, "<u2").astype("<u4").tobytes()
                        out.append((r, at, k, piece, zlib.crc32(wide), n, seq, off))
                        at += k
                    upto += n
                if out:
                    c = list(zip(*out, strict=True))
                    own_row = pa.array(c[0])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(own_row), *(pa.array(c[i], pa.binary() if i == 3 else pa.int64()) for i in range(1, 8)), part.column("curve_key").take(own_row)],
                        names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"],
                    )

    return placed.mapInArrow(cut, schema)


def op1_packing(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
