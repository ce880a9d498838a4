"""Near-duplicate images by compact signatures: arrays of small integers, 36 or more each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.session import small_batches, written

PARTIAL, TOTAL = 2, 8
#: Rows and pairs of a bucket up to which it is scanned in one fold.
FOLD, NEAR = 500, 20_000
#: Rows of a bucket that are compared with as many others at once.
BLOCK = 2048


def code(feat: str = "feat", dims: int = 32) -> Column:
    """The bucket: one step left and the three high bits of the next component, within 32 bits."""
    return F.expr(f"aggregate(slice({feat}, 1, {dims}), 0L, (c, x) -> (shiftleft(c, 1) | shiftright(CAST(x AS BIGINT), 5)) & 4294967295L)")


def differences(a: str, b: str) -> tuple[Column, Column]:
    """Largest and summed absolute difference."""
    d = f"zip_with({a}, {b}, (x, y) -> abs(x - y))"
    return F.expr(f"array_max({d})"), F.expr(f"aggregate({d}, 0, (s, x) -> s + x)")


def within(a: np.ndarray, b: np.ndarray, partial: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows of a and b that are within both limits, component by component over all pairs of a few rows with all of b."""
    first, second = [], []
    step = max(1, (1 << 18) // max(len(b), 1))
    columns = np.ascontiguousarray(b.T)
    for at in range(0, len(a), step):
        part = a[at : at + step]
        most, total_of = np.zeros((len(part), len(b)), dtype=a.dtype), np.zeros((len(part), len(b)), dtype=a.dtype)
        for k in range(a.shape[1]):
            gap = np.abs(part[:, k, None] - columns[k])
            np.maximum(most, gap, out=most)
            total_of += gap
        i, j = np.nonzero((most <= partial) & (total_of <= total))
        first.append(i + at)
        second.append(j)
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))


def matrix(feats, n: int) -> np.ndarray:
    """Rows of small integers as a matrix in which differences and their sums have room."""
    x = np.asarray(feats).reshape(n, -1).astype(np.int64)
    return x.astype(np.int16) if not x.size or (np.abs(x).max() * 2 + 1) * x.shape[1] < 1 << 15 else x


def blocked(rows: DataFrame, keys: list[str], sizes: DataFrame, size: str, name: str) -> DataFrame:
    """keys, block, ids, feats, signatures of one length in blocks of ``BLOCK`` rows or so."""
    x = rows.where("size(feat) > 0 AND NOT exists(feat, x -> x IS NULL)").join(sizes, keys).withColumn("n", F.size("feat"))
    x = x.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / BLOCK)).cast("int"))
    return x.groupBy(*keys, "n", "block").agg(F.collect_list(F.struct("id", "feat")).alias("r")).select(*keys, "n", F.col("block").alias(f"{name}_block"), F.col("r.id").alias(f"{name}_id"), F.flatten("r.feat").alias(name))


def near_pairs(rows: DataFrame, others: DataFrame | None, keys: list[str], partial: int, total: int) -> DataFrame:
    """keys, id, other_id of rows and others (keys, id, feat) of one bucket that are within both limits; without others, of rows and earlier rows.

    A bucket is cut in blocks, each block of rows meets each block of the others, and all pairs of two blocks are compared at once: work is
    shared out however large a bucket is, and no pair but a near one leaves its task.
    """
    small_batches(rows.sparkSession)
    own = others is None
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    sizes = sizes.where("rows > 1").withColumn("others", F.col("rows")) if own else sizes.join(others.groupBy(*keys).agg(F.count("*").alias("others")), keys)
    sizes = written(sizes, "near-sizes")
    a = blocked(rows, keys, sizes.select(*keys, "rows"), "rows", "a")
    b = a.select(*keys, "n", *(F.col(f"a{c}").alias(f"b{c}") for c in ("_block", "_id", ""))) if own else blocked(others, keys, sizes.select(*keys, "others"), "others", "b")
    # Each block is sent to the blocks that it meets, so a hot bucket is many small groups.
    last = F.ceil(F.col("others") / BLOCK).cast("int") - 1
    a = a.join(sizes.select(*keys, "others"), keys).withColumn("b_block", F.explode(F.sequence(F.lit(0), F.least(last, "a_block") if own else last)))
    met = a.join(b, [*keys, "n", "b_block"]).select(*keys, "a_id", "a", "b_id", "b", F.col("a_block").alias("i"), F.col("b_block").alias("j"))

    def run(batches):
        for batch in batches:
            at = {c: batch.column(c) for c in ("a_id", "a", "b_id", "b")}
            for r in range(batch.num_rows):
                p, x, q, y = (at[c][r].values.to_numpy(zero_copy_only=False) for c in ("a_id", "a", "b_id", "b"))
                both = matrix(np.concatenate([x, y]), len(p) + len(q))
                i, j = within(both[: len(p)], both[len(p) :], partial, total)
                p, q = p[i], q[j]
                if own:
                    p, q = np.maximum(p, q), np.minimum(p, q)
                    # Within one block each pair is met twice.
                    hit = p > q
                    pair = np.unique(np.stack([p[hit], q[hit]], 1), axis=0) if batch.column("i")[r].as_py() == batch.column("j")[r].as_py() else np.stack([p[hit], q[hit]], 1)
                    p, q = pair[:, 0], pair[:, 1]
                if not len(p):
                    continue
                same = pa.array(np.full(len(p), r))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(same) for k in keys), pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=[*keys, "id", "other_id"])

    return met.mapInArrow(run, f"{kinds}, id long, other_id long")


def left_out(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, duplicate_of: the rows that a scan which keeps a row unless it resembles a kept earlier one would not keep, and the first kept one that each resembles.

    pairs (keys, id, other_id) holds every near pair, earlier row as other_id. A bucket with up to ``FOLD`` rows that have an earlier neighbour, and ``NEAR`` pairs, is one fold in
    order of id; larger ones are settled in rounds, see settled().
    """
    every = written(pairs.where("other_id < id").distinct(), "near-pairs")
    sizes = every.groupBy(*keys).agg(F.count_distinct("id").alias("rows"), F.count("*").alias("pairs"))
    large = written(sizes.where((F.col("rows") > FOLD) | (F.col("pairs") > NEAR)).select(*keys), "near-large")
    rows = every.join(large, keys, "left_anti").groupBy(*keys, "id").agg(F.sort_array(F.collect_list("other_id")).alias("near"))
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "near"))).alias("rows"))
    g = g.withColumn("out", F.expr("aggregate(rows, slice(transform(rows, r -> r.id), 1, 0), (out, r) -> IF(exists(r.near, n -> NOT array_contains(out, n)), concat(out, array(r.id)), out))"))
    g = g.select(*keys, F.explode(F.expr("filter(rows, r -> array_contains(out, r.id))")).alias("r"), "out")
    small = g.select(*keys, "r.id", F.expr("filter(r.near, n -> NOT array_contains(out, n))[0]").alias("duplicate_of"))
    if large.isEmpty():
        return small
    return small.unionByName(settled(written(every.join(large, keys, "left_semi"), "near-pairs"), keys))


def settled(every: DataFrame, keys: list[str]) -> DataFrame:
    """As left_out(), of a written table of pairs: in each round rows without an undecided earlier neighbour
    are kept, what resembles them goes, and what has gone holds nobody back. The first undecided row of a bucket is
    settled in each round, most are in the first few.
    """
    open_, gone = every, []
    later = lambda df: df.select(*keys, F.col("id").alias("other_id")).distinct()
    while not open_.isEmpty():
        kept = open_.select(*keys, "other_id").distinct().join(later(open_), [*keys, "other_id"], "left_anti")
        out = written(open_.join(kept, [*keys, "other_id"], "left_semi").select(*keys, "id").distinct(), "near-out")
        gone.append(out)
        open_ = written(open_.join(out, [*keys, "id"], "left_anti").join(later(out), [*keys, "other_id"], "left_anti"), "near-open")
    if not gone:
        return every.select(*keys, "id", F.col("other_id").alias("duplicate_of")).limit(0)
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    held = every.join(out, [*keys, "id"], "left_semi").join(later(out), [*keys, "other_id"], "left_anti")
    return held.groupBy(*keys, "id").agg(F.min("other_id").alias("duplicate_of"))


def near_duplicates(rows: DataFrame, partial: int = PARTIAL, total: int = TOTAL, dims: int = 32) -> DataFrame:
    """id, duplicate_of of the rows (id, feat) that are no first of their kind, in order of id: a row is a copy of the first kept row of its bucket that is within both limits, else it is kept.

    Equal signatures are one, with their first row: what is near one is near all.
    """
    one = written(rows.groupBy("feat").agg(F.min("id").alias("id")).withColumn("code", code(dims=dims)), "signatures")
    firsts = one.select("code", "id", "feat")
    out = left_out(near_pairs(firsts, None, ["code"], partial, total), ["code"])
    told = one.join(out, ["code", "id"], "left").select("feat", F.col("id").alias("first"), F.coalesce("duplicate_of", "id").alias("duplicate_of"))
    return rows.select("id", "feat").join(told, "feat").where("duplicate_of < id").select("id", "duplicate_of")


def same_picture(cld: str, ehd: str, other_cld: str, other_ehd: str, near: int = 30, texture_near: int = 170) -> Column:
    """2 if colour codes differ by at most 10 each and 32 in all, 1 if colour and texture are not far apart, else 0."""
    most, s = differences(cld, other_cld)
    _, texture = differences(ehd, other_ehd)
    return F.when((most <= 10) & (s <= 32), 2).when((s <= near) & (texture <= texture_near), 1).otherwise(0)


def better_copy(q1: str, q2: str) -> Column:
    """1 or 2: which copy has the better quality, 0 if either is unknown."""
    return F.when((F.col(q1) <= 0) | (F.col(q2) <= 0), 0).when(F.col(q2) > F.col(q1), 2).otherwise(1)
