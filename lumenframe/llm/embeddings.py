"""Embedding near-dedup: a subspace pigeonhole join.

Two unit vectors with cosine c lie at squared distance 2 - 2 c. Rotated by a fixed random
orthogonal matrix and split into blocks, each with a share of that budget in proportion to its
dimensions, linked vectors stay within the share in at least one block. So each block is
range-joined by itself: a grid over its first two coordinates, with cells twice as wide as the
share's radius, brings together whatever may be in reach; within a cell a finer grid over the next two
leaves fewer pairs, whose block distance is tested over all coordinates of the block, and survivors of
any block are compared exactly, by cosine in double precision. A pair counts in the first block that
holds it, so no pair is counted twice and pairs are not shuffled: a task returns sums of links for each
vector and edges of a spanning forest, which are as many as its vectors however dense a group is.

Three bounds on a block's squared distance are nested, so that rounding loses no pair: ``COUNTS`` beyond
the share it counts as the first block, computed in double precision; ``NEAR`` beyond it survives
the test in single precision; and the grid reaches ``REACH`` beyond it.

Vectors with equal components form one class with a count before the join. Cells are dealt
with ``split`` parts a side, and pairs of parts are separate groups, so that the part of a cell
that meets in one task stays bounded as the table grows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are kept; vectors of different lengths are not compared; vectors of any length
are compared over all components; repeated rows are linked to each other; rows without vec_id count as
vectors but name no component unless alone in it; extra columns are ignored, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import parallel, table, written
from lumenframe.llm.graph import components

BLOCK_DIMS = 8
#: Nested bounds beyond a block's share of the budget; rounding is below 1e-12 in double precision and 2e-6 in single.
COUNTS, NEAR, REACH = 1e-9, 1e-5, 2e-5
#: Rows of a cell from which the finer grid pays.
FINE = 256
#: Vectors for which a cell is not split; cells hold up to an eighth of all.
WHOLE = 100_000
CHUNK = 512


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def block_edges(dims: int) -> tuple[int, ...]:
    n = max(1, dims // BLOCK_DIMS)
    return tuple(dims * i // n for i in range(n + 1))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of raw, of any scale, at length one."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def stored(vectors: DataFrame) -> str:
    """How components travel: single precision where they come so, else double."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def identified(vectors: DataFrame) -> DataFrame:
    """vec_id, key (null if not comparable), vec (components in bytes, single or double precision as given)."""
    src = parallel(vectors.select("vec_id", "embedding"))
    kind = stored(vectors)

    def run(batches):
        import xxhash

        for b in batches:
            keys, vecs = [], []
            for v in b.column("embedding"):
                x = None
                if v.is_valid and v.values is not None and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                    else:
                        x = x + 0.0  # one zero
                vecs.append(None if x is None else x.tobytes())
                keys.append(None if x is None else xxhash.xxh3_128_digest(vecs[-1]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "vec"])

    id_type = src.schema["vec_id"].dataType.simpleString()
    return src.mapInArrow(run, f"vec_id {id_type}, key binary, vec binary")


def placed(classes: DataFrame, budget: float, split: int, kind: str) -> DataFrame:
    """Rows of classes (node, size, vec) for each block and each cell in reach: cell, home, part pair."""

    def run(batches):
        for b in batches:
            vec = b.column("vec").to_pylist()
            by_dims: dict[int, list[int]] = {}
            for r, v in enumerate(vec):
                by_dims.setdefault(len(v) // np.dtype(kind).itemsize, []).append(r)
            for dims, rows in by_dims.items():
                y = unit(np.frombuffer(b"".join(vec[r] for r in rows), dtype=kind).reshape(-1, dims).astype(float)) @ rotation(dims)
                edges = block_edges(dims)
                who, cells, home = [], [], []
                for j, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                    reach = np.sqrt(budget * (e - s) / dims + REACH)
                    width = 2 * reach
                    at = np.zeros((len(rows), 2))
                    at[:, : min(2, e - s)] = y[:, s : min(e, s + 2)]
                    cell = np.floor(at / width).astype(np.int64)
                    inside = at - cell * width
                    for dx, dy in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1)):
                        gap = np.stack([(width - inside[:, 0]) * (dx > 0), np.where(dy > 0, width - inside[:, 1], np.where(dy < 0, inside[:, 1], 0))], axis=1)
                        near = np.flatnonzero((gap**2).sum(1) <= reach**2)
                        who.append(near)
                        c = cell[near] + [dx, dy]
                        cells.append(((dims * 4096 + j) << 40) + ((c[:, 0] + (1 << 19)) << 20) + c[:, 1] + (1 << 19))
                        home.append(np.full(len(near), dx == 0 and dy == 0))
                own = np.concatenate(who)
                take = pa.array(np.array(rows)[own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(home)), b.column("node").take(take), b.column("size").take(take), b.column("vec").take(take)], names=["cell", "home", "node", "size", "vec"])

    out = classes.mapInArrow(run, "cell long, home boolean, node long, size long, vec binary")
    out = out.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(split)).cast("int"))
    if split == 1:
        return out.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.lit(split - 1)))
    return out.withColumn("other", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def neighbourhoods(z: np.ndarray, homes: np.ndarray, others: np.ndarray, reach: float):
    """Pairs of index arrays (a, b), a of homes, that together hold every pair of a home and another row within reach: by a grid over the third and fourth coordinate."""
    if not len(homes):
        return
    every = np.sort(np.concatenate([homes, others]))
    if len(every) < FINE or z.shape[1] < 4:
        yield homes, every
        return
    cell = np.floor(z[:, 2:4].astype(float) / reach).astype(np.int64)
    cell -= cell.min(0) - 1
    wide = int(cell[:, 1].max()) + 2
    code = cell[:, 0] * wide + cell[:, 1]
    order = every[np.argsort(code[every], kind="stable")]
    sorted_codes = code[order]
    home_order = homes[np.argsort(code[homes], kind="stable")]
    home_codes = code[home_order]
    edge = np.flatnonzero(np.concatenate([[True], home_codes[1:] != home_codes[:-1], [True]]))
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        c = int(home_codes[s])
        # Three neighbouring codes of one row of the grid lie together.
        spans = [np.searchsorted(sorted_codes, [c + d * wide - 1, c + d * wide + 2]) for d in (-1, 0, 1)]
        yield home_order[s:e], np.sort(np.concatenate([order[x:y] for x, y in spans]))


def cell_links(cell: int, home: np.ndarray, part: np.ndarray, own: bool, node: np.ndarray, size: np.ndarray, raw: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked rows, counted, for each row, and edges of a spanning forest, of the pairs whose first block is that of the cell."""
    dims, j = (cell >> 40) // 4096, (cell >> 40) % 4096
    edges = block_edges(dims)
    x = unit(raw.astype(float))
    y = x @ rotation(dims)
    shares = np.array([(2 - 2 * least) * (e - s) / dims for s, e in zip(edges, edges[1:], strict=False)])
    z = np.ascontiguousarray(y[:, edges[j] : edges[j + 1]], dtype=np.float32)
    norm = (z * z).sum(1)
    count, forest, out = np.zeros(len(node), dtype=np.int64), Forest(len(node)), []
    homes, others = np.flatnonzero(home), np.flatnonzero(~home)
    for first, second in neighbourhoods(z, homes, others, float(np.sqrt(shares[j] + REACH))):
        for s in range(0, len(first), CHUNK):
            a = first[s : s + CHUNK]
            for t in range(0, len(second), 4 * CHUNK):
                b = second[t : t + 4 * CHUNK]
                if b[-1] < a[0] and home[b].all():
                    continue
                p, q = np.nonzero(norm[a][:, None] + norm[b][None] - 2 * (z[a] @ z[b].T) <= shares[j] + NEAR)
                p, q = a[p], b[q]
                # Home rows meet once; of two parts only pairs across count.
                ok = (~home[q] | (q > p)) & (own | (part[p] != part[q])) & (node[p] != node[q])
                p, q = p[ok], q[ok]
                for u in range(0, len(p), 50_000):
                    pp, qq = p[u : u + 50_000], q[u : u + 50_000]
                    hit = np.einsum("ij,ij->i", x[pp], x[qq]) >= least
                    pp, qq = pp[hit], qq[hit]
                    if not len(pp):
                        continue
                    d = np.add.reduceat((y[pp] - y[qq]) ** 2, edges[:-1], axis=1)
                    counted = (d <= shares + COUNTS).argmax(1) == j
                    pp, qq = pp[counted], qq[counted]
                    np.add.at(count, pp, size[qq])
                    np.add.at(count, qq, size[pp])
                    out.extend((m, n) for m, n in zip(pp.tolist(), qq.tolist(), strict=True) if forest.join(m, n))
    return count, out


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of (vec_id long, embedding)."""
    kind = stored(vectors)
    rows = written(identified(vectors), "vectors", "none")
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("vec_id", "vec")).alias("m"), F.min("vec_id").alias("first"), F.count("*").alias("size"))
    # A class is named by the smallest id, or by a hash where no row has one.
    node = F.coalesce("first", F.xxhash64("key"))
    groups = written(groups.select("key", node.alias("node"), "size", F.col("m.vec").alias("vec")), "vector-classes", "none")
    total = groups.count()
    split = -(-total // WHOLE) if total else 1
    spread = placed(groups.select("node", "size", "vec"), 2 - 2 * least, split, kind)

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        node, size = t.column("node").to_numpy(), t.column("size").to_numpy()
        raw = np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=kind).reshape(len(node), -1)
        count, edges = cell_links(t.column("cell")[0].as_py(), t.column("home").to_numpy(zero_copy_only=False), t.column("part").to_numpy(), i == j, node, size, raw, least)
        some = np.flatnonzero(count)
        a, b = node[[e[0] for e in edges]], node[[e[1] for e in edges]]
        none = np.zeros(len(some), dtype=np.int64)
        return pa.table({"a": np.concatenate([node[some], a]), "b": pa.array(np.concatenate([none, b]), mask=np.concatenate([none == 0, np.zeros(len(b), dtype=bool)])), "n": np.concatenate([count[some], np.zeros(len(a), dtype=np.int64)])})

    found = written(spread.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long, n long"), "vector-links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found.where("b IS NOT NULL").select("a", "b"))
    info = groups.join(counts, groups["node"] == counts["a"], "left").join(comp.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
    info = info.select("key", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    # Rows without a key would meet in one partition of the join.
    none = rows.where("key IS NULL").select("vec_id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component"))
    out = rows.where("key IS NOT NULL").select("vec_id", "key").join(info, "key", "left").select("vec_id", "links", "component").unionByName(none)
    comp_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), u AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id != b.vec_id AND list_dot_product(a.e, b.e) >= 0.95
), r(vec_id, seen) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a
), c AS (
  SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
