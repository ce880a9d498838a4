"""N-gram Jaccard join: a size-aware heavy-light set join over word shingles.

Documents with equal shingle sets form one class, named by a hash of the set; the row with the
smallest doc_id lends it its text. All later work is on classes.

1. Uniqueness: hashes of all shingles are dealt to buckets, which count for each class how many
   of its shingles any other class holds. A class of n shingles that shares fewer than
   ``threshold`` n cannot link to another and is settled. Shingles that several classes of one
   batch share are settled there and sent once, so no bucket gets more than one record for
   each batch and shingle.
2. Shingles of the remaining classes are ordered by how many classes hold them, rarest first.
3. Light: of a class with at most ``boundary`` shingles all subsets large enough to prove a link
   are enumerated. Classes with an equal subset are linked to the smallest of them, which
   links whenever any pair of them does.
4. Heavy: the rarest shingles of a larger class, as many as a partner cannot all miss, enter
   inverted lists. Each list is scanned twice: first every member against the list's most
   ordinary member; then, in blocks of bounded size, members outside the list's largest component
   against those inside and against each other, so that no pair already connected meets.
   Size and position bounds drop pairs before sets are compared; all others are compared exactly.

The boundary is that with the least estimated cost in the histogram of set sizes: rows
enumerated against rows listed plus shingles shipped for comparison. Classes just below
the boundary take part in the lists too, so pairs across it are found.

Defined results: a null or empty text has an empty set and is linked with nothing; a text with
fewer words than ``width`` has one shingle, all its words; texts of any length count whole;
repeated rows are linked to each other, and rows that repeat an id but not its text only as their
texts are; rows without doc_id link like others and keep a null component unless a row of their
component has an id; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import drop_written, forget, parallel, release, table, written
from lumenframe.llm.graph import components
from lumenframe.llm.kernels import U64, mix, set_key, shingle_sets
from lumenframe.llm.moving import SCHEMA, blocks_by_bucket, buckets_for, by_bucket, dealt, emitted, gathered, id_bucket, packed, text_bytes, unpacked

#: Members of a list that one task compares with as many others.
BLOCK = 1024
#: Longest lists whose pairs are joined row by row.
SHORT = 32
#: Rows up to which a side whose rows were counted is broadcast.
SMALL = 500_000
#: Stands for a missing id in keys.
NO_ID = -(1 << 63)


def need(n: int, percent: int) -> int:
    """Least overlap with any partner of a set of n."""
    return -(-percent * n // 100)


def sets_of(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()], width)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, own_id (never null), mark (a hash of the text), text: id and mark name a row's text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("own_id"), F.xxhash64("text").alias("mark"), "text")


def set_rows(src: DataFrame, width: int) -> DataFrame:
    """doc_id, own_id, mark, n, key_a, key_b: size and 128-bit identity of each text's set."""
    keep = ["doc_id", "own_id", "mark"]

    def run(batches):
        forget()
        for b in batches:
            for part in (b.slice(x, 1000) for x in range(0, b.num_rows, 1000)):
                sets = sets_of(part, width)
                keys = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=[*keep, "n", "key_a", "key_b"])

    return src.mapInArrow(run, "doc_id long, own_id long, mark long, n long, key_a long, key_b long")


def shared_counts(src: DataFrame, width: int, n_buckets: int, partitions: int) -> DataFrame:
    """key_a, shared: how many shingles of a class other classes hold too; classes without any are absent."""

    def send(batches):
        def flush(keys, flat, owner):
            order = np.argsort(flat)
            flat, owner = flat[order], owner[order]
            new = np.concatenate([[True], flat[1:] != flat[:-1]])
            group = np.cumsum(new, dtype=np.int32) - 1
            shared = np.bincount(group)[group] > 1
            del order, group
            count = np.bincount(owner[shared], minlength=len(keys))
            known = np.flatnonzero(count)
            if len(known):
                yield from blocks_by_bucket(pa.RecordBatch.from_arrays([pa.array(keys[known]), pa.array(count[known])], names=["key_a", "shared"]), (known % n_buckets).astype(np.int32), 0)
            use = new | ~shared
            flat, who = flat[use], np.where(shared[use], np.int32(len(keys)), owner[use])
            bucket = ((flat >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int32)
            order = np.lexsort((who, bucket))
            flat, who, bucket = flat[order], who[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
            named = np.concatenate([keys, np.zeros(1, dtype=np.int64)])
            for b in range(n_buckets):
                s, e = edge[b], edge[b + 1]
                if s < e:
                    w = who[s:e]
                    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [e - s]]).astype(np.int32)), pa.array((flat[s:e] & U64(0xFFFFFFFF)).astype(np.uint32)))
                    yield b, 1, packed(pa.RecordBatch.from_arrays([pa.array(named[w[first]]), pa.array(w[first] == len(keys)), lists], names=["key_a", "several", "hashes"]))

        def rows():
            for b in gathered(batches):
                seen: dict[int, int] = {}
                flat, owner, held = [], [], 0
                for part in (b.slice(x, 1000) for x in range(0, b.num_rows, 1000)):
                    for s in sets_of(part, width):
                        if not len(s):
                            continue
                        k = set_key(s)[0]
                        if k in seen:
                            continue
                        owner.append(np.full(len(s), len(seen), dtype=np.int32))
                        seen[k] = len(seen)
                        flat.append(s)
                        held += len(s)
                    if held > 1_500_000:
                        yield from flush(np.array(list(seen), dtype=np.int64), np.concatenate(flat), np.concatenate(owner))
                        seen, flat, owner, held = {}, [], [], 0
                if held:
                    yield from flush(np.array(list(seen), dtype=np.int64), np.concatenate(flat), np.concatenate(owner))

        forget()
        yield from emitted(rows())

    def count(batches):
        """Counts by class, as blocks for the class's own bucket: a row for each would be as many as classes times buckets."""

        def rows():
            for _, own in by_bucket(batches):
                keys, several, hashes = [], [], []
                for kind, block in own:
                    t = unpacked(block).combine_chunks()
                    if kind == 0:
                        for known in t.to_batches():
                            yield from blocks_by_bucket(known, id_bucket(known.column("key_a").to_numpy(), n_buckets), 0)
                        continue
                    h = t.column("hashes").combine_chunks()
                    size = h.value_lengths().to_numpy(zero_copy_only=False)
                    keys.append(np.repeat(t.column("key_a").to_numpy(), size))
                    several.append(np.repeat(t.column("several").to_numpy(), size))
                    hashes.append(h.flatten().to_numpy())
                if not keys:
                    continue
                k, s, h = np.concatenate(keys), np.concatenate(several), np.concatenate(hashes)
                order = np.argsort(h, kind="stable")
                k, s, h = k[order], s[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                many = (np.minimum.reduceat(k, first) != np.maximum.reduceat(k, first)) | np.logical_or.reduceat(s, first)
                hit = np.repeat(many, np.diff(np.concatenate([first, [len(h)]]))) & ~s
                name, n = np.unique(k[hit], return_counts=True)
                yield from blocks_by_bucket(pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], names=["key_a", "shared"]), id_bucket(name, n_buckets), 0)

        yield from emitted(rows())

    def add(batches):
        for _, own in by_bucket(batches):
            t = pa.concat_tables(unpacked(block) for _, block in own)
            name, where = np.unique(t.column("key_a").to_numpy(), return_inverse=True)
            n = np.zeros(len(name), dtype=np.int64)
            np.add.at(n, where, t.column("shared").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], names=["key_a", "shared"])

    counts = dealt(src.mapInArrow(send, SCHEMA), partitions).mapInArrow(count, SCHEMA)
    return dealt(counts, partitions).mapInArrow(add, "key_a long, shared long")


def token_sets(src: DataFrame, width: int) -> DataFrame:
    """rep (first half of the set's identity), n, tokens (sorted hashes) of (text)."""

    def run(batches):
        for b in batches:
            for part in (b.slice(x, 500) for x in range(0, b.num_rows, 500)):
                sets = sets_of(part, width)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.empty(0, dtype=U64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["rep", "n", "tokens"])

    return src.select("text").mapInArrow(run, "rep long, n long, tokens array<long>")


def choose_boundary(sizes: dict[int, int], percent: int, most: int = 40) -> int:
    """The size up to which enumerating subsets costs less than lists; sizes: how many sets of each size up to most."""

    def light(n: int) -> int:
        return sum(comb(n, k) for k in range(need(n, percent), n + 1))

    def heavy(n: int) -> int:
        return 2 * (n - need(n, percent) + 1) + n

    def cost(x: int) -> int:
        return sum(c * light(n) for n, c in sizes.items() if n <= x) + sum(c * heavy(n) for n, c in sizes.items() if n > x or n >= need(x + 1, percent))

    return min(range(most), key=lambda x: (cost(x), x))


def subsets(light: DataFrame, percent: int) -> DataFrame:
    """rep, n, k, subset of (rep, n, common): hashes of all subsets of common that hold k of the n needed shingles."""

    def run(batches):
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for rep, n, common in zip(b.column("rep").to_pylist(), b.column("n").to_pylist(), b.column("common").to_pylist(), strict=True):
                h = mix(np.array(common, dtype=np.int64).view(U64)).tolist()
                total = sum(h)
                for k in range(need(n, percent), len(h) + 1):
                    for out_of in combinations(h, len(h) - k):
                        s = (total - sum(out_of)) & ((1 << 64) - 1)
                        out.append((rep, n, k, s - (1 << 64) if s >> 63 else s))
            c = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["rep", "n", "k", "subset"])

    return light.mapInArrow(run, "rep long, n long, k long, subset long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    x = pairs.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("common").alias("ta")), "a")
    x = x.join(sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("common").alias("tb")), "b")

    def run(batches):
        for b in batches:
            ta, tb = b.column("ta"), b.column("tb")
            fa, fb, oa, ob = ta.flatten().to_numpy(), tb.flatten().to_numpy(), ta.offsets.to_numpy() - ta.offsets[0].as_py(), tb.offsets.to_numpy() - tb.offsets[0].as_py()
            both = np.array([len(np.intersect1d(fa[oa[r] : oa[r + 1]], fb[ob[r] : ob[r + 1]], assume_unique=True)) for r in range(b.num_rows)], dtype=np.int64)
            union = b.column("na").to_numpy() + b.column("nb").to_numpy() - both
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(100 * both >= percent * union))

    return x.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def possible(na: str, pa_: str, nb: str, pb: str, percent: int) -> str:
    """Whether sets of sizes na and nb that meet at positions pa and pb of their orders may still link."""
    top = f"least({na} - {pa_}, {nb} - {pb})"
    return f"100 * {top} >= {percent} * ({na} + {nb} - {top})"


def list_links(lists: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links that connect all members of inverted lists (token, rep, n, pos) that links connect; known are links found before."""
    lists = written(lists, "jaccard-lists")
    pivot = lists.groupBy("token").agg(F.min(F.struct((F.col("pos") * 1000 / F.col("n")).cast("long").alias("odd"), "rep", "n", "pos")).alias("p"), F.count("*").alias("size")).where("size > 1")
    star = lists.join(pivot, "token").where(f"rep != p.rep AND {possible('n', 'pos', 'p.n', 'p.pos', percent)}")
    first = written(verified(star.select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct(), sets, percent).unionByName(known), "jaccard-links")
    comp = components(first)
    tagged = lists.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = tagged.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token", "size")
    rest = written(tagged.join(mixed, "token"), "jaccard-rest")
    cols = ["token", "rep", "n", "pos", "component"]
    short = rest.where(F.col("size") <= SHORT).select(*cols)
    other = short.select("token", *(F.col(c).alias(f"{c}_b") for c in cols[1:]))
    close = short.join(other, "token").where(f"rep < rep_b AND component != component_b AND {possible('n', 'pos', 'n_b', 'pos_b', percent)}").select(F.col("rep").alias("a"), F.col("rep_b").alias("b"))
    # Long lists: members outside the largest component meet those inside, and each other, in blocks.
    own = rest.where(F.col("size") > SHORT)
    top = own.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"))
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    own = own.join(top, "token").withColumns({"inside": F.col("component") == F.col("top.component"), "ins": blocks_of(F.col("top.c")), "outs": blocks_of(F.col("size") - F.col("top.c"))})
    own = own.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("ins")).otherwise(F.col("outs"))).cast("int"))
    cols_out = [*cols, "inside", "own"]
    among = own.where("NOT inside").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)))
    among = among.select(*cols_out, F.lit(False).alias("across"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    other_side = F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("outs")).otherwise(F.col("ins")) - 1))
    across = own.withColumn("other", other_side).select(*cols_out, F.lit(True).alias("across"), F.when(F.col("inside"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("inside"), F.col("own")).otherwise(F.col("other")).alias("j"))
    long = among.unionByName(across)

    def compare(pdf):
        import pandas as pd

        if pdf["across"].iloc[0]:
            x, y = pdf[~pdf["inside"]], pdf[pdf["inside"]]
        elif pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            x, y = pdf, pdf
        else:
            x, y = pdf[pdf["own"] == pdf["i"]], pdf[pdf["own"] == pdf["j"]]
        out = []
        r2, n2, p2, c2 = (y[c].to_numpy() for c in ("rep", "n", "pos", "component"))
        for r, n, p, c in zip(*(x[c].to_numpy() for c in ("rep", "n", "pos", "component")), strict=True):
            top = np.minimum(n - p, n2 - p2)
            hit = (c2 != c) & (100 * top >= percent * (n + n2 - top))
            if y is pdf:
                hit &= r2 > r
            out.append(np.stack([np.minimum(r, r2[hit]), np.maximum(r, r2[hit])], axis=1))
        both = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), dtype=np.int64)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    far = long.groupBy("token", "across", "i", "j").applyInPandas(compare, "a long, b long")
    return first.unionByName(verified(close.unionByName(far).distinct(), sets, percent))


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the Jaccard links among sets (rep, n, tokens) connect."""
    tok = sets.select("rep", F.explode("tokens").alias("token"))
    held = tok.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    common = tok.join(held, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("c"))
    own = sets.select("rep", "n").join(common, "rep").where(f"100 * size(c) >= {percent} * n")
    own = written(own.select("rep", "n", F.transform("c", lambda x: x["token"]).alias("common")), "jaccard-sets")
    sizes = {r[0]: r[1] for r in own.where("n <= 40").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, percent)
    part = subsets(own.where(F.col("n") <= boundary), percent)
    low = part.groupBy("k", "subset").agg(F.min(F.struct("n", "rep")).alias("low"), F.count("*").alias("c")).where("c > 1")
    stars = part.join(low, ["k", "subset"]).where(f"rep != low.rep AND 100 * k >= {percent} * (n + low.n - k)")
    stars = stars.select(F.col("low.rep").alias("a"), F.col("rep").alias("b")).distinct()
    # Positions count the shingles that no other class holds first.
    alone = F.col("n") - F.size("common")
    prefix = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    large = own.where(F.col("n") >= need(boundary + 1, percent)).withColumn("alone", alone).withColumn("take", (prefix - alone).cast("int")).where("take > 0")
    lists = large.select("rep", "n", "alone", F.posexplode(F.slice("common", F.lit(1), F.col("take"))).alias("i", "token")).select("token", "rep", "n", (F.col("alone") + F.col("i")).alias("pos"))
    return list_links(lists, own, verified(stars, own, percent), percent)


def groups(docs: DataFrame, width: int = 3, percent: int = 90, bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, own_id, mark, n_shingles, component (names the linked group; null for an empty set), component_id of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    src = parallel(marked(docs))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = buckets_for(text_bytes(docs), bucket_bytes, spark.sparkContext.defaultParallelism)
    rows = written(set_rows(src, width), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "own_id", "mark", "doc_id"))
    classes = written(rows.where("n > 0").groupBy("n", "key_a", "key_b").agg(first.alias("f")).select("n", "key_a", "key_b", "f.own_id", "f.mark", F.col("f.doc_id").alias("first")), "jaccard-classes")
    counts = shared_counts(src.select("text"), width, n_buckets, max(parts, n_buckets))
    open_ = written(classes.join(counts, "key_a").where(f"100 * shared >= {percent} * n").select("own_id", "mark"), "jaccard-open")
    del counts
    release(spark)
    few = open_.count() <= SMALL
    picked = marked(docs).join(F.broadcast(open_) if few else open_, ["own_id", "mark"], "left_semi")
    # Rows that repeat an id and its text give one set.
    sets = written(token_sets(picked, width).dropDuplicates(["rep"]), "jaccard-tokens")
    comp = components(class_links(sets, percent)).withColumnRenamed("node", "key_a")
    del sets
    named = comp.join(classes.select("key_a", "first"), "key_a").groupBy("component").agg(F.min("first").alias("least"))
    found = classes.join(comp.join(named, "component"), "key_a", "left")
    found = found.select("n", "key_a", "key_b", F.coalesce("component", "key_a").alias("component"), F.coalesce("least", "first").alias("component_id"))
    cols = ["doc_id", "own_id", "mark", F.col("n").alias("n_shingles"), "component", "component_id"]
    out = rows.where("n > 0").join(found, ["n", "key_a", "key_b"]).select(*cols)
    empty = rows.where("n = 0").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return out.unionByName(empty.select(*cols))


def linked(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text)."""
    return groups(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def without_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each linked group: that with the smallest doc_id, ids before none. Rows without words all stay."""
    g = groups(docs, width, percent).where("n_shingles > 0").groupBy("component", "own_id", "mark").agg(F.count("*").alias("copies"))
    g = written(g, "jaccard-texts")
    rank = F.struct((F.col("own_id") == NO_ID).alias("none"), "own_id", "mark")
    first = g.groupBy("component").agg(F.min(rank).alias("f"), F.count("*").alias("texts"))
    best = F.col("own_id").eqNullSafe(F.col("f.own_id")) & (F.col("mark") == F.col("f.mark"))
    gone = written(g.join(first.where("texts > 1"), "component").where(~best).select("own_id", "mark").distinct(), "jaccard-gone")
    again = written(g.where("copies > 1").select("own_id", "mark").distinct(), "jaccard-again")
    # The caller's columns travel as one struct: they may have any names.
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own_row")
    src = docs.select(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("own_id"), F.xxhash64("text").alias("mark"))
    few = lambda t, n: F.broadcast(t) if n <= SMALL else t
    left = src.join(few(gone, gone.count()), ["own_id", "mark"], "left_anti")
    n = again.count()
    if n:
        rows = left.join(few(again, n), ["own_id", "mark"], "left_semi").groupBy("own_id", "mark").agg(F.min_by("own_row", F.xxhash64(F.to_json("own_row"))).alias("own_row"))
        left = left.join(few(again, n), ["own_id", "mark"], "left_anti").select("own_row").unionByName(rows.select("own_row"))
    return left.select(*(F.col("own_row").getField(c).alias(c) for c in docs.columns))


def op2_ngram_jaccard(spark, sf_dir):
    return linked(table(spark, sf_dir, "documents"))
