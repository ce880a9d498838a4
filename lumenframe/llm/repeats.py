"""Exact removal of repeated passages: a depth-limited radix sort of suffixes.

Only the first ``width`` bytes of a suffix are ever compared, by most-significant-digit passes
that drop a suffix as soon as its group lies in one document:

* Pass 1 takes as digit the hash of the smallest of the suffix's ``ANCHOR``-byte strings within
  its first ``width`` bytes. Equal windows have equal digits, runs of neighbouring suffixes
  share one digit and travel as one record, and only (digit, text) is shuffled. Digits seen in
  one text alone end there.
* Pass 2 sends the windows of the surviving digits, as runs of text, to the digit's bucket.
  There the suffixes are sorted by further digits of eight bytes down to ``width``. The groups
  left are exactly the repeated windows; all but those of the smallest doc_id are removed.

Hot groups: copies of a whole text collapse within a batch and are settled by one aggregation;
a digit or a run of text that many documents share is sent once for each batch, because the
task itself then knows the answer for the batch's other documents. So a bucket gets at most one
record for each batch (12 MB of text, or less) and passage; beyond 100,000 batches the records of a
bucket are first combined in parts (``fan``). Texts move as compressed blocks.

Texts are told apart by 64-bit hashes: among ten billion different texts about three pairs
may be taken for copies.

Defined results: a null text counts as empty; a text shorter than ``width`` loses nothing, one of
any length is compared whole; rows equal in doc_id are one document for comparisons and are
each reported; rows without doc_id come after all others; other columns may have any names: those to
keep travel as one struct (own_row); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenframe.llm.common import drop_written, forget, parallel, release, row_struct, table, written
from lumenframe.llm.kernels import U64, blocks, joined, mix, prefix_hash, slide_min_argmin, window_hash
from lumenframe.llm.moving import SCHEMA, blocks_by_bucket, buckets_for, by_bucket, dealt, emitted, gathered, id_bucket, packed, text_bytes, unpacked

ANCHOR = 24
LAST = np.iinfo(np.int64).max
#: Bytes of text for which the records of a bucket are combined in one more part: 100,000 batches.
COMBINED = 100_000 * (12 << 20)


def runs(buf: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, digit and text of each run of windows with one smallest anchor string."""
    h = window_hash(prefix_hash(buf), ANCHOR)
    low = slide_min_argmin(h, width - ANCHOR + 1)
    n = len(low)
    if n <= 0:
        e = np.empty(0, dtype=np.int64)
        return e, e, e.view(U64), e
    inside = np.zeros(n + 1, dtype=np.int8)
    first, stop = at[:-1], at[1:] - 1 - width + 1  # windows of a text start in [first, stop)
    has = stop > first
    np.add.at(inside, first[has], 1)
    np.add.at(inside, np.minimum(stop[has], n), -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(start):
        e = np.empty(0, dtype=np.int64)
        return e, e, e.view(U64), e
    own = low[start]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    begin = start[new]
    count = np.diff(np.concatenate([new, [len(start)]]))
    # Smallest hashes are small numbers; mixed again they spread over the buckets evenly.
    return begin, count, mix(h[own[new]]), np.searchsorted(at, begin, side="right") - 1


def digit_bucket(digit: np.ndarray, n: int) -> np.ndarray:
    return (((digit >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


def short_digit(digit: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The digit as pass 1 tells it apart: its bucket and 32 further bits."""
    return (bucket.astype(U64) << U64(32)) | (digit & U64(0xFFFFFFFF))


def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
    """text_key, ids (sorted, null last), text, and lists of any other columns: one row for each distinct text of a batch."""
    key = batch.column("text_key").to_numpy(zero_copy_only=False)
    ids = batch.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, key))
    edge = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.empty(0, dtype=bool)
    first = np.flatnonzero(edge)
    offsets = np.concatenate([first, [len(order)]]).astype(np.int32)
    other = [c for c in batch.schema.names if c not in ("text_key", "doc_id", "text")]
    lists = [pa.ListArray.from_arrays(pa.array(offsets), batch.column(c).take(pa.array(order))) for c in other]
    return pa.RecordBatch.from_arrays([pa.array(key[order[first]]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[order])), batch.column("text").take(pa.array(order[first])), *lists], names=["text_key", "ids", "text", *other])


def raw_texts(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    own = [row_struct(docs, list(keep))] if keep else []
    return parallel(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *own)).withColumn("text_key", F.xxhash64("text"))


def moved_texts(src: DataFrame, n: int) -> DataFrame:
    def run(batches):
        def rows():
            for b in gathered(batches):
                g = grouped(b)
                yield from blocks_by_bucket(g, id_bucket(g.column("text_key").to_numpy(), n), 1)

        yield from emitted(rows())

    return src.mapInArrow(run, SCHEMA)


def first_pass(src: DataFrame, width: int, n_digit: int, n_text: int) -> DataFrame:
    """Blocks of kind 1 for digit buckets: (text_key, digits); of kind 0 for text buckets: (text_key, digits known to be shared)."""

    def lists(keys, owner, values, names):
        """One row for each owner, sorted."""
        order = np.argsort(owner, kind="stable")
        o = owner[order]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.empty(0, dtype=np.int64)
        offsets = np.concatenate([first, [len(o)]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys[o[first]]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order]))], names=names)

    def flush(keys: np.ndarray, digit: np.ndarray, owner: np.ndarray):
        order = np.lexsort((owner, digit))
        digit, owner = digit[order], owner[order]
        fresh = np.concatenate([[True], (digit[1:] != digit[:-1]) | (owner[1:] != owner[:-1])])
        digit, owner = digit[fresh], owner[fresh]
        new = np.concatenate([[True], digit[1:] != digit[:-1]])
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1
        bucket = digit_bucket(digit, n_digit)
        # To the digit's bucket: the text where it is the only one here, else once without a text.
        send = new | ~shared
        for b in np.unique(bucket):
            own = send & (bucket == b)
            who = np.where(shared[own], len(keys), owner[own])
            block = lists(np.concatenate([keys, np.zeros(1, dtype=np.int64)]), who, (digit[own] & U64(0xFFFFFFFF)).astype(np.uint32), ["text_key", "digits"])
            # An added column tells whether a row stands for several texts.
            several = np.zeros(block.num_rows, dtype=bool)
            if (who == len(keys)).any():
                several[-1] = True
            yield int(b), 1, packed(block.append_column("several", pa.array(several)))
        if shared.any():
            block = lists(keys, owner[shared], short_digit(digit[shared], bucket[shared]), ["text_key", "digits"])
            yield from blocks_by_bucket(block, id_bucket(block.column("text_key").to_numpy(), n_text), 0)

    def run(batches):
        def rows():
            for b in gathered(batches):
                g = grouped(b)
                keys = g.column("text_key").to_numpy()
                digits, owners, held = [], [], 0
                for p in range(0, g.num_rows, 500):
                    texts = raw_texts(g.column("text").slice(p, 500))
                    for i, j in blocks(texts):
                        buf, at = joined(texts[i:j])
                        _, _, d, own = runs(buf, at, width)
                        digits.append(d)
                        owners.append(own + i + p)
                        held += len(d)
                    if held > 1_000_000:
                        yield from flush(keys, np.concatenate(digits), np.concatenate(owners))
                        digits, owners, held = [], [], 0
                if held:
                    yield from flush(keys, np.concatenate(digits), np.concatenate(owners))

        forget()
        yield from emitted(rows())

    return src.mapInArrow(run, SCHEMA)


def shared_digits(anchors: DataFrame, partitions: int, n_text: int) -> DataFrame:
    """Blocks of kind 0 for text buckets: the digits of a text that other texts hold too."""

    def run(batches):
        def rows():
            for bucket, own in by_bucket(batches):
                keys, digits, several = [], [], []
                for _, block in own:
                    t = unpacked(block).combine_chunks()
                    size = t.column("digits").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
                    keys.append(np.repeat(t.column("text_key").to_numpy(), size))
                    several.append(np.repeat(t.column("several").to_numpy(), size))
                    digits.append(t.column("digits").combine_chunks().flatten().to_numpy())
                k, d, s = np.concatenate(keys), np.concatenate(digits), np.concatenate(several)
                order = np.argsort(d, kind="stable")
                k, d, s = k[order], d[order], s[order]
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                many = np.minimum.reduceat(k, first) != np.maximum.reduceat(k, first)
                many |= np.logical_or.reduceat(s, first)
                hit = np.repeat(many, np.diff(np.concatenate([first, [len(d)]]))) & ~s
                k, d = k[hit], (U64(bucket) << U64(32)) | d[hit].astype(U64)
                if not len(k):
                    continue
                order = np.argsort(k, kind="stable")
                k, d = k[order], d[order]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                block = pa.RecordBatch.from_arrays([pa.array(k[first]), pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(k)]]).astype(np.int32)), pa.array(d))], names=["text_key", "digits"])
                yield from blocks_by_bucket(block, id_bucket(block.column("text_key").to_numpy(), n_text), 0)

        yield from emitted(rows())

    return dealt(anchors.where("kind = 1"), partitions).mapInArrow(run, SCHEMA)


def first_ids(src: DataFrame, n_text: int) -> DataFrame:
    """Blocks of kind -1 for text buckets: the smallest id of each text that occurs more than once."""
    own = src.groupBy("text_key").agg(F.min("doc_id").cast("long").alias("first"), F.count("*").alias("n")).where("n > 1").select("text_key", F.coalesce("first", F.lit(int(LAST))).alias("first"))

    def run(batches):
        def rows():
            for b in batches:
                yield from blocks_by_bucket(b, id_bucket(b.column("text_key").to_numpy(), n_text), -1)

        yield from emitted(rows())

    return own.mapInArrow(run, SCHEMA)


def settled(key: np.ndarray, ids: np.ndarray, start: np.ndarray, text: list[bytes], bucket: np.ndarray):
    """Blocks of kind 1: of equal runs that of the smallest document; of kind 0 with bucket 0: spans known to be removed."""
    kept: dict[bytes, int] = {}
    for r in np.argsort(ids, kind="stable").tolist():
        kept.setdefault(text[r], r)
    best = np.array([kept[t] for t in text], dtype=np.int64)
    # Another document here has the same run and a smaller id; runs of one and the same document may be equal too.
    gone = ids[best] < ids
    t = pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(text, pa.binary())], names=["text_key", "doc_id", "start", "run"])
    yield from blocks_by_bucket(t.filter(pa.array(~gone)), bucket[~gone], 1)
    if gone.any():
        s = pa.RecordBatch.from_arrays([pa.array(key[gone]), pa.array(start[gone].astype(np.int32)), pa.array(np.array([len(text[r]) for r in np.flatnonzero(gone)], dtype=np.int32))], names=["text_key", "start", "length"])
        yield from blocks_by_bucket(s, np.zeros(s.num_rows, dtype=np.int32), 0)


def combined(windows: DataFrame, partitions: int, fan: int) -> DataFrame:
    """As windows, after the records of each bucket met in ``fan`` parts: a passage that is everywhere goes on once for each part."""

    def run(batches):
        def rows():
            for part, own in by_bucket(batches):
                keys, ids, starts, texts = [], [], [], []
                for _, block in own:
                    t = unpacked(block).combine_chunks()
                    keys.append(t.column("text_key").to_numpy())
                    ids.append(t.column("doc_id").to_numpy())
                    starts.append(t.column("start").to_numpy())
                    texts.extend(t.column("run").to_pylist())
                yield from settled(np.concatenate(keys), np.concatenate(ids), np.concatenate(starts), texts, np.full(len(texts), part // fan, dtype=np.int32))

        yield from emitted(rows())

    part = F.col("bucket") * fan + F.pmod(F.xxhash64("block"), F.lit(fan)).cast("int")
    met = dealt(windows.where("kind = 1").withColumn("bucket", part), partitions).mapInArrow(run, SCHEMA)
    return met.unionByName(windows.where("kind = 0"))


def windows_of(side: DataFrame, texts: DataFrame, partitions: int, width: int, n_digit: int) -> DataFrame:
    """Blocks of kind 1 for digit buckets: runs of text (text_key, doc_id, start, run); of kind 0: spans known to be removed."""

    def run(batches):
        def rows():
            for _, own in by_bucket(batches):
                first: dict[int, int] = {}
                shared: dict[int, list] = {}
                seen: set[int] = set()
                cols, held = [[], [], [], [], []], 0
                for kind, block in own:
                    t = unpacked(block).combine_chunks()
                    if kind == -1:
                        first.update(zip(t.column("text_key").to_pylist(), t.column("first").to_pylist(), strict=True))
                        continue
                    if kind == 0:
                        d = t.column("digits").combine_chunks()
                        flat, off = d.flatten().to_numpy(), d.offsets.to_numpy()
                        for r, k in enumerate(t.column("text_key").to_pylist()):
                            shared.setdefault(k, []).append(flat[off[r] - off[0] : off[r + 1] - off[0]])
                        continue
                    keys, ids = t.column("text_key").to_pylist(), [x[0] for x in t.column("ids").to_pylist()]
                    use = [r for r, k in enumerate(keys) if k in shared and k not in seen and first.get(k, ids[r]) == ids[r]]
                    seen.update(keys[r] for r in use if keys[r] in first)
                    texts = raw_texts(t.column("text").take(pa.array(use, pa.int64())))
                    for i, j in blocks(texts):
                        buf, at = joined(texts[i:j])
                        begin, count, digit, who = runs(buf, at, width)
                        bucket = digit_bucket(digit, n_digit * 4)
                        short = short_digit(digit, digit_bucket(digit, n_digit))
                        # One look-up for the whole block: (text, digit) pairs mixed into one number; a false hit only costs a record.
                        want = np.concatenate([mix(np.concatenate(shared[keys[use[i + x]]])) ^ mix(np.array([x + 1], dtype=U64)) for x in range(j - i)])
                        hit = np.isin(mix(short) ^ mix((who + 1).astype(U64)), want)
                        if not hit.any():
                            continue
                        begin, count, who, bucket = begin[hit], count[hit], who[hit], bucket[hit]
                        raw = buf.tobytes()
                        cols[0].append(np.array([keys[use[i + x]] for x in who.tolist()], dtype=np.int64))
                        cols[1].append(np.array([ids[use[i + x]] for x in who.tolist()], dtype=np.int64))
                        cols[2].append(begin - at[who])
                        cols[3].append([raw[s : s + c + width - 1] for s, c in zip(begin.tolist(), count.tolist(), strict=True)])
                        cols[4].append(bucket)
                        held += len(begin)
                        if held > 100_000:
                            yield from settled(*(np.concatenate(c) if k != 3 else [x for y in c for x in y] for k, c in enumerate(cols)))
                            cols, held = [[], [], [], [], []], 0
                if held:
                    yield from settled(*(np.concatenate(c) if k != 3 else [x for y in c for x in y] for k, c in enumerate(cols)))

        forget()
        yield from emitted(rows())

    return dealt(side.unionByName(texts), partitions, ordered=True).mapInArrow(run, SCHEMA)


def radix_groups(buf: np.ndarray, start: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of windows whose width bytes occur in several documents, and their group; by passes over digits of eight bytes."""
    words = np.ndarray(shape=(len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))
    live, group = np.arange(len(start), dtype=np.int32), None
    offsets = [*range(0, width - 7, 8)] + ([width - 8] if width % 8 else [])
    for off in offsets:
        if not len(live):
            break
        digit = words[start[live] + off].astype(U64)
        order = np.argsort(digit) if group is None else np.lexsort((digit, group))
        digit, live = digit[order], live[order]
        new = np.empty(len(live), dtype=bool)
        new[0] = True
        np.not_equal(digit[1:], digit[:-1], out=new[1:])
        if group is not None:
            group = group[order]
            new[1:] |= group[1:] != group[:-1]
        del digit, order
        first = np.flatnonzero(new)
        own = doc[live]
        many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        group = np.cumsum(new, dtype=np.int32) - 1
        keep = many[group]
        live, group = live[keep], group[keep]
    return live, np.zeros(0, dtype=np.int32) if group is None else group


def repeated_spans(windows: DataFrame, partitions: int, width: int, n_text: int) -> DataFrame:
    """Blocks of kind 0 for text buckets: spans (text_key, start, length) to remove."""

    def merged(key, start, length):
        order = np.lexsort((start, key))
        key, start, end = key[order], start[order].astype(np.int64), (start + length)[order].astype(np.int64)
        # All have one length, so the ends of a text are sorted as its starts are.
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > end[:-1])])
        first = np.flatnonzero(new)
        return key[first], start[first].astype(np.int32), (np.maximum.reduceat(end, first) - start[first]).astype(np.int32)

    def run(batches):
        def rows():
            for _, own in by_bucket(batches):
                keys, docs, starts, texts = [], [], [], []
                for _, block in own:
                    t = unpacked(block).combine_chunks()
                    keys.append(t.column("text_key").to_numpy())
                    docs.append(t.column("doc_id").to_numpy())
                    starts.append(t.column("start").to_numpy())
                    texts.extend(t.column("run").to_pylist())
                key, doc, at = np.concatenate(keys), np.concatenate(docs), np.concatenate(starts)
                del keys, docs, starts
                # Of equal runs only that of the smallest document is sorted; the others go whole.
                known: dict[bytes, int] = {}
                for r in np.argsort(doc, kind="stable").tolist():
                    known.setdefault(texts[r], r)
                gone = doc[np.array([known[x] for x in texts], dtype=np.int64)] < doc
                if gone.any():
                    out = pa.RecordBatch.from_arrays([pa.array(key[gone]), pa.array(at[gone]), pa.array(np.array([len(texts[r]) for r in np.flatnonzero(gone)], dtype=np.int32))], names=["text_key", "start", "length"])
                    yield from blocks_by_bucket(out, id_bucket(key[gone], n_text), 0)
                    texts = [texts[r] for r in np.flatnonzero(~gone).tolist()]
                    key, doc, at = key[~gone], doc[~gone], at[~gone]
                del known
                size = np.array([len(x) for x in texts], dtype=np.int64)
                buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
                del texts
                at, rank = at.astype(np.int64), np.unique(doc, return_inverse=True)[1].astype(np.int32)
                # A window is told by its run and its place; ids count by rank only.
                count, begin = size - width + 1, np.cumsum(size) - size
                run_of = np.repeat(np.arange(len(size), dtype=np.int32), count)
                place = np.arange(int(count.sum()), dtype=np.int64) + np.repeat(begin - (np.cumsum(count) - count), count)
                doc = rank[run_of]
                live, group = radix_groups(buf, place, doc, width)
                if not len(live):
                    continue
                first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                least = np.repeat(np.minimum.reduceat(doc[live], first), np.diff(np.concatenate([first, [len(live)]])))
                gone = live[doc[live] > least]
                if not len(gone):
                    continue
                own_run = run_of[gone]
                k, s, n = merged(key[own_run], at[own_run] + place[gone] - begin[own_run], np.full(len(gone), width, dtype=np.int64))
                out = pa.RecordBatch.from_arrays([pa.array(k), pa.array(s), pa.array(n)], names=["text_key", "start", "length"])
                yield from blocks_by_bucket(out, id_bucket(k, n_text), 0)

        forget()
        yield from emitted(rows())

    return dealt(windows.where("kind = 1"), partitions).mapInArrow(run, SCHEMA)


def rebucketed(spans: DataFrame, n_text: int) -> DataFrame:
    def run(batches):
        def rows():
            for b in batches:
                for block in b.column("block").to_pylist():
                    for t in unpacked(block).combine_chunks().to_batches():
                        yield from blocks_by_bucket(t, id_bucket(t.column("text_key").to_numpy(), n_text), 0)

        yield from emitted(rows())

    return spans.mapInArrow(run, SCHEMA)


def cleaned(side: DataFrame, texts: DataFrame, partitions: int, width: int, with_text: bool, own_row: StructType) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes), and the fields of own_row, of every row."""
    keep = own_row.names

    def run(batches):
        for _, own in by_bucket(batches):
            first: dict[int, int] = {}
            spans: dict[int, list[tuple[int, int]]] = {}
            for kind, block in own:
                t = unpacked(block).combine_chunks()
                if kind == -1:
                    first.update(zip(t.column("text_key").to_pylist(), t.column("first").to_pylist(), strict=True))
                    continue
                if kind == 0:
                    for k, s, n in zip(*(t.column(c).to_pylist() for c in ("text_key", "start", "length")), strict=True):
                        spans.setdefault(k, []).append((s, s + n))
                    continue
                if not t.num_rows:
                    continue
                rows = []
                for k, ids, text in zip(t.column("text_key").to_pylist(), t.column("ids").to_pylist(), t.column("text").to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    left, at, n = [], 0, 0
                    end = -1
                    for s, e in sorted(spans.get(k, ())):
                        if s > end:
                            n += 1
                            left.append(raw[at:s])
                        end = at = max(end, e)
                    left.append(raw[at:])
                    kept = b"".join(left)
                    sha, lost = hashlib.sha256(kept).hexdigest(), len(raw) - len(kept)
                    low = first.get(k, ids[0])
                    for i in ids:
                        if i > low and len(raw) >= width:
                            rows.append((i, len(raw), len(raw), 1, EMPTY, b""))
                        else:
                            rows.append((i, len(raw), lost, n, sha, kept))
                c = list(zip(*rows, strict=True))
                arrays = [pa.array([None if x == LAST else x for x in c[0]], pa.int64()), *(pa.array(x, pa.int64()) for x in c[1:4]), pa.array(c[4], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array(c[5], pa.binary()))
                    names.append("kept")
                arrays += [t.column(name).combine_chunks().flatten() for name in keep]
                names += keep
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    schema = StructType([*schema.fields, *own_row.fields])
    return dealt(side.unionByName(texts), partitions, ordered=True).mapInArrow(run, schema)


EMPTY = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, width: int = 50, with_text: bool = False, keep: tuple[str, ...] = (), bucket_bytes: int = 16 << 20, fan: int | None = None) -> DataFrame:
    """What is left of (doc_id long, text) without the bytes covered by a width-byte string that also starts in a document with a smaller doc_id; the columns to keep come back as the struct own_row."""
    if width < ANCHOR + 8:
        raise ValueError(f"width must be at least {ANCHOR + 8}")
    spark = docs.sparkSession
    src = keyed(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = text_bytes(docs)
    # Tasks times buckets is the number of blocks: buckets follow the bytes of text, not the number of partitions.
    cores = spark.sparkContext.defaultParallelism
    n_text = buckets_for(total, bucket_bytes, cores)
    n_digit = buckets_for(total, bucket_bytes * 3 // 2, cores)
    fan = fan or buckets_for(total, COMBINED, 1)
    firsts = written(first_ids(src, n_text), "repeats-firsts", "none")
    anchors = written(first_pass(src, width, n_digit, n_text), "repeats-anchors", "none")
    known = written(shared_digits(anchors, max(parts, n_digit), n_text), "repeats-digits", "none")
    release(spark)
    side = firsts.unionByName(known).unionByName(anchors.where("kind = 0"))
    windows = written(windows_of(side, moved_texts(src, n_text), max(parts, n_text), width, n_digit), "repeats-windows", "none")
    del side
    drop_written(anchors, known)
    release(spark)
    met = combined(windows, max(parts, n_digit * 4), fan) if fan > 1 else windows
    if fan > 1:
        met = written(met, "repeats-combined", "none")
        drop_written(windows)
    spans = written(repeated_spans(met, max(parts, n_digit * 4), width, n_text).unionByName(rebucketed(met.where("kind = 0"), n_text)), "repeats-spans", "none")
    drop_written(met)
    release(spark)
    src = keyed(docs, keep)
    own_row = StructType([f for f in src.schema.fields if f.name == "own_row"])
    return cleaned(firsts.unionByName(spans), moved_texts(src, n_text), max(parts, n_text), width, with_text, own_row)


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
