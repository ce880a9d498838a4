"""Phrase collocations by merged count-min sketches and an exact second pass.

1. Each batch of texts hashes all its phrases of 1 to ``longest`` words and counts them in the cells of ``DEPTH`` rows
   of a count-min sketch. A batch sends only the cells that it meets, by segments of a row; segments are added up
   where they meet, so sketches merge in any order. A cell holds all phrases that fall to it, so it
   overestimates: a phrase with a light cell can't be frequent.
2. The merged sketch shrinks to a bit for each cell, heavy or light, and goes to all tasks. A second pass over the
   texts counts exactly, as text, only phrases all of whose cells are heavy; counts move as sorted, compressed blocks. No frequent phrase is lost, and what
   is not frequent after all goes by its exact count.
3. Candidates are joined with the counts of both parts of each of their cuts, scored in exact decimals, and
   compared with the longer candidates that hold them; the best of a language are kept by levels.

The sketch has about a cell a row for every CELL_BYTES bytes of text, up to 2^MOST_BITS cells a row, so the broadcast bitmaps have at
most DEPTH * 2^MOST_BITS / 8 bytes (128 MB). Beyond some 8 GB of text cells fill up, the filter
lets more pass, and in the end all phrases are aggregated exactly: results are the same, only the second shuffle grows.

Joins on parts have hot keys (a frequent word begins many phrases); they are plain joins of two shuffled tables,
whose large partitions Spark splits. Counts, maxima and best lists are aggregated before they are shuffled.

Defined results: null text has no words, null lang counts as ``und``; ties as in the contract (smallest cut; more
frequent phrase, then bytes of the phrase); phrases never cross a separator or a document; texts of any length are
counted whole; repeated rows count each; other columns are ignored, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import drop_written, forget, parallel, table, written
from lumenframe.llm.kernels import BASE, MIX_2, U64, lower_ascii, mix, prefix_hash, span_hash
from lumenframe.llm.moving import blocks_by_bucket, buckets_for, by_bucket, emitted, gathered, text_bytes, unpacked

DEPTH = 2
#: Cells of a segment, and the least and most cells of a row, as powers of two.
SEGMENT_BITS, LEAST_BITS, MOST_BITS = 18, 18, 29
#: Bytes of text to a cell of a row: some five phrases fall to a cell, and few light ones have a heavy cell in both rows.
CELL_BYTES = 16
#: Bytes of text that a task looks at together; longer texts are cut at separators.
BATCH = 6 << 20
#: Hashes that a task gathers before it sends their cells.
HELD = 12_000_000
#: Rows of phrases and counts that are added up together before they are sent or kept, and bytes of text to a bucket of them.
HELD_ROWS, BUCKET = 1_000_000, 16 << 20
#: Rows of a group from which a level of the best is taken.
GROUP = 1 << 16

BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True


def cut_long(text: bytes, most: int = BATCH) -> list[bytes]:
    """A text in parts of about ``most`` bytes, cut at separators."""
    if len(text) <= most:
        return [text]
    at = np.flatnonzero(BREAK[np.frombuffer(text, dtype=np.uint8)])
    out, start = [], 0
    while len(text) - start > most:
        k = np.searchsorted(at, start + most)
        if k == len(at):
            break
        out.append(text[start : at[k]])
        start = int(at[k])
    return [*out, text[start:]]


class Words:
    """The words of a batch of (lang, text): ids into a dictionary, the piece and the language of each."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.langs = sorted(set(langs))
        where = {x: i for i, x in enumerate(self.langs)}
        buf = lower_ascii(np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8))
        word = np.zeros(len(buf) + 2, dtype=bool)
        np.logical_not(GAP[buf], out=word[1:-1])
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[0::2], edge[1::2]
        self.piece = np.cumsum(BREAK[buf], dtype=np.int32)[starts] if len(buf) else np.empty(0, dtype=np.int32)
        at = np.cumsum([len(t) + 1 for t in texts])
        self.lang = np.array([where[x] for x in langs], dtype=np.int64)[np.searchsorted(at, starts, side="right")]
        offsets = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        every = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[word[1:-1]].tobytes())]).dictionary_encode()
        self.id = every.indices.to_numpy().astype(np.int64)
        self.words = every.dictionary
        # Codes of the words, and of the languages.
        own = np.frombuffer(b"".join(self.words.to_pylist()), dtype=np.uint8)
        upto = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(pc.binary_length(self.words).to_numpy(), out=upto[1:])
        self.code = span_hash(prefix_hash(own), upto[:-1], upto[1:])[self.id] if len(own) else np.empty(0, dtype=U64)
        raw = [x.encode() for x in self.langs]
        lang_at = np.cumsum([0, *map(len, raw)])
        self.salt = mix(span_hash(prefix_hash(np.frombuffer(b"".join(raw), dtype=np.uint8)), lang_at[:-1], lang_at[1:]) ^ U64(MIX_2))

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of n words start, and their hashes."""
        m = len(self.id) - n + 1
        if m <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
        at = np.flatnonzero(self.piece[:m] == self.piece[n - 1 :])
        h = self.salt[self.lang[at]]
        for k in range(n):
            h = h * U64(BASE) + self.code[at + k]
        return at, mix(h)

    def packed(self, at: np.ndarray, n: int) -> tuple[np.ndarray, list]:
        """One integer for each phrase of n words, exactly, and the steps that made it: parts are ranked first where they would not fit."""
        key, size, steps = self.lang[at], max(1, len(self.langs)), []
        for k in range(n):
            if size * len(self.words) >= 1 << 62:
                kinds, key = np.unique(key, return_inverse=True)
                steps.append(kinds)
                size = len(kinds)
            key = key * len(self.words) + self.id[at + k]
            size *= len(self.words)
            steps.append(len(self.words))
        return key, steps

    def counted(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """lang, phrase and f of the phrases that start at places."""
        key, steps = self.packed(at, n)
        key, f = np.unique(key, return_counts=True)
        ids = []
        for s in reversed(steps):
            if isinstance(s, int):
                key, own = np.divmod(key, s)
                ids.append(own)
            else:
                key = s[key]
        parts = [self.words.take(pa.array(x)) for x in reversed(ids)]
        phrase = pc.binary_join_element_wise(*parts, b" ") if n > 1 else parts[0]
        return counts_batch(pa.array(self.langs, pa.string()).take(pa.array(key)), phrase.cast(pa.string()), f)


def counts_batch(lang: pa.Array, phrase: pa.Array, f) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(f, pa.int64())], names=["lang", "phrase", "f"])


def batches_of_words(batches):
    for b in gathered(batches, BATCH):
        langs, texts = [], []
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            for part in cut_long(t.encode("utf-8", "surrogatepass")):
                langs.append(lang)
                texts.append(part)
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BATCH or i == len(texts) - 1:
                yield Words(langs[start : i + 1], texts[start : i + 1])
                start, size = i + 1, 0


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h >> U64(32 * row)) & U64((1 << bits) - 1)).astype(np.uint32)


def block_of(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places within a segment as gaps, byte by byte, and counts; compressed."""
    gaps = np.diff(places.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    raw = gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts.tobytes()
    return len(places).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def added(total: np.ndarray, block: bytes) -> None:
    n, size = int.from_bytes(block[:4], "little"), int.from_bytes(block[4:8], "little")
    raw = np.frombuffer(pa.decompress(block[8:], decompressed_size=size, codec="zstd"), dtype=np.uint8)
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    total[np.cumsum(gaps)] += raw[4 * n :].view("<u4" if len(raw) == 8 * n else np.uint8)


def sketch(docs: DataFrame, least: int, longest: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged sketch a bitmap of its heavy cells, of docs (lang, text)."""
    segments = 1 << bits - SEGMENT_BITS
    # What a batch has beyond ``least`` tells nothing more: its cell is heavy.
    kind = np.uint8 if least <= 255 else np.dtype("<u4")

    def run(batches):
        forget()

        def blocks():
            held, n = [], 0
            for w in batches_of_words(batches):
                held += [w.phrases(n)[1] for n in range(1, longest + 1)]
                n = sum(map(len, held))
                if n >= HELD:
                    yield from blocks_of(held)
                    held = []
            yield from blocks_of(held)

        def blocks_of(held):
            for row in range(DEPTH if held else 0):
                cell = np.concatenate([cells(h, row, bits) for h in held])
                cell.sort()
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, dtype=np.int64)
                n = np.minimum(np.diff(first, append=len(cell)), least).astype(kind)
                cell = cell[first]
                edge = np.searchsorted(cell, np.arange(segments + 1, dtype=np.int64) << SEGMENT_BITS)
                for s in np.flatnonzero(np.diff(edge)).tolist():
                    i, j = edge[s], edge[s + 1]
                    yield row * segments + s, 0, block_of(cell[i:j] & np.uint32((1 << SEGMENT_BITS) - 1), n[i:j])

        yield from emitted(blocks())

    def merge(batches):
        for bucket, rows in by_bucket(batches):
            total = np.zeros(1 << SEGMENT_BITS, dtype=np.uint32)
            for _, block in rows:
                added(total, block)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["bucket", "heavy"])

    parts = min(DEPTH * segments, max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = docs.mapInArrow(run, "bucket int, kind int, block binary")
    merged = blocks.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, heavy binary")
    out = np.zeros((DEPTH * segments, (1 << SEGMENT_BITS) // 8), dtype=np.uint8)
    for bucket, heavy in merged.toLocalIterator():
        out[bucket] = np.frombuffer(heavy, dtype=np.uint8)
    return list(out.reshape(DEPTH, -1))


def summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"}).select(["lang", "phrase", "f"])


def phrase_buckets(phrase: pa.Array, n: int) -> np.ndarray:
    """A bucket for each phrase, by a hash of its bytes."""
    out = []
    for i in range(0, len(phrase), 1 << 17):
        part = pa.concat_arrays([phrase.slice(i, 1 << 17)])
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[: len(part) + 1].astype(np.int64)
        buf = np.frombuffer(data, dtype=np.uint8)[: at[-1]] if data is not None else np.empty(0, dtype=np.uint8)
        out.append((span_hash(prefix_hash(buf), at[:-1], at[1:]) % U64(n)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def counted_blocks(counts, buckets: int):
    """Sums of counts (record batches) as blocks for each bucket: sorted by phrase, they take a third of the bytes of rows."""

    def blocks_of(held):
        t = summed([pa.Table.from_batches(held)]).sort_by("phrase").combine_chunks()
        for b in t.to_batches():
            yield from blocks_by_bucket(b, phrase_buckets(b.column("phrase"), buckets), 0)

    held, n = [], 0
    for c in counts:
        held.append(c)
        n += c.num_rows
        if n >= HELD_ROWS:
            yield from blocks_of(held)
            held, n = [], 0
    if held:
        yield from blocks_of(held)


def frequent(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, phrase, f of all phrases with f >= least; f of the empty phrase counts all words of a language."""
    src = parallel(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    size = text_bytes(src)
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / CELL_BYTES)))))
    heavy = src.sparkSession.sparkContext.broadcast(sketch(src, least, longest, bits))
    buckets = buckets_for(size, BUCKET, int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def survivors(batches):
        maps = heavy.value
        for w in batches_of_words(batches):
            if not len(w.id):
                continue
            n = np.bincount(w.lang, minlength=len(w.langs))
            yield counts_batch(pa.array(w.langs, pa.string()), pa.array([""] * len(w.langs)), n)
            for size in range(1, longest + 1):
                at, h = w.phrases(size)
                for row in range(DEPTH):
                    c = cells(h, row, bits)
                    hit = (maps[row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
                    at, h = at[hit], h[hit]
                if len(at):
                    yield w.counted(at, size)

    def run(batches):
        forget()
        yield from emitted(counted_blocks(survivors(batches), buckets))

    def add_up(batches):
        for _, rows in by_bucket(batches):
            held, n = [], 0
            for _, block in rows:
                held.append(unpacked(block))
                n += len(held[-1])
                if n >= HELD_ROWS:
                    held = [summed(held)]
                    n = len(held[0]) // 2
            t = summed(held)
            t = t.filter(pc.or_(pc.greater_equal(t.column("f"), least), pc.equal(t.column("phrase"), "")))
            yield from t.combine_chunks().to_batches(max_chunksize=20_000)

    blocks = src.mapInArrow(run, "bucket int, kind int, block binary").repartitionById(buckets, F.col("bucket"))
    return written(blocks.sortWithinPartitions("bucket").mapInArrow(add_up, "lang string, phrase string, f long"), "phrases")


def scored(counts: DataFrame, candidates: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of candidates (lang, phrase, f): by the cut with the lowest score."""
    n_words = "length(phrase) - length(replace(phrase, ' ', '')) + 1"
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr(f"sequence(1, {n_words} - 1)")).alias("k"))
    part = lambda f: counts.where("phrase != ''").select(F.col("lang").alias(f"{f}_lang"), F.col("phrase").alias(f"{f}_phrase"), F.col("f").alias(f))
    # Parts are keys of the joins only: the phrase and the cut are all that is shuffled.
    head = F.expr("substring_index(phrase, ' ', k)")
    rest = F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)")
    both = cuts.join(part("l"), (F.col("lang") == F.col("l_lang")) & (head == F.col("l_phrase"))).select("lang", "phrase", "a", "k", "l")
    both = both.join(part("r"), (F.col("lang") == F.col("r_lang")) & (rest == F.col("r_phrase"))).select("lang", "phrase", "a", "k", "l", "r")
    exact = "CAST({} AS DECIMAL(15, 0))".format
    # A part occurs as often as the whole at least, so scores are up to a million.
    score = F.expr(f"({exact('a')} * {exact('a')} * CAST(1000000 AS DECIMAL(7, 0))) div ({exact('l')} * {exact('r')})")
    best = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def subsumed(counts: DataFrame) -> DataFrame:
    """lang, phrase and longer: how often the most frequent longer candidate occurs that holds a phrase of two words or more."""
    inner = "flatten(transform(sequence(2, size(w) - 1), s -> transform(sequence(1, size(w) - s + 1), i -> array_join(slice(w, i, s), ' '))))"
    long = counts.select("lang", "f", F.split("phrase", " ").alias("w")).where("size(w) > 2")
    return long.select("lang", "f", F.explode(F.expr(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def best_of(rows: DataFrame, by: str, order: list, most: int, n: int) -> DataFrame:
    """The first ``most`` rows of each group, with rank: by levels, so that no task sorts more than about GROUP rows of a group that holds most of n."""
    while n > GROUP:
        parts = -(-n // GROUP)
        w = Window.partitionBy(by, "salt").orderBy(*order)
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase", F.lit(n)), F.lit(parts))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank", "salt")
        n = min(n // 2, parts * most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs (text, lang): the first ``most`` of each language."""
    counts = frequent(docs, least, longest)
    # What goes anyhow is not scored.
    left = counts.where("instr(phrase, ' ') > 0").join(subsumed(counts), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    alone = written(scored(counts, left.select("lang", "phrase", "f")), "collocations")
    top = best_of(alone, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most, alone.count())
    words = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    out = written(top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations-best")
    drop_written(counts, alone)
    return out


def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10
), c AS (
  SELECT lang, phrase, f AS a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS head, array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') AS rest FROM f, (VALUES (1), (2)) v(cut) WHERE cut < k
), s AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score, cut
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), h AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS phrase FROM f WHERE k = 3
    UNION ALL SELECT lang, f, array_to_string(string_split(phrase, ' ')[2:3], ' ') FROM f WHERE k = 3) GROUP BY ALL
), z AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT z.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
