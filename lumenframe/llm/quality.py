"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Features of a text are integers. Each (lang, source) keeps, per feature, a histogram over
logarithmic bins with 16 steps to an octave: a quantile sketch with at most 6.25 % relative
error whose merge is the addition of counts, so it is an ordinary partial aggregation and does
not depend on partitions. The fences come from the sketches alone:

* Spread features (length of words) lie around a middle: a fence is the outer quartile and
  ``reach`` times the distance of the quartiles beyond it.
* Rate features (symbols, repeated lines, repeated words) are zero for most texts of most groups:
  the fence is the end of the tail that hangs together with the third quartile. A tail ends before
  a run of empty bins an octave wide, or two octaves where less than a ``crowd``th of the texts lies beyond it: gaps
  before a few stray texts arise by chance.

Only shares of texts enter, no numbers of texts: any table and the same table twice have the same fences.

A text is rejected if a feature stands out both in its group and in its language over all sources:
what is common in a source, or in a language, is no fault there.

Rates do not count the first symbol, the first repeated line and the first pair of repeated
windows: these are what rounding is in a short text.

Defined results: a null text counts as empty; null lang or source is a group of its own; a
value at a fence is inside; texts of any length are counted whole; repeated rows are judged each;
the caller's columns may have any names, they come back as the struct own_row; an empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenframe.llm.common import forget, parallel, row_struct, table, text_column, written
from lumenframe.llm.kernels import BASE, U64, blocks, joined, mix, prefix_hash, span_hash, word_spans

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Steps to an octave as a power of two.
STEP_BITS = 4


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: Distances between the quartiles from the outer quartile to the fence of a spread feature.
    reach: int = 6
    #: Empty bins that end the tail of a rate feature, and the share of texts beyond them (one in so many) below which twice as many must be empty.
    gap: int = 1 << STEP_BITS
    crowd: int = 100


#: Features: (name, whether its values spread around a middle, expression).
FEATURES = [
    ("symbol_rate", False, "1000 * greatest(n_symbols - 1, 0) div greatest(n_words, 1)"),
    ("word_length", True, "1000 * word_chars div greatest(n_words, 1)"),
    ("dup_rate", False, "100 * greatest(n_dup_lines - 1, 0) div greatest(n_lines, 1)"),
    ("repeat_rate", False, f"1000 * greatest(n_repeat_words - {2 * WINDOW}, 0) div greatest(n_words, 1)"),
]
#: More than any feature.
ENDLESS = 1 << 60


def counted(texts: list[str]) -> list[np.ndarray]:
    """The five counts of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n_words = np.zeros(len(texts), dtype=np.int64)
    repeats = np.zeros(len(texts), dtype=np.int64)
    for i, j in blocks(raw):
        buf, at = joined(raw[i:j])
        starts, ends = word_spans(buf)
        h = span_hash(prefix_hash(buf), starts, ends)
        bound = np.searchsorted(starts, at)
        n_words[i:j] = np.diff(bound)
        n = len(h) - WINDOW + 1
        if n < 2:
            continue
        acc = np.zeros(n, dtype=U64)
        for k in range(WINDOW):
            acc = acc * U64(BASE) + h[k : k + n]
        owner = np.repeat(np.arange(j - i), np.diff(bound))
        whole = owner[:n] == owner[WINDOW - 1 :]
        acc = mix(acc ^ mix(owner[:n].astype(U64)))[whole]
        where = np.flatnonzero(whole)
        order = np.argsort(acc, kind="stable")
        same = acc[order][1:] == acc[order][:-1]
        hit = np.zeros(len(acc), dtype=bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(edge, where[hit], 1)
        np.add.at(edge, where[hit] + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        repeats[i:j] = np.diff(np.concatenate([[0], np.cumsum(covered)])[bound])
    spaces = str.maketrans("", "", " \t\n\x0b\x0c\r")
    chars = [len(t.translate(spaces)) if not t.isascii() else len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in texts]
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    dups, lines = [], []
    for t in texts:
        own = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        dups.append(len(own) - len(set(own)))
        lines.append(len(own))
    return [n_words, np.array(chars, dtype=np.int64), np.array(symbols, dtype=np.int64), np.array(dups, dtype=np.int64), repeats, np.array(lines, dtype=np.int64)]


def text_counts(docs: DataFrame) -> DataFrame:
    """COUNTS and n_lines of text, or of the text in own_row, beside the other columns."""
    src = parallel(docs)
    keep = [c for c in src.columns if c != "text"]
    schema = StructType([*(src.schema[c] for c in keep), *(StructField(c, LongType()) for c in [*COUNTS, "n_lines"])])

    def run(batches):
        forget()
        for b in batches:
            for part in (b.slice(x, 1000) for x in range(0, b.num_rows, 1000)):
                got = counted([t or "" for t in text_column(part).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *map(pa.array, got)], names=[*keep, *COUNTS, "n_lines"])

    return src.mapInArrow(run, schema)


def binned(c: str) -> str:
    """The bin of a value from 0 up: exact below 16, then 16 steps to an octave."""
    top = f"(length(conv(cast({c} AS string), 10, 2)) - 1 - {STEP_BITS})"
    return f"CASE WHEN {c} < {1 << STEP_BITS} THEN {c} ELSE {top} * {1 << STEP_BITS} + shiftright({c}, cast({top} AS int)) END"


def bin_floor(c: str) -> str:
    """The least value of a bin."""
    step = 1 << STEP_BITS
    return f"CASE WHEN {c} < {2 * step} THEN {c} ELSE shiftleft({c} % {step} + {step}, cast({c} div {step} - 1 AS int)) END"


def sketches(feats: DataFrame) -> DataFrame:
    """level, lang, source, feature, bin, n: for each source of a language (level 0) and for each language (level 1)."""
    long = feats.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.expr(binned(f)).alias("bin")) for f, _, _ in FEATURES))).alias("x")).select("lang", "source", "x.*")
    fine = long.groupBy("lang", "source", "feature", "bin").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    by = [(0, F.col("source")), (1, none)]
    merged = fine.select("lang", "feature", "bin", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), a.alias("source")) for k, a in by))).alias("g"))
    return merged.groupBy("g.level", "lang", "g.source", "feature", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, rules: Rules) -> DataFrame:
    """level, lang, source, and low_F and high_F of each feature F."""
    group = ["level", "lang", "source", "feature"]
    w = Window.partitionBy(*group)
    q = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "size": F.sum("n").over(w), "next": F.lead("bin").over(w.orderBy("bin"))})
    third = 4 * F.col("upto") >= 3 * F.col("size")
    q = q.withColumns({"b1": F.min(F.when(4 * F.col("upto") >= F.col("size"), F.col("bin"))).over(w), "b3": F.min(F.when(third, F.col("bin"))).over(w)})
    few = F.when((F.col("size") - F.col("upto")) * rules.crowd < F.col("size"), 1).otherwise(0)
    ends = (F.col("bin") >= F.col("b3")) & (F.col("next") - F.col("bin") > rules.gap * (1 + few))
    value = lambda c: F.expr(bin_floor(c))
    q = q.groupBy(*group).agg(F.max("size").alias("size"), F.max("b1").alias("b1"), F.max("b3").alias("b3"), F.min(F.when(ends, F.col("bin"))).alias("last"))
    # At least a bin, the sketch's rounding.
    room = F.expr(f"{rules.reach} * greatest({bin_floor('b3')} - {bin_floor('b1')}, {bin_floor('(b3 + 1)')} - {bin_floor('b3')})")
    aggs = []
    for name, spread, _ in FEATURES:
        own = F.col("feature") == name
        high = value("b3") + room if spread else F.coalesce(value("(last + 1)") - 1, F.lit(ENDLESS))
        aggs += [F.max(F.when(own, high)).alias(f"high_{name}"), F.max(F.when(own, value("b1") - room if spread else F.lit(-1))).alias(f"low_{name}")]
    return q.groupBy("level", "lang", "source").agg(*aggs)


def judge(docs: DataFrame, keep: list[str], rules: Rules = Rules()) -> DataFrame:
    """own_row (the kept columns), COUNTS, base_failed and kept of docs (text, lang, source)."""
    own = [row_struct(docs, keep), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    counts = written(text_counts(docs.select(*own, *(["text"] if "text" not in keep else []))), "quality-counts")
    feats = counts.withColumns({f: F.expr(v) for f, _, v in FEATURES})
    # One row for each group: sources and languages, not documents. Spark itself decides by its size whether to broadcast.
    limits = written(fences(sketches(feats), rules), "quality-fences")

    def level(k: int) -> DataFrame:
        return limits.where(f"level = {k}").select(F.col("lang").alias(f"lang{k}"), F.col("source").alias(f"source{k}"), *(F.col(f"{s}_{f}").alias(f"{s}_{f}{k}") for f, _, _ in FEATURES for s in ("low", "high")))

    x = feats.join(level(0), F.col("lang").eqNullSafe(F.col("lang0")) & F.col("source").eqNullSafe(F.col("source0")), "left")
    x = x.join(level(1), F.col("lang").eqNullSafe(F.col("lang1")), "left")
    inside = F.expr(" AND ".join(f"({f} BETWEEN low_{f}0 AND high_{f}0 OR {f} BETWEEN low_{f}1 AND high_{f}1)" for f, _, _ in FEATURES))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return x.select("own_row", *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def passed(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that are kept."""
    out = judge(docs, docs.columns, rules).where("kept")
    return out.select(*(F.col("own_row").getField(c).alias(c) for c in docs.columns))


def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judge(docs, ["doc_id"]).select("own_row.doc_id", *COUNTS, "base_failed", "kept")


def op3_sql(rules: Rules = Rules()) -> str:
    bin_sql = "CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END"

    def floor_sql(b: str) -> str:
        return f"CASE WHEN {b} < 32 THEN {b} ELSE (({b} % 16) + 16) << CAST({b} // 16 - 1 AS BIGINT) END"

    spread = ", ".join(f"'{f}'" for f, s, _ in FEATURES if s)
    long = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{f}' AS feature, CAST({v.replace(' div ', ' // ')} AS BIGINT) AS v FROM counts" for f, _, v in FEATURES)
    few = f"((size - upto) * {rules.crowd} < size)::INT"
    return f"""
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents)
), win AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s,
    count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS c FROM w
), rep AS (
  SELECT doc_id, i, CASE WHEN c = 8 AND count(*) OVER (PARTITION BY doc_id, s, c) >= 2 THEN 1 ELSE 0 END AS r FROM win
), cov AS (
  SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS r FROM rep
), words AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id
), reps AS (
  SELECT doc_id, sum(r) AS n_repeat_words FROM cov GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), counts AS (
  SELECT d.doc_id, d.lang, d.source, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN lines USING (doc_id)
), feats AS ({long}
), fine AS (
  SELECT lang, source, feature, {bin_sql} AS b, count(*) AS n FROM feats GROUP BY ALL
), lev AS (
  SELECT 0 AS level, lang, source, feature, b, n FROM fine UNION ALL SELECT 1, lang, NULL, feature, b, n FROM fine
), sk AS (
  SELECT level, lang, source, feature, b, CAST(sum(n) AS BIGINT) AS n FROM lev GROUP BY ALL
), qu AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, feature ORDER BY b) AS upto, CAST(sum(n) OVER (PARTITION BY level, lang, source, feature) AS BIGINT) AS size,
    lead(b) OVER (PARTITION BY level, lang, source, feature ORDER BY b) AS following FROM sk
), qb AS (
  SELECT *, min(CASE WHEN 4 * upto >= size THEN b END) OVER (PARTITION BY level, lang, source, feature) AS b1,
    min(CASE WHEN 4 * upto >= 3 * size THEN b END) OVER (PARTITION BY level, lang, source, feature) AS b3 FROM qu
), qs AS (
  SELECT level, lang, source, feature, max(size) AS size, max(b1) AS b1, max(b3) AS b3,
    min(CASE WHEN b >= b3 AND following - b > {rules.gap} * (1 + {few}) THEN b END) AS last_ FROM qb GROUP BY level, lang, source, feature
), ro AS (
  SELECT *, {floor_sql('b1')} AS q1, {floor_sql('b3')} AS q3, {floor_sql('(last_ + 1)')} - 1 AS tail,
    {rules.reach} * greatest({floor_sql('b3')} - ({floor_sql('b1')}), ({floor_sql('(b3 + 1)')}) - ({floor_sql('b3')})) AS room FROM qs
), fe AS (
  SELECT level, lang, source, feature, CASE WHEN feature IN ({spread}) THEN q3 + room ELSE coalesce(tail, {ENDLESS}) END AS high, CASE WHEN feature IN ({spread}) THEN q1 - room ELSE -1 END AS low FROM ro
), ok AS (
  SELECT f.doc_id, bool_and(f.v BETWEEN a.low AND a.high OR f.v BETWEEN b.low AND b.high) AS inside
  FROM feats f
  LEFT JOIN fe a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM f.lang AND a.source IS NOT DISTINCT FROM f.source AND a.feature = f.feature
  LEFT JOIN fe b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM f.lang AND b.feature = f.feature GROUP BY f.doc_id
), base AS (
  SELECT *, (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND inside) AS kept FROM base JOIN ok USING (doc_id)
"""
