"""Filter interaction audit: what each filter removes alone, after others, and by its Shapley value.

A document's mask has a bit for each filter that it fails. Of a part (a value of lang) only the numbers of
documents by mask count: with n(M) documents of mask M, the share of each filter that is applied
as x_j in 0..1, and every filter letting a failing document pass with probability 1 - x_j, the removed documents are

    f(x) = sum over M of n(M) (1 - product over j in M of (1 - x_j)) = sum over sets T of c(T) product over j in T of x_j,

the part's removal polynomial, with c(T) = (-1)^(|T|+1) times the documents that fail all of T. Its values at
corners (x_j 0 or 1) are what a set of filters removes, so differences along an order are what its steps remove. The Shapley
value of a filter is the integral over t in 0..1 of its partial derivative at x = (t, ..., t): the derivative
has the coefficient c(T) at t^(|T|-1) for each T that holds the filter, and integrates to c(T) / |T|, exact rationals.
Times the number of orders it is the filter's removed documents, summed over all orders.

Spark does what grows: one pass over the texts makes masks, equal texts meet by a digest in an aggregation for the
smallest doc_id of each, and a join on digest and doc_id tells the first copy from the rest, so a text that
a third of all rows hold is spread by its ids. The polynomials of a part come from at most 2^filters counts.

Defined results: null text counts as empty, null lang is the part of the empty string; a row without doc_id is
no copy of another and no other row is a copy of it, and it has no labels; rows that repeat an id and text are all first; labels that repeat an id
count if any of them says so; texts of any length are read whole; other columns are ignored, whatever
their names; an empty table gives an empty table, a part without failures gives rows of zeros.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import table, written

#: What parts words: the class of blanks that all contracts of word counts share.
BLANKS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text, by letter."""
    every = F.array_remove(F.split(text, BLANKS), "")
    # An array of one, transformed, names what is computed once.
    sizes = F.transform(F.array(every), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds")))[0]
    chars = F.length(text).cast("long")
    capitals = chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "sizes": sizes,
        "A": F.expr("sizes.n < 200"),
        "B": F.expr("100 * sizes.kinds < 50 * sizes.n"),
        "C": 100 * capitals > 3 * chars,
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit 0 for A, up to bit 4 for E), good and toxic (0 or 1) of docs (doc_id, text, lang), a row each."""
    text = F.coalesce("text", F.lit(""))
    fails = text_failures(text)
    own = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("sizes", fails.pop("sizes"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    rows = written(own.select("doc_id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-masks")
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    copy = F.when(F.col("first").isNull(), 1 << len(fails)).otherwise(0)
    told = known.join(first, ["digest", "doc_id"], "left").join(judged, "doc_id", "left")
    told = told.select("part", (F.col("mask") + copy).alias("mask"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    # Rows without doc_id would meet in one partition of the joins.
    return told.unionByName(rows.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


class Removal:
    """The removal polynomial of a part, from its documents by mask: coefficients by set of filters."""

    def __init__(self, n: dict[int, int], filters: int):
        self.total = sum(n.values())
        self.by_mask = n
        failing = {t: sum(v for m, v in n.items() if m & t == t) for t in range(1, 1 << filters)}
        self.c = {t: v if t.bit_count() % 2 else -v for t, v in failing.items()}
        self.failing = failing

    def at(self, corner: int) -> int:
        """The value with the filters of a set at 1, the others at 0: what they remove together."""
        return sum(v for t, v in self.c.items() if t & ~corner == 0)

    def derivative(self, i: int) -> dict[int, int]:
        """Coefficients, by power of t, of the partial derivative for filter i at (t, ..., t)."""
        out: dict[int, int] = {}
        for t, v in self.c.items():
            if t >> i & 1:
                out[t.bit_count() - 1] = out.get(t.bit_count() - 1, 0) + v
        return out

    def shapley(self, i: int) -> Fraction:
        return sum((Fraction(v, power + 1) for power, v in self.derivative(i).items()), Fraction(0))


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(masked: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of all filters and step, of (part, mask, good, toxic)."""
    counts = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def run(pdf):
        import pandas as pd

        part = pdf["part"].iloc[0]
        by = lambda c: Removal(dict(zip(pdf["mask"].tolist(), pdf[c].tolist(), strict=True)), len(filters))
        every, good, toxic = by("n"), by("good"), by("toxic")
        values = [{s: p.at(s) for s in range(1 << len(filters))} for p in (every, good, toxic)]
        scaled = [every.shapley(i) * factorial(len(filters)) for i in range(len(filters))]
        assert all(x.denominator == 1 for x in scaled)
        out = []
        for order in permutations(range(len(filters))):
            name, before = "".join(filters[i] for i in order), 0
            for step, i in enumerate(order, 1):
                after = before | 1 << i
                removed, good_lost, toxic_lost = (v[after] - v[before] for v in values)
                out.append((part, name, step, every.total - values[0][after], removed, every.failing[1 << i] - removed, every.by_mask.get(1 << i, 0), good_lost, toxic_lost, int(scaled[i])))
                before = after
        return pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    return counts.groupBy("part").applyInPandas(run, OUT)


def op13_filter_audit(spark, sf_dir):
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), q AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 200 AS fa, 100 * len(list_distinct(ws)) < 50 * len(ws) AS fb,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS fe
  FROM w LEFT JOIN q ON q.doc_id = w.doc_id
), m AS (
  SELECT part, (CASE WHEN fa THEN 'A' ELSE '' END) || (CASE WHEN fb THEN 'B' ELSE '' END) || (CASE WHEN fc THEN 'C' ELSE '' END) || (CASE WHEN fd THEN 'D' ELSE '' END) || (CASE WHEN fe THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), o(o) AS (
  SELECT '' UNION ALL SELECT o || l FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) WHERE NOT contains(o, l)
), s AS (
  SELECT o AS filter_order, step, o[CAST(step AS INT)] AS own, o[1:CAST(step AS INT) - 1] AS earlier FROM o, range(1, 6) r(step) WHERE length(o) = 5
), x AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, own, n, good, toxic, fails, contains(fails, own) AS hit,
    earlier != '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN '0' ELSE earlier END || ']') AS gone FROM m, s
), y AS (
  SELECT part, filter_order, step, own, CAST(sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS BIGINT) AS kept, CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y
"""
