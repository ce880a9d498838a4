"""A corpus pipeline of five stages, each an operator of ``lumenframe.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it as the next stage's docs. All but the last return the
columns of documents.

Defined results: null texts count as empty and go with the quality rules; rows without doc_id, lang
or source are judged like others; of rows that repeat an id those with linked texts are one group, others
stay; texts of any length are read whole; columns beyond those of documents are kept up to the last stage,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import jaccard, langid, packing, quality, repeats
from lumenframe.llm.common import drop_written, prepare, table, written

#: Near duplicates: five words and a similarity of 0.8.
WIDTH, PERCENT = 5, 80
#: Bytes of a repeated passage: 50 words hold as many or more unless they have fewer than two letters on average.
PASSAGE = 150


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their source or language."""
    prepare(spark)
    return quality.passed(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the models, learnt from the labels of these documents, can tell, and that its model fits."""
    prepare(spark)
    return langid.told(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    prepare(spark)
    return jaccard.without_copies(docs, WIDTH, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that a document with a smaller doc_id holds; characters cut in two go whole."""
    prepare(spark)
    other = tuple(c for c in docs.columns if c != "text")
    out = repeats.remove_repeats(docs, PASSAGE, with_text=True, keep=other)
    raw = "cast(kept AS string)"
    valid = F.expr(f"coalesce(try_validate_utf8({raw}), replace(make_valid_utf8({raw}), '\ufffd', ''))")
    own = {c: F.col("own_row").getField(c) for c in other} | {"text": valid}
    if "n_chars" in other:
        own["n_chars"] = F.length(valid).cast(docs.schema["n_chars"].dataType)
    return out.select(*(own[c].alias(c) for c in docs.columns))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, neighbours on the curve together."""
    import public_tokenizers

    prepare(spark)
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", curve_packing),
]

#: Language identification and tokenisation can't be written in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(docs)
        docs = after
    return docs
