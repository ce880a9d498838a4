"""Queries and oracle SQL of the operators of this subpackage."""

from __future__ import annotations

from lumenframe.llm import audit, bpe, chat, collocations, embeddings, jaccard, langid, packing, quality, repeats, toxicity, urls, warc


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_bpe": bpe.op4_bpe,
        "op5_warc": warc.op5_warc,
        "op6_url_filters": urls.op6_url_filters,
        "op7_language_id": langid.op7_language_id,
        "op8_embedding_dedup": embeddings.op8_embedding_dedup,
        "op9_suffix_dedup": repeats.op9_suffix_dedup,
        "op10_chat_formatting": chat.op10_chat_formatting,
        "op11_collocations": collocations.op11_collocations,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.op3_sql(),
        "op5_warc": warc.OP5_SQL,
        "op8_embedding_dedup": embeddings.OP8_SQL,
        "op10_chat_formatting": chat.OP10_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op13_filter_audit": audit.OP13_SQL,
    }
