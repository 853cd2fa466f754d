"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from evisift.llm import chat, context_mixing, importance, merkle, mixing, multi_index, near_duplicates, quality, token_shards, topk, toxicity, urls, wfst

QUERIES = {
    "op1_ngram_jaccard": near_duplicates.op1_ngram_jaccard,
    "op2_chat_format": chat.op2_chat_format,
    "op3_url_filter": urls.op3_url_filter,
    "op4_near_vectors": multi_index.op4_near_vectors,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_sentencepiece": wfst.op6_sentencepiece,
    "op7_exact_top_k": topk.op7_exact_top_k,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_shards": token_shards.op10_token_shards,
    "op11_lm_scoring": context_mixing.op11_lm_scoring,
    "op12_merkle": merkle.op12_merkle,
    "op13_importance": importance.op13_importance,
}
ORACLES = {
    "op1_ngram_jaccard": near_duplicates.ORACLE,
    "op2_chat_format": chat.ORACLE,
    "op4_near_vectors": multi_index.ORACLE,
    "op7_exact_top_k": topk.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_importance": importance.ORACLE,
}
