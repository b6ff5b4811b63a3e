"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_chat, q_decontaminate, q_langid, q_quality, q_resample, q_search, q_simhash, q_suffix, q_tokens, q_toxicity, q_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dup": q_simhash.op1_simhash_near_dup,
    "op2_suffix_dedup": q_suffix.op2_suffix_dedup,
    "op3_language_id": q_langid.op3_language_id,
    "op4_quality_rules": q_quality.op4_quality_rules,
    "op5_chat_format": q_chat.op5_chat_format,
    "op6_best_fit_packing": q_tokens.op6_best_fit_packing,
    "op7_token_counts": q_tokens.op7_token_counts,
    "op8_decontaminate": q_decontaminate.op8_decontaminate,
    "op9_token_files": q_tokens.op9_token_files,
    "op10_toxicity": q_toxicity.op10_toxicity,
    "op11_exact_topk": q_search.op11_exact_topk,
    "op12_importance_resample": q_resample.op12_importance_resample,
    "op13_prefix_trie": q_trie.op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op5_chat_format": q_chat.ORACLE,
    "op8_decontaminate": q_decontaminate.ORACLE,
    "op11_exact_topk": q_search.ORACLE,
    "op12_importance_resample": q_resample.ORACLE,
    "op13_prefix_trie": q_trie.ORACLE,
}
