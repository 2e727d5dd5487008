"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, chat_format, hilbert_ann, near_dup, ngram_lm, packing, quality, suffix_dedup, top_k, toxicity

QUERIES = {
    "op1_lm_scoring": ngram_lm.op1_lm_scoring,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_minhash_near_dup": near_dup.op5_minhash_near_dup,
    "op6_chat_formatting": chat_format.op6_chat_formatting,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_hilbert_ann": hilbert_ann.op9_hilbert_ann,
    "op10_exact_top_k": top_k.op10_exact_top_k,
}
ORACLE_SQL = {
    "op1_lm_scoring": ngram_lm.OP1_SQL,
    "op6_chat_formatting": chat_format.OP6_SQL,
    "op10_exact_top_k": top_k.OP10_SQL,
}
