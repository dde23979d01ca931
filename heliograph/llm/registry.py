"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, context_tree, cotraining, language_id, line_dedup, mixing, quality_rules, search, simhash, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_simhash": simhash.op4_simhash,
    "op5_context_tree": context_tree.op5_context_tree,
    "op6_cotraining": cotraining.op6_cotraining,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_search": search.op8_search,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_language_id": language_id.op10_language_id,
}
ORACLE_SQL = {
    "op7_mix_sources": mixing.SQL,
    "op8_search": search.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
