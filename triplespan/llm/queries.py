"""Queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from triplespan.llm import bpe, filter_audit, jaccard_join, mixing, pii, prefix_trie, quality_rules, rule_ensemble, secrets, simhash_join, substring_dedup, toxicity, webp

QUERIES = {
    "op1_webp_media": webp.op1_webp_media,
    "op2_quality_classifier": rule_ensemble.op2_quality_classifier,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_ngram_jaccard": jaccard_join.op8_ngram_jaccard,
    "op9_pii": pii.op9_pii,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_simhash": simhash_join.op11_simhash,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL = {"op6_mix_sources": mixing.OP6_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
