"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, jaccard_join, mixing, prefix_trie, quality_knn, quality_rules, secrets, sharding, substring_dedup, suffix_dedup, toxicity, whitening

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_knn": quality_knn.op5_quality_knn,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_byte_shards": sharding.op11_byte_shards,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op2_source_mix": mixing.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op11_byte_shards": sharding.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
