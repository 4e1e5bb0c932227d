"""One query an operator, over its whole table, with production parameters."""

from . import exact_dedup, hard_negatives, line_dedup, minhash, packing, pii, prefix_trie, quality, segmentation, sharding, simhash, token_files, toxicity

QUERIES = {
    "op1_token_counts": token_files.query,
    "op2_quality_rules": quality.query,
    "op3_personal_data": pii.query,
    "op4_line_dedup": line_dedup.query,
    "op5_sharding": sharding.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_toxicity": toxicity.query,
    "op8_best_fit_packing": packing.query,
    "op9_nbest_segmentation": segmentation.query,
    "op10_simhash_near_dedup": simhash.query,
    "op11_minhash_near_dedup": minhash.query,
    "op12_conversation_trie": prefix_trie.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL = {
    "op4_line_dedup": line_dedup.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op11_minhash_near_dedup": minhash.SQL,
    "op12_conversation_trie": prefix_trie.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
