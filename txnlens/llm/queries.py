"""Registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

from txnlens.llm import cover_codes, exact_stream, guess_cost, harmonic_pack, imatch, license_bands, line_join, prefix_trie, projection_forest, quality_trees, simhash_blocks, stream_bpe, suffix_merge

QUERIES = {
    "op1_license_scan": license_bands.op1,
    "op10_line_dedup": line_join.op10,
    "op11_nearest_neighbours": projection_forest.op11,
    "op12_vector_codes": cover_codes.op12,
    "op13_prefix_trie": prefix_trie.op13,
    "op2_quality_classifier": quality_trees.op2,
    "op3_exact_dedup": exact_stream.op3,
    "op4_secret_scan": guess_cost.op4,
    "op5_bpe": stream_bpe.op5,
    "op6_fingerprints": imatch.op6,
    "op7_packing": harmonic_pack.op7,
    "op8_suffix_dedup": suffix_merge.op8,
    "op9_simhash_near_dedup": simhash_blocks.op9,
}
ORACLE = {
    "op1_license_scan": license_bands.oracle(),
    "op3_exact_dedup": exact_stream.ORACLE,
    "op12_vector_codes": cover_codes.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
