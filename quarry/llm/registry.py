"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import ann, bpe, langid, minhash, packing, quality, substring, suffix, token_counts, toxicity

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_language_id": langid.op5_language_id,
    "op6_nearest_neighbours": ann.op6_nearest_neighbours,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLES = {"op1_substring_dedup": substring.SQL, "op8_minhash_near_dedup": minhash.SQL, "op10_quality_rules": quality.SQL}
