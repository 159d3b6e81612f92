"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from sphereframe.llm import debruijn, decontam, lm, minhash, packing, quality, rules, secrets, suffixes, tokens

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_substring_dedup": debruijn.op3_substring_dedup,
    "op4_backoff_automaton": lm.op4_backoff_automaton,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_suffix_array_dedup": suffixes.op7_suffix_array_dedup,
    "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_secret_scan": secrets.op10_secret_scan,
}
ORACLES: dict[str, str] = {
    "op1_decontamination": decontam.OP1_SQL,
    "op3_substring_dedup": debruijn.OP3_SQL,
    "op7_suffix_array_dedup": suffixes.OP7_SQL,
    "op8_minhash_near_dedup": minhash.OP8_SQL,
}
