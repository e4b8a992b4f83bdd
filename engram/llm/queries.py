"""The subpackage's registered queries and, where SQL can say the same, their oracle SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, embedding_whitening, exact_dedup, jaccard_join, language_id, merkle_manifest, packing, pii, quality, substring_dedup, suffix_dedup, token_counts

QUERIES = {
    "op1_pii": pii.query,
    "op2_language_id": language_id.query,
    "op3_packing": packing.query,
    "op4_quality": quality.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_decontamination": decontaminate.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_chat_format": chat_format.query,
    "op9_token_counts": token_counts.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_suffix_dedup": suffix_dedup.query,
    "op12_merkle_manifest": merkle_manifest.query,
    "op13_embedding_whitening": embedding_whitening.query,
}

ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_suffix_dedup": suffix_dedup.ORACLE,
    "op12_merkle_manifest": merkle_manifest.ORACLE,
}
