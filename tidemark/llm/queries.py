"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from tidemark.llm import byte_bpe, decontamination, exact_dedup, license_scans, merkle_manifest, mixing, near_dedup, phrase_mining, quality_classifier, quality_rules, token_counts, token_orc, url_filters

QUERIES = {
    "op1_license_scans": license_scans.query,
    "op2_mixing": mixing.query,
    "op3_quality_rules": quality_rules.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_url_filters": url_filters.query,
    "op8_token_counts": token_counts.query,
    "op9_token_orc": token_orc.query,
    "op10_near_dedup": near_dedup.query,
    "op11_decontamination": decontamination.query,
    "op12_phrase_mining": phrase_mining.query,
    "op13_merkle_manifest": merkle_manifest.query,
}

SQL = {
    "op2_mixing": mixing.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_url_filters": url_filters.SQL,
    "op11_decontamination": decontamination.SQL,
    "op12_phrase_mining": phrase_mining.SQL,
    "op13_merkle_manifest": merkle_manifest.SQL,
}
