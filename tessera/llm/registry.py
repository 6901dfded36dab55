"""Queries of the subpackage, by name, and their SQL."""

from __future__ import annotations

from tessera.llm import decontaminate, exactdedup, jaccard, langid, licenses, linededup, mixing, quality, sharding, substrings

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_language_id": langid.query,
    "op3_line_dedup": linededup.query,
    "op4_license_scan": licenses.query,
    "op5_exact_dedup": exactdedup.query,
    "op6_substring_dedup": substrings.query,
    "op7_decontamination": decontaminate.query,
    "op8_quality_classifier": quality.query,
    "op9_sharding": sharding.query,
    "op10_ngram_jaccard": jaccard.query,
}
ORACLES = {
    "op3_line_dedup": linededup.ORACLE,
    "op4_license_scan": licenses.ORACLE,
    "op5_exact_dedup": exactdedup.ORACLE,
    "op6_substring_dedup": substrings.ORACLE,
    "op10_ngram_jaccard": jaccard.ORACLE,
}
