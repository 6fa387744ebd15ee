"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import (
    collocations,
    exact_dedup,
    fingerprints,
    language_id,
    line_dedup,
    quality_rules,
    sentence_pieces,
    simhash_dedup,
    source_mix,
    substring_dedup,
    token_counts,
    vector_codes,
    warc,
)

_MODULES = {
    "op1_substring_dedup": substring_dedup,
    "op2_warc": warc,
    "op3_token_counts": token_counts,
    "op4_quality_rules": quality_rules,
    "op5_exact_dedup": exact_dedup,
    "op6_language_id": language_id,
    "op7_source_mix": source_mix,
    "op8_line_dedup": line_dedup,
    "op9_simhash": simhash_dedup,
    "op10_sentencepiece": sentence_pieces,
    "op11_collocations": collocations,
    "op12_vector_codes": vector_codes,
    "op13_fingerprints": fingerprints,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLE_SQL = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
