"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from emberflow.llm import (
    decontaminate,
    exact_dedup,
    html_extract,
    language_id,
    license_scan,
    line_dedup,
    lm_score,
    ngram_join,
    sentencepiece_codec,
    token_counts,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (exact_dedup, token_counts, decontaminate, line_dedup, ngram_join, lm_score, language_id, license_scan, html_extract, sentencepiece_codec):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
