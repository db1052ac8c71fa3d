"""Queries and DuckDB SQL of the corpus operators."""

from __future__ import annotations

from timberline.llm import ann, chat, decontam, jaccard, licenses, linededup, mixing, quality, substring, tokencounts

QUERIES = {
    "op1_decontaminate": decontam.query,
    "op2_jaccard_join": jaccard.query,
    "op3_line_spread": linededup.query,
    "op4_quality": quality.query,
    "op5_token_rollup": tokencounts.query,
    "op6_chat_format": chat.query,
    "op7_mix_sources": mixing.query,
    "op8_substring_dedup": substring.query,
    "op9_license_scan": licenses.query,
    "op10_nearest": ann.query,
}
ORACLES = {
    "op2_jaccard_join": jaccard.ORACLE,
    "op3_line_spread": linededup.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op8_substring_dedup": substring.ORACLE,
    "op9_license_scan": licenses.ORACLE,
}
