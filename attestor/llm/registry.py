"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from attestor.llm import op01_repeats, op02_near, op03_lines, op04_perplexity, op05_chunks, op06_licences, op07_private, op08_tokens, op09_contain, op10_pieces

QUERIES = {
    "op1_repeats": op01_repeats.query,
    "op2_near_classes": op02_near.query,
    "op3_line_labels": op03_lines.query,
    "op4_perplexity": op04_perplexity.query,
    "op5_line_chunks": op05_chunks.query,
    "op6_licences": op06_licences.query,
    "op7_private_spans": op07_private.query,
    "op8_token_files": op08_tokens.query,
    "op9_decontaminate": op09_contain.query,
    "op10_pieces": op10_pieces.query,
}
ORACLES = {
    "op2_near_classes": op02_near.ORACLE,
    "op9_decontaminate": op09_contain.ORACLE,
}
