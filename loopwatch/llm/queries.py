"""The corpus queries: one for each operator, over its whole tables."""

from __future__ import annotations

import importlib

OPERATORS = {
    "op1_ngram_jaccard_join": "op1",
    "op2_substring_dedup": "op2",
    "op3_sentencepiece": "op3",
    "op4_warc": "op4",
    "op5_line_dedup": "op5",
    "op6_exact_top_k": "op6",
    "op7_license_scan": "op7",
    "op8_source_mixing": "op8",
    "op9_quality_rules": "op9",
    "op10_language_id": "op10",
    "op11_suffix_array_dedup": "op11",
    "op12_centroid_clustering": "op12",
    "op13_importance_resampling": "op13",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"loopwatch.llm.q_{short}"), "query") for name, short in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"loopwatch.llm.q_{short}"), "ORACLE_SQL", None) for name, short in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
