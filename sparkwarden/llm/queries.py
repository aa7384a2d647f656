"""The queries of the text operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Module of each operator's query.
_MODULES = {
    "op1_bpe_codec": "bpe",
    "op2_url_filter": "url_filter",
    "op3_toxicity": "toxicity",
    "op4_secret_scan": "secrets",
    "op5_language_id": "langid",
    "op6_ngram_jaccard_join": "near_dedup",
    "op7_quality": "quality",
    "op8_exact_dedup": "exact_dedup",
    "op9_media_columns": "media",
    "op10_source_mix": "mixing",
    "op11_phrase_collocations": "collocation",
    "op12_token_alignment": "alignment",
    "op13_quality_rules": "quality_rules",
}


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    return {name: getattr(importlib.import_module(f"sparkwarden.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    from sparkwarden.llm import collocation, exact_dedup, quality_rules

    return {"op8_exact_dedup": exact_dedup.ORACLE, "op11_phrase_collocations": collocation.oracle(), "op13_quality_rules": quality_rules.oracle()}
