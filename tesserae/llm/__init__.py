"""Operators for training corpora. Nothing outside this folder imports it but the entry module."""

from __future__ import annotations

from importlib import import_module

#: Query name to module; modules are loaded on use so that each stands alone.
MODULES = {
    "op1_exact_dedup": "exact_dedup",
    "op2_token_counts": "token_counts",
    "op3_toxicity": "toxicity",
    "op4_quality": "quality",
    "op5_substring_dedup": "substring_dedup",
    "op6_decontamination": "decontamination",
    "op7_sentencepiece": "sentencepiece_codec",
    "op8_near_dedup": "near_dedup",
    "op9_pii": "pii",
    "op10_html_extraction": "html_extraction",
    "op11_periodic_runs": "periodic_runs",
    "op12_vector_codes": "vector_codes",
    "op13_quality_rules": "quality_rules",
}


def query(name: str):
    return import_module(f"{__name__}.{MODULES[name]}").query


def sql(name: str) -> str | None:
    return getattr(import_module(f"{__name__}.{MODULES[name]}"), "SQL", None)


def queries() -> dict:
    return {name: query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: found for name in MODULES if (found := sql(name))}
