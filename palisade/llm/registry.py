"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from palisade.llm import decontaminate, html_extract, language_id, minhash_dedup, mixing, quality_classifier, quality_rules, sharding, substring_dedup, toxicity

MODULES = {
    "op1_substring_dedup": substring_dedup,
    "op2_quality_rules": quality_rules,
    "op3_toxicity": toxicity,
    "op4_html_extract": html_extract,
    "op5_language_id": language_id,
    "op6_decontaminate": decontaminate,
    "op7_quality_classifier": quality_classifier,
    "op8_mixing": mixing,
    "op9_sharding": sharding,
    "op10_minhash_dedup": minhash_dedup,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL() if callable(m.SQL) else m.SQL for name, m in MODULES.items() if m.SQL}
