"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lectern.llm import adaptive_search, fill_in_middle, lm_scoring, merkle_manifest, mixing, packing, pii, quality_rules, simhash_dedup, substring_dedup, token_output, topk_search, toxicity

MODULES = (substring_dedup, simhash_dedup, toxicity, token_output, pii, quality_rules, lm_scoring, topk_search, mixing, packing, adaptive_search, merkle_manifest, fill_in_middle)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
