"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from layerkv.llm import query_chat, query_decontamination, query_html_text, query_mixing, query_near_dedup, query_quality_model, query_quality_rules, query_secrets, query_sharding, query_toxicity

MODULES = (query_sharding, query_near_dedup, query_mixing, query_html_text, query_quality_model, query_quality_rules, query_secrets, query_decontamination, query_toxicity, query_chat)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in MODULES if m.SQL is not None}
