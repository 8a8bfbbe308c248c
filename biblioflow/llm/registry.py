"""The queries of this subpackage, by name."""

from __future__ import annotations

from biblioflow.llm import languages_queries, leaks_queries, linkage_queries, mixing_queries, survivors_queries, variants_queries, visible_queries

MODULES = (languages_queries, leaks_queries, linkage_queries, mixing_queries, survivors_queries, variants_queries, visible_queries)


def queries() -> dict:
    """name -> callable (spark, sf_dir) -> DataFrame"""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """name -> SQL with the same result, where SQL can express it"""
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
