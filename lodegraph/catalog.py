"""All registered queries of the code-graph workload, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from .plans import queries_changes, queries_code, queries_graph, queries_lookup, queries_patterns, queries_rules, queries_search, queries_store

_MODULES = (queries_graph, queries_changes, queries_search, queries_rules, queries_code, queries_patterns, queries_lookup, queries_store)


def queries() -> dict:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
