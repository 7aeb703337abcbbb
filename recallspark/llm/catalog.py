"""All queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from recallspark.llm import levels_queries, neighbours_queries, packing_queries, pairs_queries, splitting_queries

MODULES = [neighbours_queries, splitting_queries, packing_queries, pairs_queries, levels_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
