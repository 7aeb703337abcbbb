"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallspark.operators import engine_queries, evaluation_queries, history_queries, memory_queries, ranking_queries, search_queries

MODULES = [history_queries, search_queries, ranking_queries, evaluation_queries, memory_queries, engine_queries]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_convex"](spark, sf_dir)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
