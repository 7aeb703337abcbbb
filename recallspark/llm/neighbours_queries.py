"""Queries of the vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.neighbours import Config, exact_search, nearest_neighbours, neighbour_pairs
from recallspark.session import table

KINDS = ["episode", "note"]


def _collections(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, f"{k}s").select(F.col(f"{k}_id").alias("id"), "embedding") for k in KINDS]


def _kind():
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("kind")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs where either vector is among the other's 10 most similar."""
    pairs = neighbour_pairs(nearest_neighbours(_collections(spark, sf_dir)))
    return pairs.select(_kind(), "id_a", "id_b")


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list behind it: rank and cosine of each vector's 10 most similar."""
    lists = nearest_neighbours(_collections(spark, sf_dir))
    rows = lists.select(_kind(), "id", F.posexplode("near").alias("rank", "n"))
    return rows.select("kind", "id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("other_id"), F.round(-F.col("n.far"), 9).alias("cosine"))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 against brute force, over the ids divisible by 100."""
    parts, lists = [], nearest_neighbours(_collections(spark, sf_dir))
    for k, df in enumerate(_collections(spark, sf_dir)):
        asked = df.where(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint") % 100 == 0)
        exact = exact_search(asked, df, Config().k, Config().dim).select("id", F.col("near.id").alias("truth"))
        both = exact.join(lists.where(F.col("kind") == k).select("id", F.col("near.id").alias("got")), "id", "left")
        hits = F.size(F.array_intersect("truth", F.coalesce("got", F.array().cast("array<string>"))))
        parts.append(both.agg(F.count("*").alias("queries"), (F.sum(hits) / F.sum(F.size("truth"))).alias("recall")).select(F.lit(KINDS[k]).alias("kind"), "queries", F.round("recall", 6).alias("recall")))
    return parts[0].unionByName(parts[1])


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_recall": p1_recall}
SQL: dict[str, str] = {}
