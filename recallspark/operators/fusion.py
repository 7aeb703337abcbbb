"""Hybrid search: lexical and dense lists, united, normalised and fused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.vectors import cosine, usable
from recallspark.operators.lexical import bm25, bm25_of, every_salt, lexical_index, salted, top_k
from recallspark.session import stash


def dense(queries: DataFrame, docs: DataFrame, dim: int = 96, group: str = "conv_id", key: str = "episode_id") -> DataFrame:
    """qid, group, key, sem: cosine of each query vector with the usable vectors of its group.

    A group's vectors are spread over ``SALTS`` tasks, the queries copied to each.
    """
    left = every_salt(queries.where(usable(F.col("vector"), dim)).select("qid", group, "vector"))
    right = salted(docs.where(usable(F.col("embedding"), dim)).select(group, key, "embedding"), key)
    return left.join(right, [group, "_salt"]).select("qid", group, key, cosine(F.col("vector"), F.col("embedding")).alias("sem"))


def dense_of(pairs: DataFrame, queries: DataFrame, docs: DataFrame, dim: int = 96, group: str = "conv_id", key: str = "episode_id") -> DataFrame:
    """As ``dense``, for the given (qid, group, key) alone."""
    left = pairs.select("qid", group, key).join(queries.where(usable(F.col("vector"), dim)).select("qid", "vector"), "qid")
    right = docs.where(usable(F.col("embedding"), dim)).select(group, key, "embedding")
    return left.join(right, [group, key]).select("qid", group, key, cosine(F.col("vector"), F.col("embedding")).alias("sem"))


def dense_baseline(queries: DataFrame, docs: DataFrame, k: int, dim: int = 96, group: str = "conv_id", key: str = "episode_id") -> DataFrame:
    """The ``k`` best by cosine alone, where a document without a usable vector scores -1: it comes last, but comes."""
    found = top_k(dense(queries, docs, dim, group, key).withColumn("sem", F.round("sem", 9)), "sem", k, [key]).drop("rank")
    bare = docs.where(~usable(F.col("embedding"), dim)).select(group, key)
    w = Window.partitionBy(group).orderBy(key)
    bare = bare.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")  # no list needs more
    rest = queries.where(usable(F.col("vector"), dim)).select("qid", group).join(bare, group).select("qid", group, key, F.lit(-1.0).alias("sem"))
    return top_k(found.unionByName(rest), "sem", k, [key])


def minmax(score: Column, by: str = "qid") -> Column:
    """Scaled to 0..1 within the query; a constant list is all 1."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-12, F.lit(1.0)).otherwise((score - low) / (high - low))


def scan_lists(lexical: DataFrame, sem: DataFrame, scan: int, group: str = "conv_id", key: str = "episode_id") -> DataFrame:
    """Union of both sides' ``scan`` best: qid, group, key, lex_rank, sem_rank (NULL outside the side's list)."""
    ids = ["qid", group, key]
    first = top_k(lexical.withColumn("lex", F.round("lex", 9)), "lex", scan, [key]).select(*ids, F.col("rank").alias("lex_rank"))
    second = top_k(sem.withColumn("sem", F.round("sem", 9)).where(F.col("sem") > 0), "sem", scan, [key]).select(*ids, F.col("rank").alias("sem_rank"))
    return first.join(second, ids, "full")


def candidates(queries: DataFrame, docs: DataFrame, scan: int, dim: int = 96, group: str = "conv_id", key: str = "episode_id", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Both top lists united, with the true score of either side, 0 where there is none.

    Each side is cut to its list first; what the other side says of a row is then
    computed for the united rows alone, which are at most 2 * ``scan`` a query.
    """
    index = index or tuple(stash(part, "index") for part in lexical_index(docs, group, key))
    ids = ["qid", group, key]
    both = stash(scan_lists(bm25(queries, docs, group, key, index=index), dense(queries, docs, dim, group, key), scan, group, key), "union")
    lex = bm25_of(both, queries, index, group, key).select(*ids, F.round("lex", 9).alias("lex"))
    sem = dense_of(both, queries, docs, dim, group, key).select(*ids, F.round("sem", 9).alias("sem")).where(F.col("sem") > 0)
    scored = both.join(lex, ids, "left").join(sem, ids, "left")
    return scored.select(*ids, F.coalesce("lex", F.lit(0.0)).alias("lex"), F.coalesce("sem", F.lit(0.0)).alias("sem"), "lex_rank", "sem_rank")


def fuse(pool: DataFrame, method: str = "convex", alpha: float = 0.7, rrf_k: int = 60) -> DataFrame:
    """Candidates with ``score``: convex, rrf or max."""
    if method == "convex":
        score = alpha * minmax(F.col("sem")) + (1 - alpha) * minmax(F.col("lex"))
    elif method == "rrf":
        part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
        score = part("lex_rank") + part("sem_rank")
    elif method == "max":
        score = F.greatest("lex", "sem")
    else:
        raise ValueError(f"unknown fusion {method!r}")
    return pool.withColumn("score", F.round(score, 9))


def hybrid_search(queries: DataFrame, docs: DataFrame, scan: int = 30, k: int = 10, method: str = "convex", alpha: float = 0.7, dim: int = 96, key: str = "episode_id", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best of each query. ``queries``: qid, conv_id, terms, vector; ``docs``: conv_id, key, text, embedding."""
    pool = candidates(queries, docs, scan, dim, key=key, index=index)
    return top_k(fuse(pool, method, alpha), "score", k, [key])
