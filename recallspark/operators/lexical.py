"""BM25 over postings tables, per conversation.

``postings`` and its statistics are plain DataFrames, to be written as tables and
bucketed by conversation and term; a query touches only its own terms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import tokens

K1, B = 1.5, 0.75


def postings(docs: DataFrame, group: str = "conv_id", key: str = "episode_id", text: str = "text") -> DataFrame:
    """group, key, term, tf, doc_len; documents without a token have no posting."""
    rows = docs.select(group, key, tokens(F.col(text)).alias("t"))
    words = rows.select(group, key, F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    return words.groupBy(group, key, "term").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def corpus_stats(docs: DataFrame, group: str = "conv_id", text: str = "text") -> DataFrame:
    """group, n_docs, avgdl: empty documents count in both."""
    n = F.size(tokens(F.col(text)))
    return docs.groupBy(group).agg(F.count("*").alias("n_docs"), F.sum(n).alias("total_len")).select(
        group, "n_docs", "total_len", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(1.0).alias("avgdl")
    )


def term_stats(posts: DataFrame, corpus: DataFrame, group: str = "conv_id") -> DataFrame:
    """group, term, df, idf."""
    df = posts.groupBy(group, "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(corpus, group).select(group, "term", "df", idf.alias("idf"), "avgdl")


#: A conversation's share of a frequent term is spread over so many tasks.
SALTS = 16


def salted(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))


def every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def lexical_index(docs: DataFrame, group: str = "conv_id", key: str = "episode_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings and corpus statistics, as ``bm25`` takes them and ``store`` writes them."""
    return postings(docs, group, key, text), corpus_stats(docs, group, text)


def asked_terms(queries: DataFrame, index: tuple[DataFrame, DataFrame], group: str = "conv_id") -> DataFrame:
    """qid, group, term, qtf, idf, avgdl of the terms that occur."""
    posts, corpus = index
    asked = queries.select("qid", group, F.explode(tokens(F.col("terms"))).alias("term")).groupBy("qid", group, "term").agg(F.count("*").alias("qtf"))
    wanted = asked.select(group, "term").distinct()
    return asked.join(term_stats(posts.join(wanted, [group, "term"], "left_semi"), corpus, group), [group, "term"])


def _part() -> Column:
    tf = F.col("tf")
    return F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))


def bm25(queries: DataFrame, docs: DataFrame, group: str = "conv_id", key: str = "episode_id", text: str = "text", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """qid, group, key, lex for every document that shares a term with the query.

    ``queries``: qid, group and ``terms`` (the query text). ``index``: stored postings
    and corpus statistics; without it they are derived from ``docs``.
    """
    index = index or lexical_index(docs, group, key, text)
    asked = every_salt(asked_terms(queries, index, group))
    scored = asked.join(salted(index[0], key), [group, "term", "_salt"])
    return scored.groupBy("qid", group, key).agg(F.sum(_part()).alias("lex"))


def bm25_of(pairs: DataFrame, queries: DataFrame, index: tuple[DataFrame, DataFrame], group: str = "conv_id", key: str = "episode_id") -> DataFrame:
    """As ``bm25``, for the given (qid, group, key) alone."""
    rows = pairs.select("qid", group, key).join(asked_terms(queries, index, group), ["qid", group])
    return rows.join(index[0], [group, "term", key]).groupBy("qid", group, key).agg(F.sum(_part()).alias("lex"))


def top_k(scored: DataFrame, score: str, k: int, tie: list[str], by: str = "qid") -> DataFrame:
    """The k best per query with their rank; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _shorter(word: str) -> set[str]:
    """The word and what one deletion leaves: two words within one edit share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _within_one(a: str, b: str) -> bool:
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def stem_hits(wanted: list[list[str]], held: list[list[str]], short: int = 6) -> np.ndarray:
    """Of each query (row) how many stems each document (column) has, or has within one edit if both are short."""
    words = {w: i for i, w in enumerate(dict.fromkeys(w for h in held for w in h))}
    has = np.zeros((len(words) + 1, len(held)), bool)
    for j, h in enumerate(held):
        has[[words[w] for w in h], j] = True
    bits = np.packbits(has, axis=1)
    near: dict[str, list[str]] = {}
    for w in words:
        if len(w) <= short:
            for v in _shorter(w):
                near.setdefault(v, []).append(w)
    found: dict[str, np.ndarray] = {}
    out = np.zeros((len(wanted), len(held)), np.int32)
    for i, want in enumerate(wanted):
        for w in want:
            if w not in found:
                like = {x for v in _shorter(w) for x in near.get(v, ()) if _within_one(w, x)} if len(w) <= short else set()
                at = [words[x] for x in like | ({w} & words.keys())]
                found[w] = np.bitwise_or.reduce(bits[at], axis=0) if at else bits[-1]
        if len(want):
            out[i] = np.unpackbits(np.array([found[w] for w in want]), axis=1, count=len(held)).sum(0)
    return out


def fuzzy_top(queries: DataFrame, docs: DataFrame, k: int, block: int = 2048, asked: int = 256) -> DataFrame:
    """qid, episode_id, overlap, rank: the k documents of its conversation with the largest share of a query's stems.

    ``queries``: qid, conv_id, want; ``docs``: conv_id, episode_id, have (stems; a query's one for each distinct
    token). All documents are compared, in blocks of a conversation; each gives k rows a query.
    """
    sizes = docs.groupBy("conv_id").count().join(queries.groupBy("conv_id").agg(F.count("*").alias("asks")), "conv_id")
    sizes = sizes.select("conv_id", F.ceil(F.col("count") / block).alias("nb"), F.ceil(F.col("asks") / asked).alias("na"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    q = queries.join(sizes, "conv_id").select(F.col("conv_id").alias("c"), "qid", "want", own("qid", "na").alias("a"), every("nb").alias("b"))
    d = docs.join(sizes, "conv_id").select(F.col("conv_id").alias("c"), "episode_id", "have", every("na").alias("a"), own("episode_id", "nb").alias("b"))

    def best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(d):
            d = d.sort_values("episode_id", kind="stable")
            ids, want = d["episode_id"].to_numpy(), [list(w) for w in q["want"]]
            hits = stem_hits(want, [list(h) for h in d["have"]])
            for qid, w, n in zip(q["qid"], want, hits):
                rows += [(qid, ids[j], round(int(n[j]) / max(len(w), 1), 9)) for j in np.argsort(-n, kind="stable")[:k]]
        return pd.DataFrame(rows, columns=["qid", "episode_id", "overlap"])

    by = ["c", "a", "b"]
    found = q.groupBy(*by).cogroup(d.groupBy(*by)).applyInPandas(best, "qid string, episode_id string, overlap double")
    return top_k(found, "overlap", k, ["episode_id"])
