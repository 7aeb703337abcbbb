"""Queries of scalar text functions, lexical and hybrid search, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions import text as T
from recallspark.functions.vectors import norm, unit, usable
from recallspark.operators import views as V
from recallspark.operators.evaluation import minmax_scaled
from recallspark.operators.fusion import candidates, dense, dense_baseline, fuse, hybrid_search
from recallspark.operators.lexical import bm25, corpus_stats, fuzzy_top, postings, term_stats, top_k

SCAN, K = 30, 10


def _docs(spark, d):
    return V.episodes(spark, d, "embedding")


def _queries(docs: DataFrame) -> DataFrame:
    return docs.where(V.is_query()).select(F.col("episode_id").alias("qid"), "conv_id", F.col("text").alias("terms"), F.col("embedding").alias("vector"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    e = V.episodes(spark, d)
    t = T.tokens(F.col("text"))
    return e.select("episode_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"), T.token_count(F.col("text")).alias("runs"), T.approximate_tokens(F.col("text")).alias("approx"))


def normalised_text(spark, d):
    return V.notes(spark, d).select("note_id", T.normalise(F.col("statement")).alias("plain"))


def stem_tokens(spark, d):
    n = V.notes(spark, d).select(F.explode(T.tokens(F.col("statement"))).alias("word"))
    return n.groupBy("word").agg(F.count("*").alias("n")).select("word", T.stem(F.col("word")).alias("stem"), "n")


def postings_stats(spark, d):
    p = postings(V.episodes(spark, d))
    return p.groupBy("conv_id").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.countDistinct("term").alias("terms"), F.max("tf").alias("most"))


def bm25_idf(spark, d):
    e = V.episodes(spark, d)
    return term_stats(postings(e), corpus_stats(e)).select("conv_id", "term", "df", F.round("idf", 9).alias("idf"))


def bm25_topk(spark, d):
    e = V.episodes(spark, d, "embedding")
    s = bm25(_queries(e), e).withColumn("lex", F.round("lex", 9))
    return top_k(s, "lex", K, ["episode_id"]).select("qid", "episode_id", "rank", F.round("lex", 6).alias("lex"))


def note_bm25_topk(spark, d):
    n = V.notes(spark, d).withColumn("text", F.concat_ws(" ", "subject", "attribute", "statement"))
    q = n.where(V.is_query("note_id")).select(F.col("note_id").alias("qid"), "conv_id", F.col("text").alias("terms"))
    s = bm25(q, n, key="note_id").withColumn("lex", F.round("lex", 9))
    return top_k(s, "lex", K, ["note_id"]).select("qid", "note_id", "rank", F.round("lex", 6).alias("lex"))


def dense_topk(spark, d):
    e = _docs(spark, d)
    s = dense(_queries(e), e).withColumn("sem", F.round("sem", 9))
    return top_k(s, "sem", K, ["episode_id"]).select("qid", "episode_id", "rank", F.round("sem", 6).alias("sem"))


def dense_last(spark, d):
    """The end of the dense baseline's 200 best: episodes without a usable vector, which score -1."""
    e = _docs(spark, d)
    s = dense_baseline(_queries(e), e, 200)
    return s.where(F.col("sem") == -1).select("qid", "episode_id", "rank")


def _hybrid(spark, d, method):
    e = _docs(spark, d)
    found = hybrid_search(_queries(e), e, SCAN, K, method)
    return found.select("qid", "episode_id", "rank", F.round("lex", 5).alias("lex"), F.round("sem", 5).alias("sem"), F.round("score", 5).alias("score"))


def hybrid_convex(spark, d):
    return _hybrid(spark, d, "convex")


def hybrid_rrf(spark, d):
    return _hybrid(spark, d, "rrf")


def hybrid_max(spark, d):
    return _hybrid(spark, d, "max")


def minmax_norm(spark, d):
    n = V.calls(spark, d).where(F.col("latency_s").isNotNull()).withColumn("role", F.coalesce("role", F.lit("none")))
    return minmax_scaled(n, "latency_s", "role").select("call_id", F.round("scaled", 6).alias("scaled"))


def note_hybrid(spark, d):
    n = V.notes(spark, d, "embedding").withColumn("text", F.concat_ws(" ", "subject", "attribute", "statement"))
    q = n.where(V.is_query("note_id")).select(F.col("note_id").alias("qid"), "conv_id", F.col("text").alias("terms"), F.col("embedding").alias("vector"))
    found = hybrid_search(q, n, SCAN, K, key="note_id")
    return found.select("qid", "note_id", "rank", F.round("score", 5).alias("score"))


def interleave_baseline(spark, d):
    """Dense and lexical lists taken in turn, dense first, each id once, cut at k."""
    e = _docs(spark, d)
    q = _queries(e)
    pool = candidates(q, e, K)
    place = F.least(F.coalesce(F.col("sem_rank") * 2 - 1, F.lit(1 << 30)), F.coalesce(F.col("lex_rank") * 2, F.lit(1 << 30)))
    return top_k(pool.withColumn("turn", -place), "turn", K, ["episode_id"]).select("qid", "episode_id", "rank")


def fuzzy_search(spark, d):
    """Share of all distinct query tokens found, up to one edit."""
    words = F.array_distinct(T.tokens(F.col("text")))
    e = V.episodes(spark, d).select("conv_id", "episode_id", F.transform(words, T.stem).alias("stems"))
    q = e.where(V.is_query()).select(F.col("episode_id").alias("qid"), "conv_id", F.col("stems").alias("want"))
    s = fuzzy_top(q, e.select("conv_id", "episode_id", F.array_distinct("stems").alias("have")), K)
    return s.select("qid", "episode_id", "rank", F.round("overlap", 6).alias("overlap"))


def caption_search(spark, d):
    """Captions that share a token with the query's text, best first."""
    e = V.episodes(spark, d, "caption_concise")
    q = e.where(V.is_query()).select(F.col("episode_id").alias("qid"), "conv_id", F.array_distinct(T.tokens(F.col("text"))).alias("want"))
    have = e.where(F.coalesce(F.col("caption_concise"), F.lit("")) != "").select("conv_id", "episode_id", F.array_distinct(T.tokens(F.col("caption_concise"))).alias("have"))
    s = q.join(have, "conv_id").select("qid", "episode_id", F.round(T.fuzzy_overlap(F.col("want"), F.col("have")), 9).alias("overlap")).where("overlap > 0")
    return top_k(s, "overlap", 5, ["episode_id"]).select("qid", "episode_id", "rank", F.round("overlap", 6).alias("overlap"))


def jaccard_neighbours(spark, d):
    e = V.with_seq(V.episodes(spark, d)).select("conv_id", "seq", "episode_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    after = e.select("conv_id", (F.col("seq") - 1).alias("seq"), F.col("t").alias("u"))
    return e.join(after, ["conv_id", "seq"]).select("episode_id", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


def vector_norms(spark, d):
    e = V.episodes(spark, d, "embedding").where(usable(F.col("embedding"), 96))
    u = unit(F.col("embedding"))
    return e.select("episode_id", F.round(norm(F.col("embedding")), 5).alias("norm"), F.round(u[0], 5).alias("first"))


def embedding_coverage(spark, d):
    e = V.episodes(spark, d, "embedding")
    return e.groupBy("conv_id").agg(F.count("*").alias("episodes"), F.sum(usable(F.col("embedding"), 96).cast("bigint")).alias("usable"))


def centroid_by_label(spark, d):
    """Mean vector of each label's unit vectors, at length one again."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.posexplode(unit(F.col("embedding"))).alias("dim", "x"))
    mean = v.groupBy("label", "dim").agg(F.avg("x").alias("mean"))
    length = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("length"))
    return mean.join(length, "label").select("label", "dim", F.round(F.col("mean") / F.greatest("length", F.lit(1e-12)), 6).alias("mean"))


_T = V.sql_tokens
_EP = V.SQL_EPISODES


def _sql_bm25(source: str, key: str, text: str, flag: str) -> str:
    return f"""
tok AS (SELECT conv_id, {key}, term, count(*) AS tf FROM (SELECT conv_id, {key}, unnest({_T(text)}) AS term FROM {source}) GROUP BY ALL),
len AS (SELECT conv_id, {key}, len({_T(text)}) AS dl FROM {source}),
corpus AS (SELECT conv_id, count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM len GROUP BY conv_id),
idf AS (SELECT conv_id, term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, any_value(avgdl) AS avgdl
        FROM tok JOIN corpus USING (conv_id) GROUP BY conv_id, term),
qt AS (SELECT {key} AS qid, conv_id, term, tf AS qtf FROM tok JOIN {source} s USING (conv_id, {key}) WHERE {flag}),
lexed AS (
  SELECT qid, conv_id, t.{key}, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS lex
  FROM qt JOIN idf USING (conv_id, term) JOIN tok t USING (conv_id, term) JOIN len l ON l.conv_id = t.conv_id AND l.{key} = t.{key} GROUP BY ALL)"""


def _sql_dense(source: str, key: str, flag: str) -> str:
    f = "list_transform(embedding, lambda x: x::DOUBLE)"
    return f"""
vec AS (SELECT conv_id, {key}, {f} AS v, {flag} AS asks FROM {source} WHERE {V.sql_usable("embedding")}),
semd AS (
  SELECT a.{key} AS qid, a.conv_id, b.{key}, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS sem
  FROM vec a JOIN vec b USING (conv_id) WHERE a.asks)"""


def _sql_pool(key: str, scan: int) -> str:
    return f"""
pool AS (
  SELECT qid, {key}, coalesce(lex, 0) AS lex, coalesce(sem, 0) AS sem,
         CASE WHEN lex IS NOT NULL AND lr <= {scan} THEN lr END AS lr, CASE WHEN sem IS NOT NULL AND sr <= {scan} THEN sr END AS sr
  FROM (SELECT coalesce(l.qid, s.qid) AS qid, coalesce(l.{key}, s.{key}) AS {key}, lex, sem,
               row_number() OVER (PARTITION BY coalesce(l.qid, s.qid) ORDER BY lex DESC NULLS LAST, coalesce(l.{key}, s.{key})) AS lr,
               row_number() OVER (PARTITION BY coalesce(l.qid, s.qid) ORDER BY sem DESC NULLS LAST, coalesce(l.{key}, s.{key})) AS sr
        FROM lexed l FULL JOIN (SELECT * FROM semd WHERE sem > 0) s ON l.qid = s.qid AND l.{key} = s.{key})
  WHERE (lex IS NOT NULL AND lr <= {scan}) OR (sem IS NOT NULL AND sr <= {scan})),
norm AS (
  SELECT *, CASE WHEN max(lex) OVER w - min(lex) OVER w < 1e-12 THEN 1 ELSE (lex - min(lex) OVER w) / (max(lex) OVER w - min(lex) OVER w) END AS ln_,
            CASE WHEN max(sem) OVER w - min(sem) OVER w < 1e-12 THEN 1 ELSE (sem - min(sem) OVER w) / (max(sem) OVER w - min(sem) OVER w) END AS sn_
  FROM pool WINDOW w AS (PARTITION BY qid))"""


_CONVEX = "round(0.7::DOUBLE * sn_ + (1 - 0.7::DOUBLE) * ln_, 9)"
_RRF = "round(coalesce(1.0::DOUBLE / (60 + lr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0), 9)"


def _sql_hybrid(score: str) -> str:
    return f"""WITH {_EP}, {_sql_bm25("ep", "episode_id", "text", "is_query")}, {_sql_dense("ep", "episode_id", "is_query")}, {_sql_pool("episode_id", SCAN)},
scored AS (SELECT *, {score} AS score FROM norm)
SELECT qid, episode_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(lex, 5) AS lex, round(sem, 5) AS sem, round(score, 5) AS score FROM scored
WINDOW w AS (PARTITION BY qid ORDER BY score DESC, episode_id) QUALIFY row_number() OVER w <= {K}"""


def sql_stem(w: str) -> str:
    cases = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {len(s) + 3} THEN left({w}, length({w}) - {len(s)})" for s in T.SUFFIXES)
    return f"(CASE {cases} ELSE {w} END)"


def _one_byte(w: str) -> str:
    """DuckDB's edit distance counts bytes: give accented letters one byte each."""
    return f"translate({w}, 'áàâäãéèêëíìîïóòôöõúùûüñçßœæ', '!#$%&()*+,-./:;<=>?@[]^{{|}}~')"


def _sql_fuzzy(want: str, have: str) -> str:
    stems = f"list_transform({have}, lambda z: {sql_stem('z')})"
    hit = f"list_contains({stems}, {sql_stem('t')}) OR (length({sql_stem('t')}) <= 6 AND len(list_filter({stems}, lambda y: length(y) <= 6 AND levenshtein({_one_byte(sql_stem('t'))}, {_one_byte('y')}) <= 1)) > 0)"
    return f"CASE WHEN len({want}) > 0 THEN len(list_filter({want}, lambda t: {hit}))::DOUBLE / len({want}) ELSE 0 END"


_NQ = "CAST(regexp_extract(note_id, '(\\d+)$', 1) AS BIGINT) % 100 = 0"
_NT = V.SQL_NOTES + ",\nnx AS (SELECT *, concat_ws(' ', subject, attribute, statement) AS text FROM nt)"

QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, normalised_text, stem_tokens, postings_stats, bm25_idf, bm25_topk, note_bm25_topk, dense_topk, dense_last, hybrid_convex, hybrid_rrf, hybrid_max,
        minmax_norm, note_hybrid, interleave_baseline, fuzzy_search, caption_search, jaccard_neighbours, vector_norms, embedding_coverage, centroid_by_label,
    )
}

SQL = {
    "tokenize_counts": f"WITH {_EP} SELECT episode_id, CAST(len({_T('text')}) AS INTEGER) AS tokens, CAST(len(list_distinct({_T('text')})) AS INTEGER) AS distinct_tokens, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS runs, CAST(greatest(1, length(text) // 4) AS INTEGER) AS approx FROM ep",
    "normalised_text": f"WITH {V.SQL_NOTES} SELECT note_id, trim(regexp_replace(lower(statement), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS plain FROM nt",
    "stem_tokens": f"WITH {V.SQL_NOTES}, w AS (SELECT unnest({_T('statement')}) AS word FROM nt) SELECT word, {sql_stem('word')} AS stem, count(*) AS n FROM w GROUP BY word",
    "postings_stats": f"WITH {_EP}, p AS (SELECT conv_id, episode_id, term, count(*) AS tf FROM (SELECT conv_id, episode_id, unnest({_T('text')}) AS term FROM ep) GROUP BY ALL) SELECT conv_id, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT term) AS terms, max(tf) AS most FROM p GROUP BY conv_id",
    "bm25_idf": f"WITH {_EP}, {_sql_bm25('ep', 'episode_id', 'text', 'is_query')} SELECT conv_id, term, df, round(idf, 9) AS idf FROM idf",
    "bm25_topk": f"WITH {_EP}, {_sql_bm25('ep', 'episode_id', 'text', 'is_query')} SELECT qid, episode_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(lex, 6) AS lex FROM lexed WINDOW w AS (PARTITION BY qid ORDER BY lex DESC, episode_id) QUALIFY row_number() OVER w <= {K}",
    "note_bm25_topk": f"WITH {_NT}, {_sql_bm25('nx', 'note_id', 'text', _NQ)} SELECT qid, note_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(lex, 6) AS lex FROM lexed WINDOW w AS (PARTITION BY qid ORDER BY lex DESC, note_id) QUALIFY row_number() OVER w <= {K}",
    "dense_topk": f"WITH {_EP}, {_sql_dense('ep', 'episode_id', 'is_query')} SELECT qid, episode_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(sem, 6) AS sem FROM semd WINDOW w AS (PARTITION BY qid ORDER BY sem DESC, episode_id) QUALIFY row_number() OVER w <= {K}",
    "dense_last": f"WITH {_EP}, {_sql_dense('ep', 'episode_id', 'is_query')}, b AS (SELECT qid, episode_id, sem FROM semd UNION ALL SELECT v.episode_id, e.episode_id, -1 FROM vec v JOIN ep e ON e.conv_id = v.conv_id WHERE v.asks AND NOT {V.sql_usable('e.embedding')}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sem DESC, episode_id) AS rank FROM b) SELECT qid, episode_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 200 AND sem = -1",
    "hybrid_convex": _sql_hybrid(_CONVEX),
    "hybrid_rrf": _sql_hybrid(_RRF),
    "hybrid_max": _sql_hybrid("round(greatest(lex, sem), 9)"),
    "minmax_norm": f"WITH {V.SQL_CALLS}, b AS (SELECT call_id, latency_s AS x, min(latency_s) OVER w AS lo, max(latency_s) OVER w AS hi FROM cl WHERE latency_s IS NOT NULL WINDOW w AS (PARTITION BY coalesce(role, 'none'))) SELECT call_id, round(CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (x - lo) / (hi - lo) END, 6) AS scaled FROM b",
    "note_hybrid": f"WITH {_NT}, {_sql_bm25('nx', 'note_id', 'text', _NQ)}, {_sql_dense('nx', 'note_id', _NQ)}, {_sql_pool('note_id', SCAN)}, scored AS (SELECT *, {_CONVEX} AS score FROM norm) SELECT qid, note_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(score, 5) AS score FROM scored WINDOW w AS (PARTITION BY qid ORDER BY score DESC, note_id) QUALIFY row_number() OVER w <= {K}",
    "interleave_baseline": f"WITH {_EP}, {_sql_bm25('ep', 'episode_id', 'text', 'is_query')}, {_sql_dense('ep', 'episode_id', 'is_query')}, {_sql_pool('episode_id', K)} SELECT qid, episode_id, CAST(row_number() OVER w AS INTEGER) AS rank FROM pool WINDOW w AS (PARTITION BY qid ORDER BY least(coalesce(sr * 2 - 1, 1 << 30), coalesce(lr * 2, 1 << 30)), episode_id) QUALIFY row_number() OVER w <= {K}",
    "fuzzy_search": f"WITH {_EP}, t AS (SELECT conv_id, episode_id, is_query, list_distinct({_T('text')}) AS have FROM ep), s AS (SELECT w.episode_id AS qid, t.episode_id, round({_sql_fuzzy('w.have', 't.have')}, 9) AS overlap FROM t w JOIN t USING (conv_id) WHERE w.is_query) SELECT qid, episode_id, CAST(row_number() OVER o AS INTEGER) AS rank, round(overlap, 6) AS overlap FROM s WINDOW o AS (PARTITION BY qid ORDER BY overlap DESC, episode_id) QUALIFY row_number() OVER o <= {K}",
    "caption_search": f"WITH {_EP}, w AS (SELECT episode_id AS qid, conv_id, list_distinct({_T('text')}) AS want FROM ep WHERE is_query), h AS (SELECT conv_id, episode_id, list_distinct({_T('caption_concise')}) AS have FROM ep WHERE coalesce(caption_concise, '') <> ''), s AS (SELECT qid, h.episode_id, round({_sql_fuzzy('want', 'have')}, 9) AS overlap FROM w JOIN h USING (conv_id)) SELECT qid, episode_id, CAST(row_number() OVER o AS INTEGER) AS rank, round(overlap, 6) AS overlap FROM s WHERE overlap > 0 WINDOW o AS (PARTITION BY qid ORDER BY overlap DESC, episode_id) QUALIFY row_number() OVER o <= 5",
    "jaccard_neighbours": f"WITH {_EP}, t AS (SELECT conv_id, seq, episode_id, list_distinct({_T('text')}) AS t FROM ep) SELECT a.episode_id, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) ELSE 0 END, 6) AS jaccard FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.seq = a.seq + 1",
    "vector_norms": f"WITH {_EP}, v AS (SELECT episode_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM ep WHERE {V.sql_usable('embedding')}) SELECT episode_id, round(sqrt(list_dot_product(v, v)), 5) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first FROM v",
    "embedding_coverage": f"WITH {_EP} SELECT conv_id, count(*) AS episodes, CAST(sum(CAST({V.sql_usable('embedding')} AS INTEGER)) AS BIGINT) AS usable FROM ep GROUP BY conv_id",
    "centroid_by_label": "WITH u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)), m AS (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u) GROUP BY ALL) SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS mean FROM m",
}
