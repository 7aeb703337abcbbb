"""Queries of the splitter and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.splitting import split_episodes
from recallspark.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that had to be cut."""
    return split_episodes(table(spark, sf_dir, "episodes")).select("episode_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their pieces in order, with offsets, overlap and the kind of boundary they end at."""
    return split_episodes(table(spark, sf_dir, "episodes"))


def p2_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each episode hold together: core tokens, and the digest of the joined cores.

    ``kept`` is whether no piece exceeds 800 tokens and each but the first repeats 50.
    """
    pieces = split_episodes(table(spark, sf_dir, "episodes"))
    core = F.expr("right(text, end_char - start_char)")
    cores = F.array_sort(F.collect_list(F.struct("piece_no", core.alias("text"))))
    kept = (F.col("tokens") <= 800) & ((F.col("piece_no") == 1) | (F.col("overlap_tokens") == 50))
    return pieces.groupBy("episode_id").agg(
        F.sum(F.col("tokens") - F.col("overlap_tokens")).alias("tokens"), F.md5(F.array_join(F.transform(cores, lambda c: c["text"]), "")).alias("digest"), F.min(kept).alias("kept")
    )


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_whole": p2_whole}
SQL = {
    "p2_found": """
WITH t AS (
  SELECT episode_id, CASE WHEN trim(coalesce(raw_text, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) = ''
                          THEN array_to_string(episode_utterances, ' ') ELSE raw_text END AS text FROM episodes)
SELECT DISTINCT episode_id FROM t
WHERE episode_id IS NOT NULL AND len(regexp_extract_all(text, '[^ \\t\\n\\r\\x{00A0}]+')) > 800""",
    "p2_whole": """
WITH e AS (
  SELECT episode_id, raw_text, list_filter(coalesce(episode_utterances, []), lambda u: regexp_matches(coalesce(u, ''), '[^ \\t\\n\\r\\x{00A0}]')) AS said FROM episodes
  WHERE episode_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY ingested_at DESC) = 1),
t AS (
  SELECT episode_id, said, CASE WHEN regexp_matches(coalesce(raw_text, ''), '[^ \\t\\n\\r\\x{00A0}]') THEN raw_text ELSE array_to_string(said, ' ') END AS text FROM e),
w AS (
  SELECT episode_id, said, text, array_to_string(regexp_extract_all(text, '[^ \\t\\n\\r\\x{00A0}]+'), ' ') AS held FROM t
  WHERE len(regexp_extract_all(text, '[^ \\t\\n\\r\\x{00A0}]+')) > 800),
f AS (
  SELECT episode_id, text || coalesce(array_to_string(list_transform(list_filter(said, lambda u: NOT contains(held, array_to_string(regexp_extract_all(u, '[^ \\t\\n\\r\\x{00A0}]+'), ' '))),
         lambda u: chr(10) || chr(10) || u), ''), '') AS text FROM w)
SELECT episode_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x{00A0}]+')) AS BIGINT) AS tokens, md5(text) AS digest, true AS kept FROM f""",
}
