"""The tables as the engine reads them: one row per id, text and order filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.session import table


def latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Of each id the row delivered last, reduced by partial aggregation."""
    best = F.max_by(F.struct(*columns), F.coalesce(F.col("ingested_at"), F.lit("1900-01-01").cast("timestamp_ntz"))).alias("r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "r.*")


def number_of(c: Column) -> Column:
    """The number at the end of an id; ids count up as they are given out."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("bigint"), F.lit(-1))


def with_seq(df: DataFrame, group: str = "conv_id", key: str = "episode_id", bucket: int = 10_000) -> DataFrame:
    """``seq``: position of the row in its group by id, from 0.

    Ranks come from the counts of id buckets plus a row number in the bucket, so a
    group that holds a third of all rows is not sorted by one task.
    """
    keyed = df.withColumn("_b", F.floor(number_of(F.col(key)) / bucket))
    counts = keyed.groupBy(group, "_b").count()
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(group, "_b").orderBy(key)
    numbered = keyed.withColumn("_n", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [group, "_b"]).withColumn("seq", F.col("_o") + F.col("_n")).drop("_b", "_n", "_o")


def running_sum(df: DataFrame, group: str, order: str, values: dict[str, Column], bucket: int = 10_000) -> DataFrame:
    """``df`` with running sums (inclusive) of ``values`` in the order of a whole number that is unique in its group.

    As in ``with_seq``, sums inside buckets are added to those of the buckets before,
    so no task sorts a whole group.
    """
    keyed = df.select("*", *[c.alias(f"_v_{k}") for k, c in values.items()], F.floor(F.col(order) / bucket).alias("_b"))
    totals = keyed.groupBy(group, "_b").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_b", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    inside = Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(inside) for k in values}).join(offsets, [group, "_b"])
    return joined.select(*df.columns, *[(F.col(f"_o_{k}") + F.col(f"_s_{k}")).alias(k) for k in values])


def episodes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """conv_id, episode_id, text and ``more`` columns of each episode."""
    raw = F.col("raw_text")
    text = F.when(raw.rlike("[^ \\t\\n\\r\\u00a0]"), raw).otherwise(F.coalesce(F.array_join("episode_utterances", " "), F.lit("")))
    rows = table(spark, sf_dir, "episodes").withColumn("text", text)
    return latest(rows, "episode_id", ["conv_id", "text", *more])


def notes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return latest(table(spark, sf_dir, "notes"), "note_id", ["conv_id", "subject", "attribute", "statement", *more])


def questions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    cols = ["run_name", "sample", "question", "gold", "prediction", "category", "category_name", *more]
    return latest(table(spark, sf_dir, "per_question"), "pq_id", cols)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["pq_id", "conv_id", "role", "model", "prompt_tokens", "completion_tokens", "latency_s", "ok", "truncated", "output_capped", "transport_failed"]
    return latest(table(spark, sf_dir, "llm_calls"), "call_id", cols)


def is_query(key: str = "episode_id") -> Column:
    """The stated query set of searches: ids divisible by 100."""
    return number_of(F.col(key)) % 100 == 0


#: The same views for the SQL side.
SQL_EPISODES = """
ep AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY episode_id) - 1 AS seq,
         CAST(regexp_extract(episode_id, '(\\d+)$', 1) AS BIGINT) % 100 = 0 AS is_query
  FROM (SELECT conv_id, episode_id, speaker, episode_speakers, episode_utterances, session_id, session_datetime, ts_raw, modality,
               evidence_ids, embedding, caption_concise, image_path, source,
               CASE WHEN regexp_matches(coalesce(raw_text, ''), '[^ \\t\\n\\r\\x{00A0}]') THEN raw_text
                    ELSE coalesce(array_to_string(episode_utterances, ' '), '') END AS text
        FROM episodes WHERE episode_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY ingested_at DESC) = 1))"""
SQL_NOTES = """
nt AS (
  SELECT * FROM notes WHERE note_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY ingested_at DESC) = 1)"""
SQL_QUESTIONS = """
qs AS (
  SELECT * FROM per_question WHERE pq_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pq_id ORDER BY ingested_at DESC) = 1)"""
SQL_CALLS = """
cl AS (
  SELECT * FROM llm_calls WHERE call_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ingested_at DESC) = 1)"""


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def sql_usable(v: str, dim: int = 96) -> str:
    return (
        f"(coalesce(len({v}), 0) = {dim} AND len(list_filter({v}, lambda x: x IS NOT NULL AND isfinite(x))) = {dim} "
        f"AND len(list_filter({v}, lambda x: x <> 0)) > 0)"
    )
