"""Queries of reading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.levels import familiar_word_scores, reading_levels
from recallspark.llm.mixing import canonical_source
from recallspark.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every document of at least 40 runs."""
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels")).select("doc_id", "level")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and level, with the share of the level in its source."""
    levels = reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))
    counts = levels.groupBy(F.coalesce(canonical_source(F.col("source")), F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("documents"), F.round(F.avg("level"), 4).alias("mean_level"),
        *[F.round(F.avg((F.col("level") == k).cast("int")), 4).alias(f"share_{k}") for k in range(1, 6)],
    )
    return counts


def p8_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The familiar-word formula's two numbers and score."""
    scores = familiar_word_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", *[F.round(c, 6).alias(c) for c in ("unfamiliar_share", "sentence_length", "score")])


QUERIES = {"p8_found": p8_found, "p8_profile": p8_profile, "p8_formula": p8_formula}
SQL: dict[str, str] = {}
