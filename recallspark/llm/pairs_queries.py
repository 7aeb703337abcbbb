"""Queries of cut texts and broken pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.endings import find_cut, sides_of
from recallspark.llm.pairs import find_defects, own_defects
from recallspark.session import stash, table


def _cut_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with ``cut``, which is false where the language or refusal rule of problem 5 fires."""
    cut = find_cut(stash(sides_of(table(spark, sf_dir, "per_question"), own_defects), "sides"))
    other = F.array_contains("found", "language") | F.array_contains("found", "refusal")
    return cut.where(F.col("side") == "prediction").withColumn("cut", F.col("cut") & ~other)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose prediction was cut."""
    return _cut_predictions(spark, sf_dir).where("cut").select("pq_id")


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each run's predictions are cut; records without an answer count as not cut."""
    records = table(spark, sf_dir, "per_question").where(F.col("pq_id").isNotNull()).select("pq_id", "run_name").distinct()
    cut = _cut_predictions(spark, sf_dir).where("cut").select("pq_id", F.lit(1).alias("cut"))
    rows = records.join(cut, "pq_id", "left").groupBy("run_name")
    return rows.agg(
        F.count("*").alias("records"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut"),
        F.round(F.coalesce(F.sum("cut"), F.lit(0)) / F.count("*"), 6).alias("share"),
    )


def p4_flag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the found cuts agree with the call records' flags (reader calls of the question)."""
    calls = table(spark, sf_dir, "llm_calls").where(F.col("pq_id").isNotNull() & (F.lower("role") == "reader"))
    flags = calls.groupBy("pq_id").agg(F.max(F.coalesce("output_capped", F.lit(False))).alias("capped"), F.max(F.coalesce("transport_failed", F.lit(False))).alias("failed"))
    rows = _cut_predictions(spark, sf_dir).select("pq_id", "cut").join(flags, "pq_id", "left")
    return rows.groupBy("cut", "capped", "failed").agg(F.count("*").alias("records"))


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_defects(table(spark, sf_dir, "per_question"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective sides with the first defect in order."""
    return _defects(spark, sf_dir).select("pq_id", "side", F.element_at("defects", 1).alias("defect"))


def p5_all_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect that triggers, one row each."""
    return _defects(spark, sf_dir).select("pq_id", "side", F.explode("defects").alias("defect"))


QUERIES = {
    "p4_found": p4_found, "p4_runs": p4_runs, "p4_flag_agreement": p4_flag_agreement,
    "p5_found": p5_found, "p5_all_defects": p5_all_defects,
}
SQL: dict[str, str] = {}
