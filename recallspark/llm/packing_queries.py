"""Queries of packing and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallspark.llm.mixing import mix, mix_report
from recallspark.llm.packing import pack, packing_report
from recallspark.session import table


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens of every text, or of each part of a larger one."""
    return pack(table(spark, sf_dir, "documents"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    return packing_report(pack(table(spark, sf_dir, "documents")))


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each record enters the mixture."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source was to have and reached."""
    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(mix(table(spark, sf_dir, "documents"), targets), targets)


QUERIES = {"p6_containers": p6_containers, "p6_report": p6_report, "p7_uses": p7_uses, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
