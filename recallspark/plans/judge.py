"""Verdicts on answers: every distinct answer is judged once, by cache or by call.

A refusal is never correct; a verdict that cannot be read is NULL and does not count
as wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions.jsonx import first_json_object
from recallspark.functions.text import judge_key
from recallspark.models import call_column
from recallspark.operators.evaluation import merge_cache
from recallspark.plans.reader import fill
from recallspark.session import stash

#: Limits on the answer's tokens of the first call, and of the one where the first could not be read.
BUDGETS = (128, 512)
VERSION = "v2"
PROMPT = (
    "Compare an answer with the reference answer to a question. It is CORRECT if it says the same in substance: more detail, other wording or another way of writing a date do no harm. "
    "It is WRONG if it contradicts the reference, misses what was asked or says nothing.\n\nQUESTION: {question}\nREFERENCE: {gold}\nANSWER: {prediction}\n\n"
    'Reply with JSON alone: {"verdict": "CORRECT" or "WRONG", "reason": "a few words"}'
)


def parse_verdict(raw: Column, found: Column) -> Column:
    """struct(score, reason) of a reply, or NULL. ``found``: its first JSON object (``first_json_object``).

    Without an object the words decide: CORRECT without WRONG, else WRONG.
    """
    up = F.upper(F.coalesce(raw, F.lit("")))
    word = F.when(F.contains(up, F.lit("CORRECT")) & ~F.contains(up, F.lit("WRONG")), 1.0).when(F.contains(up, F.lit("WRONG")), 0.0)
    verdict, reason = F.get_json_object(found, "$.verdict"), F.substring(F.coalesce(F.get_json_object(found, "$.reason"), F.lit("")), 1, 120)
    by_json = F.struct(F.upper(F.coalesce(verdict, F.lit(""))).startswith("CORRECT").cast("double").alias("score"), reason.alias("reason"))
    return F.when(found.isNotNull(), by_json).when(word.isNotNull(), F.struct(word.alias("score"), F.lit("parsed from text").alias("reason")))


def judge_once(items: DataFrame, model, budgets=BUDGETS) -> DataFrame:
    """key, score, reason of items (key, question, gold, prediction); those unread are asked again with the next budget."""
    rest, out = items.select("key", "question", "gold", "prediction"), None
    for budget in budgets:
        text = fill(PROMPT, question=F.col("question"), gold=F.col("gold"), prediction=F.col("prediction"))
        done = call_column(rest.withColumn("prompt", text), "prompt", model, max_tokens=budget, temperature=0.0)
        read = done.withColumn("found", first_json_object("call.text"))
        read = stash(read.select("key", "question", "gold", "prediction", parse_verdict(F.col("call.text"), F.col("found")).alias("v")), "judged")
        part = read.where(F.col("v").isNotNull()).select("key", "v.score", "v.reason")
        out, rest = part if out is None else out.unionByName(part), read.where(F.col("v").isNull()).drop("v")
    return out.unionByName(rest.select("key", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reason")))


def judge(records: DataFrame, model, cache: DataFrame | None = None, tag: str = "judge") -> tuple[DataFrame, DataFrame]:
    """Verdict of each record (qid, question, gold, prediction), and the cache with what was judged now.

    Empty predictions and golds are 0 without a call. ``cache``: key, score, reason.
    Verdicts that could not be read do not enter the cache, so they are asked for again.
    """
    rows = records.select("qid", "question", F.coalesce("gold", F.lit("")).alias("gold"), F.coalesce("prediction", F.lit("")).alias("prediction"))
    rows = rows.withColumn("key", judge_key(VERSION, tag, F.col("question"), F.col("gold"), F.col("prediction")))
    blank = (F.trim("gold") == "") | (F.trim("prediction") == "")
    cache = cache if cache is not None else records.sparkSession.createDataFrame([], "key string, score double, reason string")
    fresh = rows.where(~blank).groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("question", "gold", "prediction")]).join(cache.select("key"), "key", "left_anti")
    judged = stash(judge_once(fresh, model), "verdicts")
    merged = merge_cache(cache.select("key", "score", "reason", F.lit(0).alias("order")), judged.where(F.col("score").isNotNull()).withColumn("order", F.lit(0)).select("key", "score", "reason", "order"))
    merged = stash(merged.select("key", "score", "reason"), "cache")
    scored = rows.join(merged.select("key", "score"), "key", "left").select("qid", F.when(blank, 0.0).otherwise(F.col("score")).alias("judge"))
    return scored, merged


def judged_path(path: str, mark: str = "j2") -> str:
    """The name of a result file's judged twin."""
    return path.removesuffix(".json") + f".{mark}.json"


def preferred_files(spark: SparkSession, files: DataFrame, mark: str = "j2") -> DataFrame:
    """file, read: of each result file the judged twin if there is one. ``files``: file."""
    twins = files.where(F.col("file").endswith(f".{mark}.json")).select(F.regexp_replace("file", rf"\.{mark}\.json$", ".json").alias("file"), F.col("file").alias("twin"))
    own = files.where(~F.col("file").endswith(f".{mark}.json"))
    return own.join(twins, "file", "left").select("file", F.coalesce("twin", "file").alias("read"))
