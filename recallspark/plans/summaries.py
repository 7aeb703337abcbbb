"""Summaries of groups as notes: the largest groups first, evenly spaced excerpts, one call each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import strip_attribution
from recallspark.models import call_column
from recallspark.plans.reader import fill

PROMPT = "These excerpts come from one part of a conversation, in order. Say in one or two sentences what it is about and what is settled in it, with names and dates.\n\n{excerpts}"


def excerpt_rows(members: DataFrame, texts: DataFrame, most: int = 14, chars: int = 220) -> DataFrame:
    """conv_id, group_id, seq, episode_id, excerpt: every (n // most)-th member from the first, ``most`` of them.

    ``members``: conv_id, group_id, episode_id; ``texts``: episode_id, seq, text. Members
    are placed by counting buckets of the sequence, so a group of any size is never sorted in one task.
    """
    rows = members.join(texts, "episode_id").withColumn("_b", F.floor(F.col("seq") / 10_000))
    by = ["conv_id", "group_id"]
    counts = rows.groupBy(*by, "_b").count()
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    sizes = counts.groupBy(*by).agg(F.sum("count").alias("n"))
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("seq", "episode_id")) - 1).join(offsets, [*by, "_b"]).join(sizes, by)
    place, step = F.col("_o") + F.col("_n"), F.greatest(F.lit(1), F.floor(F.col("n") / most))
    shown = placed.where((place % step == 0) & (place / step < most))
    plain = F.array_join(F.filter(F.split(strip_attribution(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != ""), " ")
    return shown.select(*by, "seq", "episode_id", F.substring(plain, 1, chars).alias("excerpt"))


def largest_groups(members: DataFrame, least: int = 3, most: int = 60) -> DataFrame:
    """conv_id, group_id, n, rank: groups of at least ``least`` members, the ``most`` largest of a conversation."""
    sizes = members.groupBy("conv_id", "group_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("conv_id").orderBy(F.desc("n"), "group_id")
    return sizes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def summarise_groups(members: DataFrame, texts: DataFrame, model, least: int = 3, most: int = 60) -> DataFrame:
    """Notes of the groups' summaries; replies under 20 characters make none.

    ``members``: conv_id, group_id, episode_id; ``texts``: episode_id, seq, text, stamp.
    Provenance is every member; evidence ids are left empty, as a summary that
    inherited them would count as retrieving what it only stands for.
    """
    kept = largest_groups(members, least, most)
    some = members.join(kept.select("conv_id", "group_id", "rank"), ["conv_id", "group_id"])
    lines = excerpt_rows(some.select("conv_id", "group_id", "episode_id"), texts.select("episode_id", "seq", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "excerpt"))), lambda x: F.concat(F.lit("- "), x["excerpt"])), "\n")
    prompts = lines.groupBy("conv_id", "group_id").agg(joined.alias("excerpts")).select("conv_id", "group_id", fill(PROMPT, excerpts=F.col("excerpts")).alias("prompt"))
    said = call_column(prompts, "prompt", model, max_tokens=200, temperature=0.0)
    plain = F.array_join(F.filter(F.split(F.coalesce("call.text", F.lit("")), r"\s+"), lambda x: x != ""), " ")
    made = said.select("conv_id", "group_id", plain.alias("statement")).where(F.length("statement") >= 20)
    stamped = some.join(texts.select("episode_id", "seq", "stamp"), "episode_id")
    spans = stamped.groupBy("conv_id", "group_id", "rank").agg(
        F.min_by("stamp", F.when(F.coalesce("stamp", F.lit("")) != "", F.col("seq"))).alias("event_time"), F.max_by("stamp", F.when(F.coalesce("stamp", F.lit("")) != "", F.col("seq"))).alias("recorded_time"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "episode_id"))), lambda x: x["episode_id"]).alias("provenance"),
    )
    rows = made.join(spans, ["conv_id", "group_id"])
    nothing = F.lit(None).cast("string")
    return rows.select(
        "conv_id", F.concat(F.lit("gs-"), F.substring(F.sha2(F.concat_ws("|", "conv_id", F.col("group_id").cast("string")), 256), 1, 10)).alias("note_id"),
        F.concat(F.lit("group "), (F.col("rank") - 1).cast("string")).alias("subject"), F.lit("summary").alias("attribute"), "statement", "event_time", "recorded_time",
        nothing.alias("valid_from"), nothing.alias("valid_until"), F.lit("active").alias("status"), nothing.alias("superseded_by"), "provenance",
        F.array().cast("array<string>").alias("evidence_ids"), nothing.alias("session"),
    )
