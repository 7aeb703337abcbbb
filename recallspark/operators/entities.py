"""Entities of a conversation: names, their statistics, groups and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import STOP_CAPITALS, TOKEN, split_sentences, speakers_of, strip_attribution
from recallspark.session import stash


def _is_name(c: Column) -> Column:
    return c.rlike(r"^[A-Z][a-z]{2,}$") & ~c.isin(STOP_CAPITALS)


def sightings(docs: DataFrame) -> DataFrame:
    """conv_id, name, seq, upper, lower: per text how often a name stands capitalised inside a sentence, and in small letters."""
    inside = F.flatten(F.transform(split_sentences(F.col("text")), lambda s: _behind_first(F.filter(F.split(s, r"\s+"), lambda x: x != ""))))
    bare = F.transform(inside, lambda w: F.regexp_replace(w, r"^[.,!?;:\"'()\[\]]+|[.,!?;:\"'()\[\]]+$", ""))
    small = F.filter(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)), lambda w: w.rlike(r"^[a-z]{3,}$"))
    both = F.concat(
        F.transform(F.filter(bare, _is_name), lambda w: F.struct(w.alias("name"), F.lit(1).alias("upper"))),
        F.transform(small, lambda w: F.struct(F.initcap(w).alias("name"), F.lit(0).alias("upper"))),
    )
    words = docs.select("conv_id", "seq", F.inline(both))
    return words.groupBy("conv_id", "name", "seq").agg(F.sum("upper").alias("upper"), F.sum(1 - F.col("upper")).alias("lower"))


def _behind_first(words: Column) -> Column:
    return F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))


def entity_stats(docs: DataFrame) -> DataFrame:
    """conv_id, name, count, lower_count (from its first sighting on), first_seq, last_seq.

    ``docs``: conv_id, seq, text. The texts are read once; words in small letters
    are dropped before the last shuffle unless a name is spelt like them.
    """
    seen = stash(sightings(docs), "sightings")
    named = seen.where("upper > 0").groupBy("conv_id", "name").agg(F.sum("upper").alias("count"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    later = seen.where("lower > 0").join(named.select("conv_id", "name", "first_seq"), ["conv_id", "name"]).where(F.col("seq") >= F.col("first_seq"))
    later = later.groupBy("conv_id", "name").agg(F.sum("lower").alias("lower_count"))
    return named.join(later, ["conv_id", "name"], "left").na.fill(0, ["lower_count"])


def proper_names(stats: DataFrame, least: int = 2, ratio: float = 0.75) -> DataFrame:
    return stats.where((F.col("count") >= least) & (F.col("count") / (F.col("count") + F.col("lower_count")) >= ratio))


def speakers(docs: DataFrame) -> DataFrame:
    return docs.select("conv_id", F.explode(speakers_of(F.col("text"))).alias("name")).distinct()


def top_entities(docs: DataFrame, n: int = 20) -> DataFrame:
    """Speakers in order of name, then proper names by count; ``n`` per conversation."""
    spoken = speakers(docs).select("conv_id", "name", F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("count"))
    named = proper_names(entity_stats(docs)).join(spoken, ["conv_id", "name"], "left_anti").select("conv_id", "name", F.lit(1).alias("tier"), "count")
    w = Window.partitionBy("conv_id").orderBy("tier", F.desc("count"), "name")
    return spoken.unionByName(named).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("conv_id", "name", "rank")


def entity_groups(docs: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """conv_id, name, episode_id: mentions in the text without attribution; groups of at least two.

    Single-word names meet the text's words in an equi-join, not by pattern scans.
    """
    words = docs.select("conv_id", "episode_id", F.explode(F.array_distinct(F.regexp_extract_all(strip_attribution(F.col("text")), F.lit(TOKEN), F.lit(1)))).alias("name"))
    members = words.join(names.select("conv_id", "name"), ["conv_id", "name"])
    large = members.groupBy("conv_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return members.join(large.select("conv_id", "name"), ["conv_id", "name"], "left_semi")


def alias_pairs(names: DataFrame, most: int = 60) -> DataFrame:
    """Pairs of a conversation's ``most`` leading names where one begins the other or is one edit away."""
    cut = names.where(F.col("rank") <= most).select("conv_id", "name")
    other = cut.withColumnRenamed("name", "other")
    pairs = cut.join(other, "conv_id").where((F.length("name") < F.length("other")) | ((F.length("name") == F.length("other")) & (F.col("name") < F.col("other"))))
    a, b = F.lower("name"), F.lower("other")
    return pairs.where((F.length("name") >= 3) & (a != b) & (b.startswith(a) | (F.levenshtein(a, b) <= 1))).select("conv_id", F.col("name").alias("short"), F.col("other").alias("long"))


def canonical_aliases(pairs: DataFrame, rounds: int = 3) -> DataFrame:
    """conv_id, name, canonical: the longest partner, chains followed ``rounds`` times."""
    w = Window.partitionBy("conv_id", "short").orderBy(F.desc(F.length("long")), "long")
    first = pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select("conv_id", F.col("short").alias("name"), F.col("long").alias("canonical"))
    out = first
    for _ in range(rounds):
        step = first.select("conv_id", F.col("name").alias("canonical"), F.col("canonical").alias("further"))
        out = out.join(step, ["conv_id", "canonical"], "left").select("conv_id", "name", F.coalesce("further", "canonical").alias("canonical"))
    return out
