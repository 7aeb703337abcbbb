"""What a question says about people and dates, and the boosts episodes get for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import stem, tokens
from recallspark.functions.vectors import cosine, usable
from recallspark.operators.lexical import fuzzy_top

#: Month names and abbreviations that count as a month, the modal "may" included.
MONTH_NAMES = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split()
#: What a boost adds.
BOOSTS = {"speaker": 0.10, "year": 0.05, "month": 0.08}


def years_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)))


def months_in(text: Column) -> Column:
    """Numbers of the months named."""
    names = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b({'|'.join(MONTH_NAMES)})\b"), F.lit(1))
    place = lambda m: ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(m, 1, 3)) + 2) / 3).cast("int")
    return F.array_distinct(F.transform(names, place))


def dashed_months(stamp: Column) -> Column:
    """Numbers of the months in ``-mm-``."""
    found = F.transform(F.regexp_extract_all(stamp, F.lit(r"-0?(\d{1,2})-"), F.lit(1)), lambda x: x.cast("int"))
    return F.filter(found, lambda n: (n >= 1) & (n <= 12))


def constraints(questions: DataFrame, names: DataFrame, text: str = "terms") -> DataFrame:
    """qid, conv_id, speakers (lower case), years, months that a question names.

    ``names``: conv_id, name of the conversation's speakers; those of three letters or
    more count where they stand as a word of the question.
    """
    q = questions.select("qid", "conv_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    words = q.select("qid", "conv_id", F.explode(F.array_distinct(F.concat(tokens(F.col("_t")), F.regexp_extract_all(F.lower("_t"), F.lit(r"([\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)+)"), F.lit(1))))).alias("word"))
    known = names.where(F.length("name") > 2).select("conv_id", F.lower("name").alias("word")).distinct()
    said = words.join(known, ["conv_id", "word"]).groupBy("qid").agg(F.array_sort(F.collect_set("word")).alias("speakers"))
    return q.select("qid", "conv_id", years_in(F.col("_t")).alias("years"), months_in(F.col("_t")).alias("months")).join(said, "qid", "left")


def boosts(pairs: DataFrame, wanted: DataFrame, episodes: DataFrame, weights: dict[str, float] = BOOSTS, key: str = "episode_id") -> DataFrame:
    """qid, key, boost of the pairs (qid, key) that get one.

    ``episodes``: conv_id, key, text, stamp and ``speakers`` (array). Year and month are
    looked for in the stamp and the first 80 characters; a speaker among the
    episode's speakers or as "speaker NAME" anywhere in it.
    """
    head = F.concat_ws(" ", F.coalesce("stamp", F.lit("None")), F.substring("text", 1, 80))
    e = episodes.select(
        key, F.lower("text").alias("_low"), F.transform(F.coalesce("speakers", F.array().cast("array<string>")), F.lower).alias("_who"),
        years_in(head).alias("_years"), F.array_distinct(F.concat(months_in(head), F.coalesce(dashed_months(F.col("stamp")), F.array().cast("array<int>")))).alias("_months"),
    )
    some = F.size("speakers") + F.size("years") + F.size("months") > 0
    asked = wanted.withColumn("speakers", F.coalesce("speakers", F.array().cast("array<string>"))).where(some).select("qid", "speakers", "years", "months")
    rows = pairs.select("qid", key).join(asked, "qid").join(e, key)
    spoken = F.exists("speakers", lambda s: F.array_contains(F.col("_who"), s) | F.contains(F.col("_low"), F.concat(F.lit("speaker "), s)))
    part = lambda hit, name: F.coalesce(hit, F.lit(False)).cast("int") * F.lit(weights[name])
    boost = part(spoken, "speaker") + part(F.arrays_overlap("years", "_years"), "year") + part(F.arrays_overlap("months", "_months"), "month")
    return rows.select("qid", key, F.round(boost.cast("double"), 3).alias("boost")).where("boost > 0")


def caption_keywords(query: Column) -> Column:
    """What stands in the brackets of an image description inside the query; empty without one."""
    return F.trim(F.regexp_extract(F.coalesce(query, F.lit("")), r"(?i)\[(?:Image description|Question image|Image caption):\s*([^\]]+)\]", 1))


def caption_boosts(pairs: DataFrame, queries: DataFrame, episodes: DataFrame, weight: float = 0.4, dim: int = 96, key: str = "episode_id") -> DataFrame:
    """qid, key, boost: the larger of word share and cosine with an image's caption, weighted.

    ``queries``: qid, terms, keywords (may be empty: then the terms count) and, for the
    cosine, ``keyword_vector``; ``episodes``: key, caption and ``caption_vector``. Words
    of three letters or more count.
    """
    long = lambda c: F.filter(F.array_distinct(tokens(c)), lambda t: F.length(t) > 2)
    want = F.when(F.size(F.array_distinct(tokens(F.col("keywords")))) > 0, long(F.col("keywords"))).otherwise(long(F.col("terms")))
    q = queries.select("qid", want.alias("_want"), *[c for c in ("keyword_vector",) if c in queries.columns])
    e = episodes.where(F.trim(F.coalesce("caption", F.lit(""))) != "").select(key, F.array_distinct(tokens(F.col("caption"))).alias("_have"), *[c for c in ("caption_vector",) if c in episodes.columns])
    rows = pairs.select("qid", key).join(q, "qid").join(e, key)
    share = F.when(F.size("_want") > 0, F.size(F.array_intersect("_want", "_have")) / F.size("_want")).otherwise(F.lit(0.0))
    near = F.lit(0.0)
    if "keyword_vector" in q.columns and "caption_vector" in e.columns:
        fine = usable(F.col("keyword_vector"), dim) & usable(F.col("caption_vector"), dim)
        near = F.when(fine, F.greatest(F.lit(0.0), cosine(F.col("keyword_vector"), F.col("caption_vector")))).otherwise(F.lit(0.0))
    return rows.select("qid", key, F.round(F.greatest(share, near) * weight, 9).alias("boost")).where("boost > 0")


def caption_index(episodes: DataFrame, key: str = "episode_id") -> DataFrame:
    """conv_id, key, have: stems of every caption that is not blank."""
    have = F.array_distinct(F.transform(F.array_distinct(tokens(F.col("caption"))), stem))
    return episodes.where(F.trim(F.coalesce("caption", F.lit(""))) != "").select("conv_id", F.col(key).alias("episode_id"), have.alias("have"))


def caption_hits(queries: DataFrame, captions: DataFrame, k: int = 5) -> DataFrame:
    """qid, episode_id, overlap: the ``k`` best captions with a word of the query. ``queries``: qid, conv_id, terms."""
    want = F.transform(F.array_distinct(tokens(F.col("terms"))), stem)
    q = queries.select(F.col("qid").cast("string").alias("qid"), "conv_id", want.alias("want"))
    return fuzzy_top(q, captions, k).where("overlap > 0").select("qid", "episode_id", "overlap")


def fold_captions(merged: DataFrame, hits: DataFrame, share: float = 0.3) -> DataFrame:
    """Scores (qid, episode_id, score) with caption hits worked in: a row that is there gains ``share`` of the hit, others are added with it."""
    h = hits.select("qid", "episode_id", "overlap")
    both = merged.select("qid", "episode_id", "score").join(h, ["qid", "episode_id"], "full")
    score = F.when(F.col("overlap").isNull(), F.col("score")).when(F.col("score").isNull(), F.round("overlap", 4)).otherwise(F.round(F.col("score") + F.col("overlap") * share, 4))
    return both.select("qid", "episode_id", score.alias("score"))


def ordered_evidence(rows: DataFrame, by: str = "qid", order: str = "place") -> DataFrame:
    """``by``, evidence: the ids of the rows' evidence in their order, each once. A pack is bounded."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("e")))), lambda x: x["e"])
    return rows.groupBy(by).agg(F.array_distinct(F.flatten(lists)).alias("evidence"))


def sampled_questions(questions: DataFrame, most: int, seed: int = 0, by: str = "conv_id") -> DataFrame:
    """At most ``most`` questions a conversation, drawn by the hash of their id, in their own order."""
    w = Window.partitionBy(by).orderBy(F.xxhash64("qid", F.lit(seed)), "qid")
    return questions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
