"""Episodes from utterances, and the tree over an episode sequence."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import STOP_CAPITALS, TOKEN, first_sentence, normalise, token_count


WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class SegmentConfig:
    max_tokens: int = 800
    min_tokens: int = 500
    gap_s: float = 300.0
    min_overlap: float = 0.15


def cut_points(utterances: list[tuple[str, float | None, bool]], cfg: SegmentConfig) -> list[int]:
    """Segment number of each (text, seconds, has image): a fold that resets on its own output."""
    numbers, number, size, words, last = [], 0, 0, set(), None
    empty = True
    for text, at, image in utterances:
        text = text or ""
        own, size_of = set(WORD.findall(text.lower())), len(text.split())
        cut = not empty and (
            image
            or (size + size_of > cfg.max_tokens and size >= cfg.min_tokens)
            or (at is not None and last is not None and at - last > cfg.gap_s)
            or (size >= cfg.min_tokens and _overlap(words, own) < cfg.min_overlap)
        )
        if cut:
            number, size, words = number + 1, 0, set()
        numbers.append(number)
        size, last, empty = size + size_of, at, False
        words |= own
        if image:
            number, size, words, empty = number + 1, 0, set(), True
    return numbers


def _overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def segment_utterances(utterances: DataFrame, cfg: SegmentConfig = SegmentConfig()) -> DataFrame:
    """conv_id, session_id, n, segment. A session is one group: its length is bounded by a sitting.

    ``utterances``: conv_id, session_id, n (order), text, at (seconds, may be NULL), image (boolean).
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("n")
        items = [(t, None if pd.isna(a) else float(a), bool(i)) for t, a, i in zip(rows["text"], rows["at"], rows["image"])]
        return rows[["conv_id", "session_id", "n"]].assign(segment=cut_points(items, cfg))

    return utterances.groupBy("conv_id", "session_id").applyInPandas(run, "conv_id string, session_id string, n bigint, segment int")


def from_utterances(utterances: DataFrame, by: tuple[str, ...] = ("conv_id", "session_id", "segment")) -> DataFrame:
    """One episode a segment: texts joined in order, speakers in order of first appearance, earliest stamp, first image and caption.

    ``utterances``: the columns of ``by``, n, text, speaker, timestamp, dia_id, image_path, dataset_caption.
    A segment is bounded by its token ceiling.
    """
    rows = F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("speaker", F.lit("Unknown")).alias("speaker"), "timestamp", "dia_id", "image_path", "dataset_caption")))
    some = lambda c: F.filter(F.transform("u", lambda x: x[c]), lambda x: F.coalesce(x, F.lit("")) != "")
    text = F.array_join(F.transform("u", lambda x: x["text"]), " ")
    return utterances.groupBy(*by).agg(rows.alias("u")).select(
        *by, F.sha2(F.concat_ws("|", *by), 256).alias("episode_id"), text.alias("raw_text"), normalise(text).alias("normalized_text"), token_count(text).alias("token_count"),
        F.transform("u", lambda x: x["text"]).alias("episode_utterances"), F.transform("u", lambda x: x["speaker"]).alias("episode_speakers"),
        F.array_distinct(F.transform("u", lambda x: x["speaker"])).alias("speakers"), F.array_min(some("timestamp")).alias("timestamp"), some("dia_id").alias("evidence_ids"),
        F.try_element_at(some("image_path"), F.lit(1)).alias("image_path"), F.coalesce(F.try_element_at(some("dataset_caption"), F.lit(1)), F.lit("")).alias("image_caption_detailed"),
    )


def construct(texts: DataFrame, now: str) -> DataFrame:
    """Rows (conv_id, seq, text and whatever else) as episodes, with what the constructor fills in.

    The id follows from conversation and position, the clock is ``now``; evidence comes from ``dia_id`` if there is one.
    """
    have = set(texts.columns)
    given = lambda c, other: F.coalesce(F.col(c), other) if c in have else other
    own = F.when(F.col("dia_id").isNotNull(), F.array("dia_id")).otherwise(F.array().cast("array<string>")) if "dia_id" in have else F.array().cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    return texts.select(
        F.col("conv_id").cast("string").alias("conv_id"), given("episode_id", F.sha2(F.concat_ws("|", "conv_id", "seq"), 256)).alias("episode_id"), F.col("seq").alias("global_seq"),
        given("modality", F.lit("text")).alias("modality"), text.alias("raw_text"), normalise(text).alias("normalized_text"), token_count(text).alias("token_count"),
        given("timestamp", F.lit(now)).alias("timestamp"), given("evidence_ids", own).alias("evidence_ids"), given("session_id", F.lit(None).cast("string")).alias("session_id"),
    )


def sequence_tree(docs: DataFrame, leaf: int = 6, fan_out: int = 4) -> DataFrame:
    """Nodes (conv_id, level, node, parent, first_seq, last_seq, episodes) of a balanced tree over the sequence.

    Leaves hold ``leaf`` consecutive episodes, regions ``fan_out`` children; each level
    is made from the one below, until every conversation has one root. For overviews of
    whole collections; ``tree`` has the tree that grows by insertion.
    """
    top = docs.groupBy("conv_id").agg(F.max("seq").alias("top"))
    level = docs.groupBy("conv_id", F.floor(F.col("seq") / leaf).alias("node")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("episodes")).join(top, "conv_id")
    most = docs.agg(F.max("seq")).first()[0]
    columns = ["conv_id", "node", "first_seq", "last_seq", "episodes"]
    out, n, size = [], 0, leaf
    while most is not None:
        # the root, at which a conversation ends, has no parent
        out.append(level.select(*columns, F.lit(n).alias("level"), F.when(F.col("top") >= size, F.floor(F.col("node") / fan_out)).alias("parent")))
        if most < size:
            break
        up = level.where(F.col("top") >= size).groupBy("conv_id", F.floor(F.col("node") / fan_out).alias("node"))
        level = up.agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("episodes").alias("episodes"), F.max("top").alias("top"))
        n, size = n + 1, size * fan_out
    if not out:
        out = [level.select(*columns, F.lit(0).alias("level"), F.col("node").alias("parent"))]
    return reduce(DataFrame.unionByName, out)


def region_summaries(docs: DataFrame, size: int = 6, anchors: int = 8, names: int = 5) -> DataFrame:
    """What an overview says of every ``size`` consecutive episodes: conv_id, node, anchors, summary, entities, spans, images.

    Anchors are the most frequent words of five letters or more (ties by the word), the
    summary is the first sentence, entities the first capitalised words. ``docs``:
    conv_id, seq, text, stamp, image (boolean).
    """
    by = ["conv_id", "node"]
    rows = docs.withColumn("node", F.floor(F.col("seq") / size))
    words = rows.select(*by, "seq", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1))).alias("at", "w"))
    counts = words.where(F.col("w").rlike("^[a-zA-Z]{5,}$")).groupBy(*by, F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "w"))).where(F.col("r") <= anchors)
    top = top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("anchors"))
    capital = words.where(F.col("w").rlike("^[A-Z][a-z]{2,}$") & ~F.col("w").isin(STOP_CAPITALS)).groupBy(*by, "w").agg(F.min(F.struct("seq", "at")).alias("first"))
    capital = capital.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("first"))).where(F.col("r") <= names)
    capital = capital.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("entities"))
    some = F.trim(F.coalesce("text", F.lit(""))) != ""
    spans = rows.groupBy(*by).agg(
        first_sentence(F.trim(F.min_by("text", F.when(some, F.col("seq"))))).alias("summary"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min("stamp").alias("first_at"), F.max("stamp").alias("last_at"), F.sum(F.col("image").cast("bigint")).alias("images"),
    )
    none = F.array().cast("array<string>")
    return spans.join(top, by, "left").join(capital, by, "left").withColumns({"anchors": F.coalesce("anchors", none), "entities": F.coalesce("entities", none)})
