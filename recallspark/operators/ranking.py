"""Pools, packs, normalised heads, feedback expansion and context windows.

Candidates are rows (qid, kind, id, score); every operator breaks ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import tokens


def pool_by_score(lists: DataFrame, limit: int) -> DataFrame:
    """Best score per id, then the ``limit`` best ids."""
    best = lists.groupBy("qid", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def pool_round_robin(lists: DataFrame, limit: int) -> DataFrame:
    """Ranked lists (qid, list_no, id, score) taken in turn, each id once, up to ``limit``.

    No pool reaches below depth ``limit`` of a list, so lists are cut there first.
    """
    depth = Window.partitionBy("qid", "list_no").orderBy(F.desc("score"), "id")
    one = lists.groupBy("qid", "list_no", "id").agg(F.max("score").alias("score"))
    cut = one.withColumn("depth", F.row_number().over(depth)).where(F.col("depth") <= limit)
    first = cut.groupBy("qid", "id").agg(F.min(F.struct("depth", "list_no")).alias("at"))
    turn = Window.partitionBy("qid").orderBy("at", "id")
    return first.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= limit).select("qid", "id", "rank")


def zscore_by_kind(head: DataFrame, least: int = 3) -> DataFrame:
    """Scores standardised within query and kind; small groups keep theirs."""
    w = Window.partitionBy("qid", "kind")
    score = F.round("score", 4)
    deviation = F.stddev_pop(score).over(w)
    z = (score - F.avg(score).over(w)) / F.when(deviation < 1e-12, 1.0).otherwise(deviation)
    return head.withColumn("z", F.when(F.count("*").over(w) >= least, z).otherwise(score))


def _rank(by: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def pack_compete(ranked: DataFrame, k: int) -> DataFrame:
    """The k best, whatever their kind."""
    return ranked.withColumn("place", _rank(["qid"], [F.desc("score"), "id"])).where(F.col("place") <= k)


def pack_additive(ranked: DataFrame, k: int, notes: int = 5) -> DataFrame:
    """The k best episodes and, behind them, the first notes."""
    rows = ranked.withColumn("n", _rank(["qid", "kind"], [F.desc("score"), "id"]))
    kept = rows.where(((F.col("kind") != "note") & (F.col("n") <= k)) | ((F.col("kind") == "note") & (F.col("n") <= notes)))
    return kept.withColumn("place", _rank(["qid"], [(F.col("kind") == "note"), "n", "id"])).drop("n")


def pack_slots(ranked: DataFrame, k: int, slots: int) -> DataFrame:
    """``slots`` places for the best notes, the rest by rank."""
    rows = ranked.withColumn("n", _rank(["qid", "kind"], [F.desc("score"), "id"]))
    rows = rows.withColumn("kept", (F.col("kind") == "note") & (F.col("n") <= slots))
    return rows.withColumn("place", _rank(["qid"], [F.desc("kept"), F.desc("score"), "id"])).where(F.col("place") <= k).drop("n", "kept")


def feedback_terms(top: DataFrame, terms: int = 12, order: str = "lexicographic", stats: DataFrame | None = None) -> DataFrame:
    """Expansion terms from feedback texts (qid, text): tokens over three letters, the first by order.

    ``order``: ``lexicographic``, or ``idf`` for the rarest first; that needs ``stats``
    (conv_id, term, idf) and the texts' ``conv_id``.
    """
    if order not in ("lexicographic", "idf") or (order == "idf" and stats is None):
        raise ValueError("the order is lexicographic, or idf with term statistics")
    keys = ["qid", "conv_id"] if order == "idf" else ["qid"]
    words = top.select(*keys, F.explode(tokens(F.col("text"))).alias("term")).where(F.length("term") > 3).distinct()
    if order == "idf":
        words = words.join(stats.select("conv_id", "term", "idf"), ["conv_id", "term"], "left")
    w = Window.partitionBy("qid").orderBy(*([F.desc(F.coalesce("idf", F.lit(0.0)))] if order == "idf" else []), "term")
    first = words.withColumn("n", F.row_number().over(w)).where(F.col("n") <= terms)
    return first.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), " ").alias("terms"))


def neighbours(pack: DataFrame, docs: DataFrame, width: int = 1) -> DataFrame:
    """The documents within ``width`` places of a packed one, in the same session.

    The band join is an equi-join: each packed row asks for its 2 * width + 1 places.
    ``pack``: qid, conv_id, seq, session; ``docs``: conv_id, seq, session, id.
    """
    asked = pack.select("qid", "conv_id", "session", F.explode(F.sequence(F.col("seq") - width, F.col("seq") + width)).alias("seq"))
    return asked.join(docs, ["conv_id", "session", "seq"]).select("qid", "conv_id", "id", "seq").distinct()
