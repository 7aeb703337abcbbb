"""The retrieval plan: all questions of all conversations in one job.

plan -> search (scan, fusion, boosts, captions) -> pool with notes -> expansion ->
rerank -> z-score by kind -> pack -> neighbours -> evidence, confidence, answer.

Everything asked of the memory is read from a layer built once (``build_layer``) or
loaded from storage: texts, vectors, postings, corpus statistics. Vectors and texts
are joined late; ranking stages carry ids and scores only. Lists per question are
bounded by the configuration, so they are what windows sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import fuzzy_overlap, stem, tokens
from recallspark.models import Encoder, HashEncoder, LanguageModel, ExtractiveReader, OverlapReranker, Reranker, encode_column
from recallspark.operators import context as C
from recallspark.operators import ranking as R
from recallspark.operators.entities import speakers
from recallspark.operators.fusion import candidates, dense, dense_of, fuse, hybrid_search, scan_lists
from recallspark.operators.lexical import fuzzy_top, lexical_index, term_stats, top_k
from recallspark.operators.views import with_seq
from recallspark.session import stash


@dataclass
class RetrievalConfig:
    """The published configuration."""

    scan_top_k: int = 60
    top_k: int = 10
    measure_depth: int = 50
    rerank_pool: int = 80
    pool_strategy: str = "roundrobin"  # or "score"
    lexical_scorer: str = "bm25"  # or "fuzzy"
    alpha: float = 0.7
    fusion: str = "convex"
    rrf_k: int = 60
    note_top_k: int = 10
    note_mode: str = "compete"  # "additive", "route"
    note_slots: int = 0
    note_additive_max: int = 5
    expand_summaries: int = 5
    prf_docs: int = 2
    prf_terms: int = 12
    prf_term_order: str = "lexicographic"
    context_window: int = 1
    rerank: bool = True
    rerank_normalise: bool = True
    multimodal: bool = False
    caption_weight: float = 0.4
    image_caption_top_k: int = 5
    boosts: dict[str, float] = field(default_factory=lambda: dict(C.BOOSTS))
    encoder: Encoder = field(default_factory=HashEncoder)
    reranker: Reranker = field(default_factory=OverlapReranker)
    reader: LanguageModel = field(default_factory=ExtractiveReader)


@dataclass
class Layer:
    """What the plan reads: frames that are stored, or that are cheap to read again."""

    episodes: DataFrame  # conv_id, episode_id, text, embedding, seq, session, stamp, speakers, caption, has_image, evidence_ids
    notes: DataFrame  # conv_id, note_id, text (rendered), found (what is searched), embedding, provenance
    index: tuple[DataFrame, DataFrame]
    note_index: tuple[DataFrame, DataFrame]
    names: DataFrame  # conv_id, name of speakers


def build_layer(episodes: DataFrame, notes: DataFrame, cfg: RetrievalConfig, stored_vectors: bool = False) -> Layer:
    """A layer from episodes (conv_id, episode_id, text, more) and notes (conv_id, note_id, text, provenance, more).

    Columns that are missing are filled: vectors by the encoder (unless
    ``stored_vectors``, which takes those of the column ``embedding``), places by id.
    """

    def fill(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
        return df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in defaults.items() if c not in df.columns])

    e = fill(episodes, {"session": "string", "stamp": "string", "speakers": "array<string>", "caption": "string", "evidence_ids": "array<string>"})
    e = e.withColumn("session", F.coalesce("session", F.lit("")))
    e = e if "seq" in e.columns else with_seq(e)
    n = fill(notes, {"provenance": "array<string>", "evidence_ids": "array<string>"})
    n = n if "found" in n.columns else n.withColumn("found", F.col("text"))
    columns = ["conv_id", "episode_id", "text", "seq", "session", "stamp", "speakers", "caption", "evidence_ids"]
    if stored_vectors:
        e, n = e.select(*columns, "embedding"), n.select("conv_id", "note_id", "text", "found", "provenance", "evidence_ids", "embedding")
    else:
        e = encode_column(e.select(*columns), "text", cfg.encoder)
        n = encode_column(n.select("conv_id", "note_id", "text", "found", "provenance", "evidence_ids"), "found", cfg.encoder)
    e, n = stash(e, "episodes"), stash(n, "notes")
    index = tuple(stash(part, "index") for part in lexical_index(e))
    note_index = tuple(stash(part, "index") for part in lexical_index(n, key="note_id", text="found"))
    spoken = e.select("conv_id", F.explode("speakers").alias("name")).where(F.col("name").isNotNull()).unionByName(speakers(e.select("conv_id", "text"))).distinct()
    return Layer(e, n, index, note_index, stash(spoken, "names"))


def search(queries: DataFrame, layer: Layer, cfg: RetrievalConfig) -> DataFrame:
    """qid, id, score: candidates of each query (qid, conv_id, terms, semantic, keywords), fused, boosted, with captions.

    As many as the two scans hold between them; a list that is united from both sides keeps true scores.
    """
    dim = cfg.encoder.dim
    q = stash(encode_column(queries.select("qid", "conv_id", "terms", "semantic", "keywords"), "semantic", cfg.encoder, "vector"), "asked")
    e = layer.episodes
    if cfg.lexical_scorer == "bm25":
        pool = candidates(q, e, cfg.scan_top_k, dim, index=layer.index)
    elif cfg.lexical_scorer == "fuzzy":
        pool = fuzzy_candidates(q, e, cfg)
    else:
        raise ValueError(f"unknown lexical scorer {cfg.lexical_scorer!r}")
    found = stash(fuse(pool, cfg.fusion, cfg.alpha, cfg.rrf_k).select("qid", "conv_id", "episode_id", "score"), "fused")
    both = q.select("qid", "conv_id", F.concat_ws(" ", "terms", "semantic").alias("terms"))
    meta = C.boosts(found, C.constraints(both, layer.names), e, cfg.boosts)
    scored = found.join(meta, ["qid", "episode_id"], "left").select("qid", "conv_id", "episode_id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"))
    if cfg.multimodal:
        scored = with_captions(scored, q, e, cfg)
    return scored.select("qid", F.col("episode_id").alias("id"), F.round("score", 9).alias("score"))


def fuzzy_candidates(q: DataFrame, e: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """As ``candidates`` with the token overlap in the place of BM25."""
    kind = dict(q.dtypes)["qid"]
    words = F.array_distinct(tokens(F.col("terms")))
    asked = q.select(F.col("qid").cast("string").alias("qid"), "conv_id", F.transform(words, stem).alias("want"))
    have = e.select("conv_id", "episode_id", F.array_distinct(F.transform(F.array_distinct(tokens(F.col("text"))), stem)).alias("have"))
    top = fuzzy_top(asked, have, cfg.scan_top_k).where("overlap > 0").join(e.select("conv_id", "episode_id"), "episode_id")
    top = top.select(F.col("qid").cast(kind).alias("qid"), "conv_id", "episode_id", F.col("overlap").alias("lex"))
    ids = ["qid", "conv_id", "episode_id"]
    both = stash(scan_lists(top, dense(q, e, cfg.encoder.dim), cfg.scan_top_k), "union")
    sem = dense_of(both, q, e, cfg.encoder.dim).select(*ids, F.round("sem", 9).alias("sem")).where("sem > 0")
    rows = both.join(q.select("qid", words.alias("_q")), "qid").join(e.select("episode_id", tokens(F.col("text")).alias("_d")), "episode_id").join(sem, ids, "left")
    return rows.select(*ids, F.round(fuzzy_overlap(F.col("_q"), F.col("_d")), 9).alias("lex"), F.coalesce("sem", F.lit(0.0)).alias("sem"), "lex_rank", "sem_rank")


def with_captions(scored: DataFrame, q: DataFrame, e: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """Scores with the boost of image captions, and the caption index's own hits folded in."""
    kind = dict(scored.dtypes)["qid"]
    images = encode_column(e.where(F.trim(F.coalesce("caption", F.lit(""))) != "").select("conv_id", "episode_id", "caption"), "caption", cfg.encoder, "caption_vector")
    images = stash(images, "captions")
    asked = encode_column(q.select("qid", "conv_id", "terms", "keywords"), "keywords", cfg.encoder, "keyword_vector")
    extra = C.caption_boosts(scored, asked, images, cfg.caption_weight, cfg.encoder.dim)
    scored = scored.join(extra, ["qid", "episode_id"], "left").select("qid", "episode_id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"))
    words = F.when(F.trim(F.coalesce("keywords", F.lit(""))) != "", F.col("keywords")).otherwise(F.col("terms"))
    hits = C.caption_hits(q.select("qid", "conv_id", words.alias("terms")), C.caption_index(images), cfg.image_caption_top_k)
    return C.fold_captions(scored, hits.withColumn("qid", F.col("qid").cast(kind)))


def rank_pool(questions: DataFrame, layer: Layer, cfg: RetrievalConfig, steps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pool (qid, kind, id, score, rank), and the expansions (qid, kind, id, score) beside it.

    ``questions``: qid, conv_id, terms; ``steps`` (qid, step, terms, question) has the
    sub-queries of a plan, by default the question itself.
    """
    asked = questions.select("qid", "conv_id", "terms", C.caption_keywords(F.col("terms")).alias("keywords"))
    own = asked.select("qid", F.lit(1).alias("step"), "terms", F.col("terms").alias("question")) if steps is None else steps
    several = own.join(asked.select("qid", "conv_id", "keywords"), "qid").select(
        F.struct("qid", "step").alias("at"), "conv_id", F.col("terms"), F.coalesce("question", "terms").alias("semantic"), "keywords"
    )
    keyed = several.withColumn("qid", F.concat_ws("|", F.col("at.qid").cast("string"), F.col("at.step").cast("string")))
    back = keyed.select("qid", F.col("at.qid").alias("question"), F.col("at.step").alias("list_no"))
    found = search(keyed, layer, cfg).join(back, "qid").select(F.col("question").alias("qid"), "list_no", F.lit("episode").alias("kind"), "id", "score")
    found = stash(found, "found")
    vectors = encode_column(asked.select("qid", "conv_id", "terms"), "terms", cfg.encoder, "vector")
    known = hybrid_search(vectors, layer.notes, cfg.scan_top_k, cfg.note_top_k, "convex", cfg.alpha, cfg.encoder.dim, "note_id", layer.note_index)
    known = stash(known.select("qid", F.lit(1 << 20).alias("list_no"), F.lit("note").alias("kind"), F.col("note_id").alias("id"), "score"), "notes")
    lists = found if cfg.note_mode == "route" else found.unionByName(known)
    limit = max(cfg.top_k, cfg.measure_depth)
    pooled = R.pool_by_score(lists, limit) if cfg.pool_strategy == "score" else R.pool_round_robin(lists, limit)
    best = lists.groupBy("qid", "id").agg(F.max("score").alias("score"), F.any_value("kind").alias("kind"))
    pool = stash(pooled.select("qid", "id", "rank").join(best, ["qid", "id"]).select("qid", "kind", "id", "score", "rank"), "pool")
    seen, extra = pool.select("qid", "id"), []
    if cfg.expand_summaries:
        hits = top_k(known, "score", cfg.expand_summaries, ["id"]).select("qid", F.col("id").alias("note_id"), "score", "rank")
        rows = hits.join(layer.notes.select("note_id", "provenance"), "note_id").select("qid", "score", "rank", F.posexplode("provenance").alias("pos", "id"))
        rows = rows.join(layer.episodes.select(F.col("episode_id").alias("id")), "id", "left_semi").join(seen, ["qid", "id"], "left_anti")
        first = rows.groupBy("qid", "id").agg(F.min_by("score", F.struct("rank", "pos")).alias("score"))
        extra.append(stash(first.select("qid", "id", (F.col("score") * 0.5).alias("score")), "expansion"))
        seen = seen.unionByName(extra[-1].select("qid", "id"))
    if cfg.prf_docs:
        w = Window.partitionBy("qid").orderBy("rank")
        head = pool.where(F.col("kind") == "episode").withColumn("n", F.row_number().over(w)).where(F.col("n") <= cfg.prf_docs)
        stats = term_stats(*layer.index) if cfg.prf_term_order == "idf" else None
        terms = R.feedback_terms(head.join(layer.episodes.select(F.col("episode_id").alias("id"), "conv_id", "text"), "id").select("qid", "conv_id", "text"), cfg.prf_terms, cfg.prf_term_order, stats)
        again = asked.select("qid", "conv_id").join(terms, "qid").where(F.trim("terms") != "").select("qid", "conv_id", "terms", F.col("terms").alias("semantic"), F.lit("").alias("keywords"))
        hits = search(again, layer, cfg).join(seen, ["qid", "id"], "left_anti")
        extra.append(stash(hits.select("qid", "id", (F.col("score") * 0.5).alias("score")), "feedback"))
    expansion = pool.where("1 = 0").select("qid", "kind", "id", "score")
    for rows in extra:
        expansion = expansion.unionByName(rows.select("qid", F.lit("episode").alias("kind"), "id", "score"))
    return pool, expansion


def rerank(pool: DataFrame, expansion: DataFrame, questions: DataFrame, texts: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """qid, kind, id, score, rerank: the order of the pack, best score first.

    The first ``rerank_pool`` of the pool and all expansions are scored against the
    question and standardised by kind; what is left of the pool follows behind. Where
    the reranker fails, a question keeps its pool in its order, without expansions;
    with reranking off, expansions follow behind the pool.
    """
    plain = pool.select("qid", "kind", "id", (-F.col("rank")).cast("double").alias("score"), F.lit(None).cast("double").alias("rerank"))
    if not cfg.rerank:
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        behind = expansion.select("qid", "kind", "id", (-1e6 - F.row_number().over(w)).cast("double").alias("score"), F.lit(None).cast("double").alias("rerank"))
        return plain.unionByName(behind)
    head = pool.where(F.col("rank") <= cfg.rerank_pool).select("qid", "kind", "id").unionByName(expansion.select("qid", "kind", "id"))
    rows = head.join(texts, "id").join(questions.select("qid", "terms"), "qid").select("qid", "kind", "id", "terms", "text")
    kind = dict(rows.dtypes)["qid"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = pd.Series(float("nan"), index=frame.index)
            for terms, part in frame.groupby("terms"):
                found = cfg.reranker.score(terms, part["text"].tolist())
                scores[part.index] = found if found is not None else float("nan")
            yield frame[["qid", "kind", "id"]].assign(score=scores)

    scored = stash(rows.mapInPandas(run, f"qid {kind}, kind string, id string, score double"), "scored")
    failed = scored.where(F.col("score").isNull() | F.isnan("score")).select("qid").distinct()
    fine = scored.join(failed, "qid", "left_anti").withColumn("rerank", F.round("score", 4))
    order = R.zscore_by_kind(fine).select("qid", "kind", "id", F.round("z" if cfg.rerank_normalise else "rerank", 9).alias("score"), "rerank")
    tail = plain.join(failed, "qid", "left_semi").unionByName(
        plain.join(failed, "qid", "left_anti").join(fine.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("score", F.col("score") - 1e6)
    )
    return order.unionByName(tail)


def retrieve(questions: DataFrame, episodes: DataFrame | None, notes: DataFrame | None, cfg: RetrievalConfig | None = None, layer: Layer | None = None, steps: DataFrame | None = None) -> DataFrame:
    """The pack of every question with its neighbours: qid, kind, id, place, seq, rerank.

    ``place`` is the rank; the reader takes episodes in the order of ``seq``. Episodes
    within ``context_window`` places of a packed one, in its session, come as kind
    ``neighbour`` behind the pack. Without a ``layer`` one is built from ``episodes`` and ``notes``.
    """
    cfg = cfg or RetrievalConfig()
    layer = layer or build_layer(episodes, notes, cfg)
    pool, expansion = rank_pool(questions, layer, cfg, steps)
    texts = layer.episodes.select(F.col("episode_id").alias("id"), "text").unionByName(layer.notes.select(F.col("note_id").alias("id"), "text"))
    ranked = rerank(pool, expansion, questions, texts, cfg)
    if cfg.note_mode == "additive":
        packed = R.pack_additive(ranked, cfg.top_k, cfg.note_additive_max)
    elif cfg.note_slots > 0:
        packed = R.pack_slots(ranked, cfg.top_k, cfg.note_slots)
    else:
        packed = R.pack_compete(ranked, cfg.top_k)
    places = layer.episodes.select(F.col("episode_id").alias("id"), "conv_id", "seq", "session")
    packs = stash(packed.select("qid", "kind", "id", "place", "rerank").join(places.select("id", "seq"), "id", "left"), "packs").select("qid", "kind", "id", "place", "seq", "rerank")
    if not cfg.context_window:
        return packs
    asked = packs.where(F.col("kind") == "episode").select("qid", "id").join(places, "id")
    fresh = R.neighbours(asked, places, cfg.context_window).join(packs.select("qid", "id"), ["qid", "id"], "left_anti")
    last = packs.groupBy("qid").agg(F.max("place").alias("last"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("seq", "id"))
    behind = fresh.join(last, "qid").select("qid", F.lit("neighbour").alias("kind"), "id", (F.col("last") + order).alias("place"), "seq", F.lit(None).cast("double").alias("rerank"))
    return packs.unionByName(behind)


def confidence(packs: DataFrame) -> DataFrame:
    """qid, rr_top, rr_margin: the best rerank score of the pack, and how far it lies above its mean."""
    found = packs.where(F.col("rerank").isNotNull()).groupBy("qid").agg(F.max("rerank").alias("top"), F.avg("rerank").alias("mean"))
    return found.select("qid", F.round("top", 4).alias("rr_top"), F.round(F.col("top") - F.col("mean"), 4).alias("rr_margin"))


def evidence(packs: DataFrame, layer: Layer) -> DataFrame:
    """qid, retrieved (evidence ids of the packed episodes, in pack order), from_notes (those of the notes)."""
    have = layer.episodes.select(F.col("episode_id").alias("id"), "evidence_ids").unionByName(layer.notes.select(F.col("note_id").alias("id"), "evidence_ids"))
    rows = packs.where(F.col("kind") != "neighbour").join(have, "id")
    one = C.ordered_evidence(rows.where(F.col("kind") == "episode")).withColumnRenamed("evidence", "retrieved")
    two = C.ordered_evidence(rows.where(F.col("kind") == "note")).withColumnRenamed("evidence", "from_notes")
    return one.join(two, "qid", "full")


def answer(packs: DataFrame, questions: DataFrame, texts: DataFrame, cfg: RetrievalConfig | None = None) -> DataFrame:
    """One bare reader call per question: qid, answer. ``plans.reader`` has the full prompts."""
    cfg = cfg or RetrievalConfig()
    lines = packs.join(texts, "id").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("pack"))
    rows = questions.select("qid", "terms").join(lines, "qid", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [cfg.reader.complete(f"{q}\n{p or ''}") for q, p in zip(frame["terms"], frame["pack"])]
            yield frame[["qid"]].assign(answer=said)

    return rows.mapInPandas(run, "qid bigint, answer string")
