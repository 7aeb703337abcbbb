"""Queries of the whole engine: retrieval, streaming, trees, groups, JSON, dates in text."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from recallspark.functions.dates import epoch_seconds, parse_session_date
from recallspark.functions.jsonx import first_json_object, salvaged_json
from recallspark.functions.phrases import HINT, HINT_QUESTION, annotate_dates, resolve_question
from recallspark.functions.vectors import unit, usable
from recallspark.models import ExtractiveReader, HashEncoder, Scripted, encode_column
from recallspark.operators import entities as N
from recallspark.operators import episodes as E
from recallspark.operators import group_methods as M
from recallspark.operators import grouping as G
from recallspark.operators import notes as O
from recallspark.operators import segmentation as S
from recallspark.operators import views as V
from recallspark.operators.memory_queries import SQL as MEMORY_SQL
from recallspark.operators.memory_queries import mutual_knn_edges
from recallspark.plans import reader as A
from recallspark.plans.consolidate import ConsolidationConfig, consolidate
from recallspark.plans.judge import judge
from recallspark.plans.planner import plan
from recallspark.plans.retrieve import RetrievalConfig, build_layer, confidence, evidence, retrieve
from recallspark.plans.summaries import summarise_groups
from recallspark.session import run_folder, stash, table
from recallspark.streaming import ingest as I


def _pipeline(spark, d):
    q = V.questions(spark, d).where(F.col("pq_id") % 100 == 0).select(F.col("pq_id").alias("qid"), F.col("sample").alias("conv_id"), F.col("question").alias("terms"))
    e = V.episodes(spark, d, "session_id", "session_datetime", "ts_raw", "episode_speakers", "caption_concise", "evidence_ids")
    e = e.select("conv_id", "episode_id", "text", F.coalesce("session_id", "session_datetime").alias("session"), F.coalesce("ts_raw", "session_datetime").alias("stamp"), F.col("episode_speakers").alias("speakers"), F.col("caption_concise").alias("caption"), "evidence_ids")
    n = V.notes(spark, d, "provenance", "evidence_ids", "status", "event_time", "recorded_time", "valid_until")
    n = n.select("conv_id", "note_id", O.render().alias("text"), F.concat_ws(" ", "subject", "attribute", "statement").alias("found"), "provenance", "evidence_ids")
    return q, e, n


def _packs(spark, d, cfg=None):
    q, e, n = _pipeline(spark, d)
    cfg = cfg or RetrievalConfig()
    layer = build_layer(e, n, cfg)
    return q, layer, stash(retrieve(q, None, None, cfg, layer), "packs")


def retrieve_packs(spark, d):
    """The packs of the stated questions, by the published configuration and offline models."""
    return _packs(spark, d)[2].select("qid", "kind", "id", "place", "seq", F.round("rerank", 4).alias("rerank"))


def retrieve_fuzzy(spark, d):
    """Packs with token overlap for BM25, captions, reserved places for notes, score pools."""
    cfg = RetrievalConfig(lexical_scorer="fuzzy", multimodal=True, note_slots=2, pool_strategy="score", prf_docs=0)
    return _packs(spark, d, cfg)[2].select("qid", "kind", "id", "place")


def pack_evidence(spark, d):
    """Evidence and confidence of the packs."""
    _, layer, packs = _packs(spark, d)
    found = evidence(packs, layer).join(confidence(packs), "qid", "left")
    return found.select("qid", F.array_join("retrieved", " ").alias("retrieved"), F.array_join("from_notes", " ").alias("from_notes"), "rr_top", "rr_margin")


def answers(spark, d):
    """Answers of the offline reader to the full prompts."""
    q, layer, packs = _packs(spark, d)
    e = layer.episodes.select(F.col("episode_id").alias("id"), "text", "stamp")
    rows = packs.where(F.col("kind") != "note").select("qid", "id", "seq", (F.col("kind") == "episode").alias("ranked")).join(e, "id")
    held = packs.where(F.col("kind") == "note").select("qid", F.col("id").alias("note_id"), "place")
    known = A.facts(held.join(layer.notes.select("note_id", F.col("text").alias("shown")), "note_id"))
    asked = A.prompts(q, A.excerpts(rows), known)
    return A.read(asked, ExtractiveReader()).select("qid", "answer", "abstained", "prompt_chars", "n_images")


def judged_answers(spark, d):
    """Predictions of the stated questions judged by a rule that stands in for a model: correct if the reference's words are in it."""
    q = V.questions(spark, d).where(F.col("pq_id") % 100 == 0).select(F.col("pq_id").alias("qid"), "question", "gold", "prediction")

    def reply(prompt: str) -> str:
        gold, said = prompt.partition("REFERENCE: ")[2].split("\nANSWER: ")[0], prompt.partition("\nANSWER: ")[2].partition("\n\nReply with")[0]
        return '{"verdict": "CORRECT"}' if set(gold.lower().split()) <= set(said.lower().split()) else '{"verdict": "WRONG"}'

    return judge(q, Scripted(reply))[0]


def consolidated_notes(spark, d):
    """Notes of every session's first words by a rule that stands in for a model, reconciled round by round: by conversation and status."""
    e = V.with_seq(V.episodes(spark, d, "session_datetime", "episode_speakers", "evidence_ids"))
    e = e.select("conv_id", "episode_id", "seq", "text", F.col("session_datetime").alias("stamp"), F.col("episode_speakers").alias("speakers"), "evidence_ids")

    def reply(prompt: str) -> str:
        said = prompt.partition("SESSION:\n")[2].partition("\n\nReply")[0].split()
        return json.dumps({"notes": [{"subject": said[0], "attribute": "plan", "statement": " ".join(said[:8]), "event_time": None}]}) if said else "{}"

    made, _, _ = consolidate(e, Scripted(reply), ConsolidationConfig(use_model=False))
    return made.groupBy("conv_id", "status").agg(F.count("*").alias("notes"))


def segment_notes(spark, d):
    """Summaries of the tiled segments by a rule that stands in for a model: each segment's excerpts in short."""
    e = V.with_seq(V.episodes(spark, d, "session_datetime", "embedding").where(usable(F.col("embedding"), 96)))
    e = stash(e.withColumnRenamed("session_datetime", "stamp"), "docs")
    s = S.tile_segments(e.select("conv_id", "episode_id", F.col("seq").alias("pos"), unit(F.col("embedding")).alias("vector")))
    made = summarise_groups(s.select("conv_id", F.col("segment").alias("group_id"), "episode_id"), e.select("episode_id", "seq", "text", "stamp"), Scripted(lambda p: p.partition("\n\n")[2][:200]))
    return made.select("conv_id", "note_id", "subject", F.size("provenance").alias("members"), "event_time", "recorded_time")


def planned_steps(spark, d):
    """Steps of the stated questions from a rule that stands in for a model: halves of the question's words."""
    q, e, _ = _pipeline(spark, d)
    maps = e.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.format_string("%d turns", "n").alias("map"))

    def reply(prompt: str) -> str:
        words = prompt.partition("QUESTION: ")[2].split("\n")[0].split()
        half = len(words) // 2
        return json.dumps({"needs_multiple_moments": True, "steps": [{"terms": " ".join(words[:half])}, {"terms": " ".join(words[half:])}]})

    return plan(q, maps, Scripted(reply)).select("qid", "step", "terms", "from_model")


def stream_windows(spark, d):
    """Hourly counts per type, computed as a stream over the stored events."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = I.read_stream(spark, f"{d}/events.parquet*", schema, "ts")
    at = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    done = I.run_available(I.windows(stream, "ts", "1 hour", None, "event_type"), f"{at}/checkpoint", f"{at}/out")
    return done.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = I.windows(e, "ts", "1 hour", "15 minutes", "event_type")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def utterance_segments(spark, d):
    """Episodes that the greedy segmenter makes of each session's utterances, timed by their episode's stamp."""
    e = V.with_seq(V.episodes(spark, d, "session_id", "episode_utterances", "image_path", "ts_raw"))
    u = e.select("conv_id", F.coalesce("session_id", F.lit("none")).alias("session_id"), "seq", epoch_seconds(F.col("ts_raw")).alias("at"), (F.coalesce("image_path", F.lit("")) != "").alias("image"), F.posexplode("episode_utterances").alias("p", "text"))
    u = u.select("conv_id", "session_id", (F.col("seq") * 10_000 + F.col("p")).alias("n"), "text", "at", "image")
    return E.segment_utterances(u).groupBy("conv_id", "session_id").agg(F.count("*").alias("utterances"), (F.max("segment") + 1).alias("segments"))


def routing_tree(spark, d):
    return E.sequence_tree(V.with_seq(V.episodes(spark, d)))


def json_objects(spark, d):
    q = V.questions(spark, d).where(F.contains("prediction", F.lit("{")))
    return q.select("pq_id", first_json_object("prediction").alias("whole"), salvaged_json("prediction").alias("salvaged"))


def date_annotations(spark, d):
    e = V.episodes(spark, d, "session_datetime").withColumn("day", parse_session_date(F.col("session_datetime")))
    hinted = e.where(F.col("day").isNotNull() & F.col("text").rlike(HINT))
    return hinted.select("episode_id", "text", annotate_dates("text", "day").alias("annotated")).where("annotated != text").drop("text")


def question_times(spark, d):
    """Questions whose times can be resolved on the day they were asked, with the windows these give."""
    q = V.questions(spark, d, "asked_at").where(F.col("asked_at").isNotNull() & F.col("question").rlike(HINT_QUESTION))
    r = q.select("pq_id", "question", resolve_question("question", F.col("asked_at").cast("date")).alias("r"))
    return r.where("r.text != question").select("pq_id", F.col("r.text").alias("resolved"), F.size("r.windows").alias("windows"))


def _projected(spark, d):
    return stash(G.project(table(spark, d, "embeddings")).select("vec_id", "label", "x"), "projected")


def mixture_groups(spark, d):
    x = _projected(spark, d)
    return G.soft_groups(x, G.select_mixture(x), "vec_id").groupBy("group_id").agg(F.count("*").alias("members"))


def hierarchical_groups(spark, d):
    return G.hierarchical_groups(_projected(spark, d), "vec_id", 10).groupBy("group_id").agg(F.count("*").alias("members"))


def _edges(spark, d):
    return mutual_knn_edges(spark, d).select(F.col("vec_id").alias("src"), F.col("other").alias("dst"), F.col("sim").alias("weight"))


def community_groups(spark, d):
    return G.communities(_edges(spark, d))


def spectral_groups(spark, d):
    return G.spectral_groups(stash(_edges(spark, d), "edges"), 10).groupBy("group_id").agg(F.count("*").alias("members"))


def random_groups(spark, d):
    return G.random_groups(table(spark, d, "embeddings"), "vec_id", 8).groupBy("group_id").agg(F.count("*").alias("members"))


def ward_groups(spark, d):
    return M.ward_groups(_projected(spark, d), "vec_id").groupBy("group_id").agg(F.count("*").alias("members"))


def density_groups(spark, d):
    return M.density_groups(_projected(spark, d), "vec_id").groupBy("group_id").agg(F.count("*").alias("members"))


def modularity_groups(spark, d):
    return M.modularity_communities(_edges(spark, d)).groupBy("group_id").agg(F.count("*").alias("members"))


def topic_groups(spark, d):
    """Soft groups around labels, as a model would give them, over the vectors of notes by the offline encoder."""
    n = V.notes(spark, d).select("note_id", F.concat_ws(" ", "attribute", "statement").alias("t"))
    rows = encode_column(n, "t", HashEncoder())
    labels = M.distinct_topics(["home and residence", "work and job", "a pet", "a trip to the market", "home and residence"], HashEncoder())
    return M.topic_groups(rows.where(F.col("embedding").isNotNull()), "note_id", labels, HashEncoder()).groupBy("label").agg(F.count("*").alias("members"))


def outline_groups(spark, d):
    """Stretches that a rule standing in for a model sees: one at every tenth excerpt shown."""
    e = V.with_seq(V.episodes(spark, d))

    def reply(prompt: str) -> str:
        shown = sum(line.split(".")[0].isdigit() for line in prompt.split("\n"))
        return json.dumps({"spans": [[i, f"part {i}"] for i in range(1, shown + 1, 10)]})

    return M.outline_groups(e, Scripted(reply)).groupBy("conv_id", "group_id", "label").agg(F.count("*").alias("members"))


def cohesion_report(spark, d):
    """Similarity inside the labelled groups against random groups of their sizes."""
    v = table(spark, d, "embeddings")
    return M.cohesion(v.select("vec_id", F.col("label").alias("group_id")), v, "vec_id").select("cohesion", "n_scored")


def group_diagnostics(spark, d):
    v = table(spark, d, "embeddings")
    return M.diagnostics(v.select("vec_id", F.col("label").alias("group_id")), "vec_id")


def group_bridge(spark, d):
    """The index of segments and entities: groups and members by kind."""
    e = stash(V.with_seq(V.episodes(spark, d)), "docs")
    topics = S.fixed_windows(e, 8).select("conv_id", F.col("block").alias("group_id"), F.lit("").alias("label"), "episode_id")
    names = N.top_entities(e)
    canonical = N.canonical_aliases(N.alias_pairs(names))
    index = M.group_index(topics, M.entity_members(N.entity_groups(e, names, 1), canonical))
    return index.groupBy("kind").agg(F.countDistinct("conv_id", "group_id").alias("groups"), F.count("*").alias("members"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieve_packs, retrieve_fuzzy, pack_evidence, answers, judged_answers, consolidated_notes, segment_notes, planned_steps, stream_windows, sliding_windows,
        utterance_segments, routing_tree, json_objects, date_annotations, question_times, mixture_groups, hierarchical_groups, community_groups, spectral_groups, random_groups,
        ward_groups, density_groups, modularity_groups, topic_groups, outline_groups, cohesion_report, group_diagnostics, group_bridge,
    )
}

_TREE = " UNION ALL ".join(
    f"SELECT conv_id, {level} AS level, seq // {6 * 4**level} AS node, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS episodes, CASE WHEN max(top) >= {6 * 4**level} THEN seq // {6 * 4**level} // 4 END AS parent FROM tp WHERE top >= {6 * 4 ** (level - 1) if level else 0} GROUP BY conv_id, seq // {6 * 4**level}"
    for level in range(16)
)
_CHARS = "[^\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_SEGMENTS = f"""WITH RECURSIVE {V.SQL_EPISODES},
x AS (SELECT conv_id, coalesce(session_id, 'none') AS session_id, seq, ts_raw, coalesce(image_path, '') <> '' AS image, unnest(episode_utterances) AS text, generate_subscripts(episode_utterances, 1) AS p FROM ep),
u AS (SELECT conv_id, session_id, row_number() OVER (PARTITION BY conv_id, session_id ORDER BY seq, p) AS i, image, len(regexp_extract_all(coalesce(text, ''), '{_CHARS}')) AS k, list_distinct({V.sql_tokens('text')}) AS own,
             CASE WHEN regexp_matches(ts_raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}(T\\d{{2}}:\\d{{2}}:\\d{{2}})?$') THEN epoch(try_cast(ts_raw AS TIMESTAMP)) END AS at_ FROM x),
f AS (
  SELECT conv_id, session_id, 0::BIGINT AS i, -1::BIGINT AS seg, 0::BIGINT AS number, 0::BIGINT AS size, CAST([] AS VARCHAR[]) AS words, CAST(NULL AS DOUBLE) AS last_, true AS void_ FROM (SELECT DISTINCT conv_id, session_id FROM u)
  UNION ALL
  SELECT conv_id, session_id, i, number + cut, number + cut + CAST(image AS BIGINT), CASE WHEN image THEN 0 WHEN cut = 1 THEN k ELSE size + k END,
         CASE WHEN image THEN CAST([] AS VARCHAR[]) WHEN cut = 1 THEN own ELSE list_distinct(list_concat(words, own)) END, at_, image
  FROM (SELECT u.*, f.number, f.size, f.words,
               CAST(NOT f.void_ AND (u.image OR (f.size + u.k > 800 AND f.size >= 500) OR coalesce(u.at_ - f.last_ > 300, false)
                    OR (f.size >= 500 AND CASE WHEN len(f.words) > 0 AND len(u.own) > 0 THEN len(list_intersect(f.words, u.own))::DOUBLE / len(list_distinct(list_concat(f.words, u.own))) ELSE 0 END < 0.15)) AS BIGINT) AS cut
        FROM f JOIN u ON u.conv_id = f.conv_id AND u.session_id = f.session_id AND u.i = f.i + 1))"""
SQL = {
    "segment_notes": MEMORY_SQL.pop("segment_notes"),
    "stream_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_windows": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL",
    "routing_tree": f"WITH {V.SQL_EPISODES}, tp AS (SELECT *, max(seq) OVER (PARTITION BY conv_id) AS top FROM ep) {_TREE}",
    "utterance_segments": f"{_SEGMENTS} SELECT conv_id, session_id, count(*) AS utterances, CAST(max(seg) + 1 AS INTEGER) AS segments FROM f WHERE i > 0 GROUP BY ALL",
    "random_groups": "SELECT CAST(('0x' || left(md5('0|' || CAST(vec_id AS VARCHAR)), 8))::BIGINT % 8 AS INTEGER) AS group_id, count(*) AS members FROM embeddings GROUP BY 1",
    "group_diagnostics": "WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS groups, round(avg(n), 4) AS mean_size, round(quantile_cont(n, 0.5), 4) AS median_size, max(n) AS largest, 1.0::DOUBLE AS memberships, 0.0::DOUBLE AS shared FROM s",
    "cohesion_report": "WITH u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u), s AS (SELECT label, dim, sum(x) AS x, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT label, sum(x * x) AS q, max(n) AS n FROM s GROUP BY label) SELECT round(avg((q - n) / (n * (n - 1))), 4) AS cohesion, count(*) AS n_scored FROM g WHERE n > 1",
    "judged_answers": f"WITH {V.SQL_QUESTIONS}, q AS (SELECT pq_id AS qid, list_filter(regexp_split_to_array(lower(coalesce(gold, '')), '\\s+'), lambda x: x <> '') AS g, list_filter(regexp_split_to_array(lower(coalesce(prediction, '')), '\\s+'), lambda x: x <> '') AS p, trim(coalesce(gold, '')) = '' OR trim(coalesce(prediction, '')) = '' AS blank FROM qs WHERE pq_id % 100 = 0) SELECT qid, CASE WHEN NOT blank AND list_has_all(p, g) THEN 1.0::DOUBLE ELSE 0 END AS judge FROM q",
    "planned_steps": f"WITH {V.SQL_QUESTIONS}, q AS (SELECT pq_id AS qid, list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '') AS w FROM qs WHERE pq_id % 100 = 0), s AS (SELECT qid, unnest([1, 2]) AS step, w, len(w) // 2 AS h FROM q) SELECT qid, step, array_to_string(CASE WHEN step = 1 THEN w[1:h] ELSE w[h + 1:] END, ' ') AS terms, true AS from_model FROM s",
    "outline_groups": f"WITH {V.SQL_EPISODES}, n AS (SELECT conv_id, seq, greatest(1, count(*) OVER (PARTITION BY conv_id) // 40) AS step FROM ep), s AS (SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS i FROM n WHERE seq % step = 0 AND seq // step < 40), c AS (SELECT conv_id, seq AS lo, 'part ' || CAST(i AS VARCHAR) AS label, row_number() OVER w - 1 AS group_id, lead(seq) OVER w AS hi FROM s WHERE i % 10 = 1 WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) SELECT ep.conv_id, CAST(group_id AS INTEGER) AS group_id, label, count(*) AS members FROM ep JOIN c ON c.conv_id = ep.conv_id AND ep.seq >= lo AND (hi IS NULL OR ep.seq < hi) GROUP BY ALL",
}
