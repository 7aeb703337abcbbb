"""Queries of pools, packs, expansion, boosts and context, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions.dates import epoch_seconds, iso_day, parse_session_date
from recallspark.operators import context as C
from recallspark.operators import ranking as R
from recallspark.operators import views as V
from recallspark.operators.entities import speakers
from recallspark.operators.fusion import dense
from recallspark.operators.lexical import bm25, top_k
from recallspark.operators.search_queries import _sql_bm25, _sql_dense
from recallspark.session import stash


def _lists(spark, d):
    """Ranked lists from the call records: per conversation, one list per role of the questions called for."""
    c = V.calls(spark, d).where(F.col("pq_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("latency_s").isNotNull())
    return c.select(F.col("conv_id").alias("qid"), F.coalesce("role", F.lit("none")).alias("list_no"), F.col("pq_id").alias("id"), F.col("latency_s").alias("score"))


def _candidates(spark, d):
    """Candidates of two kinds: a question's calls, the judge's as notes."""
    c = V.calls(spark, d).where(F.col("pq_id").isNotNull() & F.col("latency_s").isNotNull())
    kind = F.when(F.col("role") == "judge", "note").otherwise("episode")
    return c.select(F.col("pq_id").alias("qid"), kind.alias("kind"), F.col("call_id").alias("id"), F.col("latency_s").alias("score"))


def pool_score(spark, d):
    return R.pool_by_score(_lists(spark, d), 50).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def pool_roundrobin(spark, d):
    return R.pool_round_robin(_lists(spark, d), 50)


def zscore_by_kind(spark, d):
    return R.zscore_by_kind(_candidates(spark, d)).select("qid", "id", "kind", F.round("z", 5).alias("z"))


def pack_compete(spark, d):
    return R.pack_compete(_candidates(spark, d), 3).select("qid", "id", "kind", "place")


def pack_additive(spark, d):
    return R.pack_additive(_candidates(spark, d), 2, 1).select("qid", "id", "kind", "place")


def pack_slots(spark, d):
    return R.pack_slots(_candidates(spark, d), 3, 1).select("qid", "id", "kind", "place")


def pack_route(spark, d):
    """Route mode: notes leave the pool."""
    return R.pack_compete(_candidates(spark, d).where(F.col("kind") != "note"), 3).select("qid", "id", "place")


def _feedback(spark, d):
    e = V.episodes(spark, d, "embedding")
    q = e.where(V.is_query()).select(F.col("episode_id").alias("qid"), "conv_id", F.col("embedding").alias("vector"))
    seen = top_k(dense(q, e).withColumn("sem", F.round("sem", 9)), "sem", 10, ["episode_id"])
    top = seen.where(F.col("rank") <= 2).join(e.select("episode_id", "text"), "episode_id")
    return e, q, seen, R.feedback_terms(top.select("qid", "text"))


def prf_terms(spark, d):
    return _feedback(spark, d)[3]


def prf_expand(spark, d):
    """A second lexical scan with the feedback terms; what the first list holds is left out."""
    e, q, seen, terms = _feedback(spark, d)
    hits = bm25(q.select("qid", "conv_id").join(terms, "qid"), e).withColumn("lex", F.round("lex", 9))
    fresh = hits.join(seen.select("qid", "episode_id"), ["qid", "episode_id"], "left_anti")
    return top_k(fresh, "lex", 5, ["episode_id"]).select("qid", "episode_id", "rank", F.round(F.col("lex") * 0.5, 6).alias("score"))


def summary_expand(spark, d):
    """Episodes behind the first five notes of a conversation, each from its first note."""
    n = V.notes(spark, d, "provenance")
    hits = top_k(n.withColumn("zero", F.lit(0)).withColumnRenamed("conv_id", "qid"), "zero", 5, ["note_id"])
    rows = hits.select("qid", "note_id", F.col("rank").alias("note_rank"), F.posexplode("provenance").alias("pos", "episode_id"))
    e = V.episodes(spark, d).select("episode_id", V.is_query().alias("seen"))
    fresh = rows.join(e.where(~F.col("seen")), "episode_id")
    first = fresh.groupBy("qid", "episode_id").agg(F.min(F.struct("note_rank", "pos", "note_id")).alias("f"))
    return first.select("qid", "episode_id", F.col("f.note_id").alias("note_id"), F.col("f.note_rank").alias("note_rank"))


def _session():
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(blank("session_id"), blank("session_datetime"), blank("ts_raw"), F.lit("none")).alias("session")


def context_neighbours(spark, d):
    e = V.with_seq(V.episodes(spark, d, "session_id", "session_datetime", "ts_raw")).select("conv_id", "seq", "episode_id", _session())
    pack = e.where(V.is_query()).select(F.col("episode_id").alias("qid"), "conv_id", "seq", "session")
    return R.neighbours(pack, e.withColumnRenamed("episode_id", "id"), 1).select("qid", "id", "seq")


def fullcontext_order(spark, d):
    return V.with_seq(V.episodes(spark, d)).select("conv_id", "episode_id", "seq")


def _asked(spark, d):
    q = V.questions(spark, d).where(F.col("pq_id") % 100 == 0)
    return q.select(F.col("pq_id").alias("qid"), F.col("sample").alias("conv_id"), F.col("question").alias("terms"))


def _told(spark, d):
    e = V.episodes(spark, d, "session_datetime", "ts_raw", "episode_speakers", "caption_concise", "image_path")
    stamp = F.coalesce("ts_raw", "session_datetime")
    return e.select("conv_id", "episode_id", "text", stamp.alias("stamp"), F.col("episode_speakers").alias("speakers"), F.col("caption_concise").alias("caption"), "image_path")


def query_constraints(spark, d):
    """Speakers, years and months that the stated questions name."""
    c = C.constraints(_asked(spark, d), speakers(_told(spark, d)))
    return c.select("qid", F.concat_ws(",", F.coalesce("speakers", F.array().cast("array<string>"))).alias("speakers"), F.concat_ws(",", F.array_sort("years")).alias("years"), F.concat_ws(",", F.transform(F.array_sort("months"), lambda m: m.cast("string"))).alias("months"))


def metadata_boost(spark, d):
    """Boosts of speaker (0.10), year (0.05) and month (0.08) for the stated questions over their conversation's episodes."""
    e, q = stash(_told(spark, d), "told"), _asked(spark, d)
    wanted = C.constraints(q, speakers(e))
    pairs = wanted.select("qid", "conv_id").join(e.select("conv_id", "episode_id"), "conv_id")
    return C.boosts(pairs, wanted, e).select("qid", "episode_id", F.round("boost", 2).alias("boost"))


def caption_boost(spark, d):
    """Share of a question's words in the captions of its conversation's images, weighted by 0.4."""
    e, q = _told(spark, d), _asked(spark, d).withColumn("keywords", C.caption_keywords(F.col("terms")))
    pairs = q.select("qid", "conv_id").join(e.where(F.trim(F.coalesce("caption", F.lit(""))) != "").select("conv_id", "episode_id"), "conv_id")
    return C.caption_boosts(pairs, q, e).select("qid", "episode_id", F.round("boost", 6).alias("boost"))


def question_sample(spark, d):
    """At most three questions a conversation, drawn by hash."""
    q = V.questions(spark, d).select(F.col("pq_id").alias("qid"), F.col("sample").alias("conv_id"))
    return C.sampled_questions(q, 3).groupBy("conv_id").agg(F.count("*").alias("questions"))


def evidence_order(spark, d):
    """Evidence of each subject's notes in the order of their ids, each id once."""
    n = V.notes(spark, d, "evidence_ids")
    rows = n.select(F.concat_ws("|", "conv_id", F.lower(F.trim("subject"))).alias("qid"), F.col("note_id").alias("place"), "evidence_ids")
    return C.ordered_evidence(rows).select(F.col("qid").alias("subject"), F.array_join("evidence", " ").alias("evidence"))


def session_dates(spark, d):
    e = V.episodes(spark, d, "session_datetime", "ts_raw")
    return e.select("episode_id", parse_session_date(F.col("session_datetime")).alias("session_day"), parse_session_date(F.col("ts_raw")).alias("stamp_day"))


def stamp_forms(spark, d):
    """Each episode's stamp as a day if it can be read (else as it is), and as seconds since 1970 if it is ISO."""
    e = V.episodes(spark, d, "ts_raw")
    return e.select("episode_id", iso_day(F.col("ts_raw")).alias("day"), epoch_seconds(F.col("ts_raw")).alias("seconds"))


_CAND = f"""WITH {V.SQL_CALLS},
cand AS (SELECT pq_id AS qid, CASE WHEN role = 'judge' THEN 'note' ELSE 'episode' END AS kind, call_id AS id, latency_s AS score
         FROM cl WHERE pq_id IS NOT NULL AND latency_s IS NOT NULL)"""
_LIST = f"""WITH {V.SQL_CALLS},
lists AS (SELECT conv_id AS qid, coalesce(role, 'none') AS list_no, pq_id AS id, max(latency_s) AS score
          FROM cl WHERE pq_id IS NOT NULL AND conv_id IS NOT NULL AND latency_s IS NOT NULL GROUP BY ALL)"""
_FEED = f"""WITH {V.SQL_EPISODES}, {_sql_dense("ep", "episode_id", "is_query")},
seen AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sem DESC, episode_id) AS r FROM semd QUALIFY r <= 10),
fw AS (SELECT DISTINCT qid, unnest({V.sql_tokens("text")}) AS term FROM seen JOIN ep USING (conv_id, episode_id) WHERE r <= 2),
ft AS (SELECT qid, term FROM fw WHERE length(term) > 3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY term) <= 12)"""
#: RE2's word boundary is ASCII: neighbours are spelt out, on text with doubled spaces.
_NAMES = "[^\\p{L}\\p{N}_](" + "|".join(C.MONTH_NAMES) + ")[^\\p{L}\\p{N}_]"



def _sql_months(text: str) -> str:
    names = f"regexp_extract_all(' ' || replace(lower({text}), ' ', '  ') || ' ', '{_NAMES}', 1)"
    return f"list_transform({names}, lambda m: (instr('janfebmaraprmayjunjulaugsepoctnovdec', left(m, 3)) + 2) // 3)"


_WANT = f"""WITH {V.SQL_EPISODES}, {V.SQL_QUESTIONS},
em AS (SELECT *, coalesce(ts_raw, session_datetime) AS stamp FROM ep),
nm AS (SELECT DISTINCT conv_id, lower(n) AS name FROM (SELECT conv_id, unnest(regexp_extract_all(text, 'Speaker\\s+([A-Z][A-Za-z\\-'']+)\\s+says', 1)) AS n FROM ep) WHERE length(n) > 2),
qw AS (SELECT pq_id AS qid, sample AS conv_id, coalesce(question, '') AS t FROM qs WHERE pq_id % 100 = 0),
sw AS (SELECT qid, list(name) AS speakers FROM qw JOIN nm USING (conv_id) WHERE regexp_matches(' ' || lower(t) || ' ', '[^\\p{{L}}\\p{{N}}_]' || name || '[^\\p{{L}}\\p{{N}}_]') GROUP BY qid),
cn AS (SELECT qid, conv_id, coalesce(speakers, []) AS speakers, list_distinct(regexp_extract_all(t, '\\b(20\\d{{2}})\\b', 1)) AS years, list_distinct({_sql_months('t')}) AS months FROM qw LEFT JOIN sw USING (qid))"""
QUERIES = {
    f.__name__: f
    for f in (
        pool_score, pool_roundrobin, zscore_by_kind, pack_compete, pack_additive, pack_slots, pack_route, prf_terms, prf_expand, summary_expand,
        context_neighbours, fullcontext_order, query_constraints, metadata_boost, caption_boost, question_sample, evidence_order, session_dates, stamp_forms,
    )
}

SQL = {
    "pool_score": f"{_LIST} SELECT qid, id, CAST(row_number() OVER w AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT qid, id, max(score) AS score FROM lists GROUP BY ALL) WINDOW w AS (PARTITION BY qid ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 50",
    "pool_roundrobin": f"{_LIST}, dep AS (SELECT *, row_number() OVER (PARTITION BY qid, list_no ORDER BY score DESC, id) AS depth FROM lists), one AS (SELECT * FROM dep QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY depth, list_no) = 1) SELECT qid, id, CAST(row_number() OVER w AS INTEGER) AS rank FROM one WINDOW w AS (PARTITION BY qid ORDER BY depth, list_no, id) QUALIFY row_number() OVER w <= 50",
    "zscore_by_kind": f"{_CAND}, s AS (SELECT *, round(score, 4) AS x FROM cand) SELECT qid, id, kind, round(CASE WHEN count(*) OVER w >= 3 THEN (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w < 1e-12 THEN 1 ELSE stddev_pop(x) OVER w END ELSE x END, 5) AS z FROM s WINDOW w AS (PARTITION BY qid, kind)",
    "pack_compete": f"{_CAND} SELECT qid, id, kind, CAST(row_number() OVER w AS INTEGER) AS place FROM cand WINDOW w AS (PARTITION BY qid ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3",
    "pack_additive": f"{_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, id) AS n FROM cand) SELECT qid, id, kind, CAST(row_number() OVER (PARTITION BY qid ORDER BY kind = 'note', n, id) AS INTEGER) AS place FROM r WHERE (kind <> 'note' AND n <= 2) OR (kind = 'note' AND n <= 1)",
    "pack_slots": f"{_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, id) AS n FROM cand) SELECT qid, id, kind, CAST(row_number() OVER w AS INTEGER) AS place FROM r WINDOW w AS (PARTITION BY qid ORDER BY (kind = 'note' AND n <= 1) DESC, score DESC, id) QUALIFY row_number() OVER w <= 3",
    "pack_route": f"{_CAND} SELECT qid, id, CAST(row_number() OVER w AS INTEGER) AS place FROM cand WHERE kind <> 'note' WINDOW w AS (PARTITION BY qid ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3",
    "prf_terms": f"{_FEED} SELECT qid, string_agg(term, ' ' ORDER BY term) AS terms FROM ft GROUP BY qid",
    "prf_expand": f"{_FEED}, fq AS (SELECT ft.qid, e.conv_id, term FROM ft JOIN ep e ON e.episode_id = ft.qid), {_sql_bm25('ep', 'episode_id', 'text', 'is_query').split('qt AS (')[0].rstrip().rstrip(',')}, hits AS (SELECT fq.qid, t.episode_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS lex FROM fq JOIN idf USING (conv_id, term) JOIN tok t USING (conv_id, term) JOIN len l ON l.conv_id = t.conv_id AND l.episode_id = t.episode_id GROUP BY ALL) SELECT qid, episode_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(lex * 0.5::DOUBLE, 6) AS score FROM hits h WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.qid = h.qid AND s.episode_id = h.episode_id) WINDOW w AS (PARTITION BY qid ORDER BY lex DESC, episode_id) QUALIFY row_number() OVER w <= 5",
    "summary_expand": f"WITH {V.SQL_EPISODES}, {V.SQL_NOTES}, h AS (SELECT conv_id AS qid, note_id, provenance, row_number() OVER (PARTITION BY conv_id ORDER BY note_id) AS nr FROM nt QUALIFY nr <= 5), x AS (SELECT qid, note_id, nr, unnest(provenance) AS episode_id, generate_subscripts(provenance, 1) AS pos FROM h) SELECT qid, episode_id, note_id, CAST(nr AS INTEGER) AS note_rank FROM x WHERE episode_id IN (SELECT episode_id FROM ep WHERE NOT is_query) QUALIFY row_number() OVER (PARTITION BY qid, episode_id ORDER BY nr, pos) = 1",
    "context_neighbours": f"WITH {V.SQL_EPISODES}, s AS (SELECT *, coalesce(nullif(session_id, ''), nullif(session_datetime, ''), nullif(ts_raw, ''), 'none') AS session FROM ep) SELECT DISTINCT q.episode_id AS qid, s.episode_id AS id, s.seq FROM s q JOIN s ON s.conv_id = q.conv_id AND s.session = q.session AND abs(s.seq - q.seq) <= 1 WHERE q.is_query",
    "fullcontext_order": f"WITH {V.SQL_EPISODES} SELECT conv_id, episode_id, seq FROM ep",
    "query_constraints": f"{_WANT} SELECT qid, coalesce(array_to_string(list_sort(speakers), ','), '') AS speakers, coalesce(array_to_string(list_sort(years), ','), '') AS years, coalesce(array_to_string(list_transform(list_sort(months), lambda m: CAST(m AS VARCHAR)), ','), '') AS months FROM cn",
    "metadata_boost": f"{_WANT}, e AS (SELECT *, coalesce(stamp, 'None') || ' ' || left(text, 80) AS head, lower(text) AS low, list_transform(coalesce(episode_speakers, []), lambda x: lower(x)) AS who FROM em), j AS (SELECT qid, episode_id, round(CAST(len(list_filter(speakers, lambda s: list_contains(who, s) OR contains(low, 'speaker ' || s))) > 0 AS INTEGER) * 0.10::DOUBLE + CAST(list_has_any(years, regexp_extract_all(head, '\\b(20\\d{{2}})\\b', 1)) AS INTEGER) * 0.05::DOUBLE + CAST(list_has_any(months, list_concat({_sql_months('head')}, list_filter(list_transform(regexp_extract_all(coalesce(stamp, ''), '-0?(\\d{{1,2}})-', 1), lambda x: CAST(x AS INTEGER)), lambda n: n BETWEEN 1 AND 12))) AS INTEGER) * 0.08::DOUBLE, 2) AS boost FROM cn JOIN e USING (conv_id)) SELECT * FROM j WHERE boost > 0",
    "caption_boost": f"{_WANT}, w AS (SELECT pq_id AS qid, sample AS conv_id, list_filter(list_distinct({V.sql_tokens('question')}), lambda t: length(t) > 2) AS want FROM qs WHERE pq_id % 100 = 0), j AS (SELECT qid, episode_id, CASE WHEN len(want) > 0 THEN len(list_intersect(want, list_distinct({V.sql_tokens('caption_concise')})))::DOUBLE / len(want) ELSE 0 END * 0.4::DOUBLE AS b FROM w JOIN em USING (conv_id) WHERE trim(coalesce(caption_concise, '')) <> '') SELECT qid, episode_id, round(b, 6) AS boost FROM j WHERE b > 0",
    "question_sample": f"WITH {V.SQL_QUESTIONS} SELECT sample AS conv_id, least(3, count(*)) AS questions FROM qs GROUP BY sample",
    "evidence_order": f"WITH {V.SQL_NOTES}, k AS (SELECT *, concat_ws('|', conv_id, lower(trim(subject))) AS k FROM nt), x AS (SELECT k, note_id, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) AS p FROM k), f AS (SELECT k, e, min((note_id, p)) AS z FROM x GROUP BY ALL), s AS (SELECT k, string_agg(e, ' ' ORDER BY z) AS evidence FROM f GROUP BY k) SELECT a.k AS subject, coalesce(evidence, '') AS evidence FROM (SELECT DISTINCT k FROM k) a LEFT JOIN s ON a.k = s.k",
    "stamp_forms": f"WITH {V.SQL_EPISODES} SELECT episode_id, coalesce(strftime({{day2}}, '%Y-%m-%d'), ts_raw) AS day, CASE WHEN regexp_matches(ts_raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}(T\\d{{2}}:\\d{{2}}:\\d{{2}})?$') THEN epoch(try_cast(ts_raw AS TIMESTAMP)) END AS seconds FROM ep",
    "session_dates": f"WITH {V.SQL_EPISODES} SELECT episode_id, {{day1}} AS session_day, {{day2}} AS stamp_day FROM ep",
}


def _fill() -> None:
    from recallspark.operators.history_queries import _day

    for name in ("session_dates", "stamp_forms"):
        SQL[name] = SQL[name].replace("{day1}", _day("session_datetime")).replace("{day2}", _day("ts_raw"))


_fill()
