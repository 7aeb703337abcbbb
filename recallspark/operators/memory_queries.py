"""Queries of segments, entities, notes and groups, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.functions import dates as D
from recallspark.functions import text as T
from recallspark.functions.vectors import unit, usable
from recallspark.operators import entities as N
from recallspark.operators import episodes as E
from recallspark.operators import notes as O
from recallspark.operators import segmentation as S
from recallspark.operators import tree as TR
from recallspark.operators import views as V
from recallspark.operators.grouping import mutual_neighbours
from recallspark.operators.history import standing_notes
from recallspark.operators.history_queries import _STANDING, _day
from recallspark.operators.search_queries import SQL as SEARCH_SQL
from recallspark.operators.search_queries import note_hybrid
from recallspark.plans import planner as P
from recallspark.session import stash, table


def _sequence(spark, d):
    e = V.episodes(spark, d, "embedding").where(usable(F.col("embedding"), 96))
    s = V.with_seq(e.select("conv_id", "episode_id", unit(F.col("embedding")).alias("vector")))
    return stash(s.withColumnRenamed("seq", "pos"), "vectors")


def texttile_gaps(spark, d):
    return S.tile_gaps(_sequence(spark, d)).select("conv_id", "pos", "w", F.round("gap", 5).alias("gap"))


def texttile_depth(spark, d):
    return S.tile_depths(S.tile_gaps(_sequence(spark, d))).select("conv_id", "pos", F.round("depth", 3).alias("depth"))


def texttile_segments(spark, d):
    return S.tile_segments(_sequence(spark, d)).select("conv_id", "episode_id", "segment")


def segment_summary(spark, d):
    """Segments of at least three episodes with size and span: what a summariser is given."""
    s = S.tile_segments(_sequence(spark, d))
    return s.groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.min("episode_id").alias("first_id"), F.max("episode_id").alias("last_id")).where(F.col("n") >= 3)


def fixed_windows(spark, d):
    return S.fixed_windows(V.with_seq(V.episodes(spark, d)), 8).select("episode_id", F.col("block").cast("bigint").alias("block"))


def strided_sample(spark, d):
    return S.strided_sample(V.with_seq(V.episodes(spark, d))).select("conv_id", "episode_id", "seq")


def gap_sessions(spark, d):
    return S.gap_sessions(table(spark, d, "events"), "user_id", "ts", "3600 seconds")


def cohesion_by_label(spark, d):
    """Mean similarity inside each labelled group, from the sum of its unit vectors, beside that of all rows."""
    v = table(spark, d, "embeddings").select("label", F.posexplode(unit(F.col("embedding"))).alias("dim", "x"))
    s = v.groupBy("label", "dim").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    inside = lambda df, *by: df.groupBy(*by).agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.max("n").alias("n"))
    each = inside(s, "label").select("label", "n", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("cohesion"))
    whole = inside(s.groupBy("dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))).select(F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("overall"))
    return each.join(F.broadcast(whole))  # one row


def mutual_knn_edges(spark, d):
    """Pairs of vectors each among the other's floor(log2 n) nearest of all; the SQL beside it stays inside labels (k = 5)."""
    return mutual_neighbours(table(spark, d, "embeddings"), "vec_id").select("vec_id", "other", F.round("sim", 5).alias("sim"))


def _docs(spark, d):
    return stash(V.with_seq(V.episodes(spark, d)), "docs")


def entity_stats(spark, d):
    return N.entity_stats(_docs(spark, d))


def top_entities(spark, d):
    return N.top_entities(_docs(spark, d))


def speaker_extract(spark, d):
    return N.speakers(_docs(spark, d))


def entity_groups(spark, d):
    e = _docs(spark, d)
    return N.entity_groups(e, N.top_entities(e)).groupBy("conv_id", "name").agg(F.count("*").alias("members"), F.min("episode_id").alias("first_id"))


def alias_pairs(spark, d):
    return N.alias_pairs(N.top_entities(_docs(spark, d), 60))


def alias_canonical(spark, d):
    return N.canonical_aliases(N.alias_pairs(N.top_entities(_docs(spark, d), 60)))


def note_supersede(spark, d):
    return O.supersede(standing_notes(table(spark, d, "notes"), table(spark, d, "attribute_kinds")))


def note_stats(spark, d):
    return O.note_totals(V.notes(spark, d, "status"), relation_conflicts(spark, d))


def note_render(spark, d):
    n = V.notes(spark, d, "status", "event_time", "recorded_time", "valid_until")
    return n.select("note_id", O.render().alias("shown"))


def note_visible(spark, d):
    return V.notes(spark, d, "status").where(O.is_active()).groupBy("conv_id").agg(F.count("*").alias("visible"))


def review_classes(spark, d):
    """Active notes of keys with several statements: class and number of links."""
    return O.review_classes(V.notes(spark, d, "status"))


def review_pairs(spark, d):
    """Pairs to review among the notes that share a pack of the note search."""
    n = V.notes(spark, d, "status")
    return O.flag_for_review(note_hybrid(spark, d).select("qid", "note_id"), n)


_NOTE = ("status", "embedding", "event_time", "recorded_time", "valid_from", "valid_until", "superseded_by")


def _reconciled(spark, d):
    n = stash(V.notes(spark, d, *_NOTE), "notes")
    names = N.top_entities(_docs(spark, d))
    active = n.where(O.is_active())
    return n, O.reconcile_candidates(n.where(V.is_query("note_id")), active, O.note_entities(n, names))


def reconcile_pairs(spark, d):
    """Earlier active notes that each stated note may update or repeat: by key, subject, or a shared entity."""
    return _reconciled(spark, d)[1].select("note_id", "other_id", F.round("sim", 6).alias("sim"), "relation")


def note_scopes(spark, d):
    """How many active notes each leading entity scopes."""
    n = V.notes(spark, d, "status").where(O.is_active())
    return O.scope_sizes(O.note_entities(n, N.top_entities(_docs(spark, d))))


def _judged(spark, d):
    """Candidates with a relation that follows from the notes: same statement, update of a stateful attribute, else conflict within a key."""
    n, pairs = _reconciled(spark, d)
    said = lambda side: n.select(F.col("note_id").alias(side), O.plain_statement().alias(f"{side}_said"), O.note_key().alias(f"{side}_key"))
    rows = pairs.select(F.col("other_id").alias("old_id"), F.col("note_id").alias("new_id"), "relation").join(said("old_id"), "old_id").join(said("new_id"), "new_id")
    relation = F.when(F.col("old_id_said") == F.col("new_id_said"), "same").when(F.col("relation") == "update", "update").when(F.col("old_id_key") == F.col("new_id_key"), "conflict").otherwise("independent")
    return n, rows.select("old_id", "new_id", relation.alias("relation"), F.lit("rule").alias("reason"))


def relation_ops(spark, d):
    """How often each operation is applied."""
    n, judged = _judged(spark, d)
    return O.apply_relations(n, stash(judged, "judged"))[2].select("op", F.col("count").alias("n"))


def relation_updates(spark, d):
    """Notes that an applied update marks as superseded."""
    n, judged = _judged(spark, d)
    marked, before = O.apply_relations(n, stash(judged, "judged"))[0], n.select("note_id", F.col("superseded_by").alias("old"))
    return marked.join(before, "note_id").where(F.col("superseded_by").isNotNull() & ~F.col("superseded_by").eqNullSafe(F.col("old"))).select("note_id", "superseded_by", "valid_until")


def relation_conflicts(spark, d):
    """Conflicts recorded, with both statements and times."""
    n, judged = _judged(spark, d)
    return O.apply_relations(n, stash(judged, "judged"))[1].select("note_a", "note_b", "statement_a", "statement_b", "time_a", "time_b")


def note_provenance(spark, d):
    """Notes by how many of their source episodes exist."""
    n = V.notes(spark, d, "provenance").select("note_id", F.explode("provenance").alias("episode_id"))
    e = V.episodes(spark, d).select("episode_id")
    return n.join(e, "episode_id", "left_semi").groupBy("note_id").agg(F.countDistinct("episode_id").alias("sources"))


def date_arithmetic(spark, d):
    """A month back and ten weeks' worth of phrases from each episode's session day."""
    e = V.episodes(spark, d, "session_datetime").select("episode_id", D.parse_session_date(F.col("session_datetime")).alias("day")).where(F.col("day").isNotNull())
    return e.select(
        "episode_id", D.months_back(F.col("day"), 1).alias("month_back"), D.first_of_month_back(F.col("day"), 2).alias("two_months"),
        D.last_weekday(F.col("day"), 0).alias("last_monday"), D.format_day(F.col("day")).alias("shown"),
    )


def attribution_strip(spark, d):
    return V.episodes(spark, d).select("episode_id", F.md5(T.strip_attribution(F.col("text"))).alias("bare"))


def node_summary(spark, d):
    """A conversation's eight most frequent words of five letters or more, with its span."""
    e = _docs(spark, d).select("conv_id", F.explode(T.tokens(F.col("text"))).alias("w")).where(F.length("w") >= 5)
    w = Window.partitionBy("conv_id").orderBy(F.desc("n"), "w")
    top = e.groupBy("conv_id", "w").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(w)).where("r <= 8")
    return top.select("conv_id", F.col("w").alias("word"), "n", F.col("r").alias("rank"))


def _stamped(spark, d):
    e = V.with_seq(V.episodes(spark, d, "ts_raw", "image_path"))
    return e.select("conv_id", "episode_id", "seq", "text", F.col("ts_raw").alias("stamp"), (F.coalesce("image_path", F.lit("")) != "").alias("image"))


def region_summary(spark, d):
    """Anchors, first sentence, names, spans and images of every six consecutive episodes."""
    r = E.region_summaries(_stamped(spark, d))
    return r.select("conv_id", "node", F.array_join("anchors", " ").alias("anchors"), F.md5(F.coalesce("summary", F.lit(""))).alias("summary"), F.array_join("entities", " ").alias("entities"), "first_seq", "last_seq", "first_at", "last_at", "images")


def memory_map(spark, d):
    """The planner's map of each conversation."""
    e = stash(_stamped(spark, d), "docs")
    regions = E.region_summaries(e, 6 * 4**2)
    return P.memory_map(regions, N.top_entities(e), e).select("conv_id", "n_episodes", F.length("map").alias("chars"))


def grown_tree(spark, d):
    """The tree grown by insertion: nodes by conversation and kind, with its depth."""
    nodes = TR.routing_tree(_stamped(spark, d))
    return nodes.groupBy("conv_id", "kind").agg(F.count("*").alias("nodes"), F.max("level").alias("deepest"), F.sum(F.when(F.col("kind") == "leaf", F.size("episode_ids"))).alias("episodes"))


def layer_stats(spark, d):
    e = stash(_stamped(spark, d), "docs")
    s = TR.layer_stats(TR.routing_tree(e), e, N.proper_names(N.entity_stats(e)), V.notes(spark, d))
    return s.select("episodes", "entities", "notes")


def note_lookup(spark, d):
    """Point lookups: the stated notes by id, and how many notes share their key."""
    n = V.notes(spark, d).withColumn("key", O.note_key())
    asked = n.where(V.is_query("note_id")).select("note_id", "conv_id", "key", "statement")
    by_key = n.where(F.col("key").isNotNull()).groupBy("conv_id", "key").agg(F.count("*").alias("of_key"))
    return asked.join(by_key, ["conv_id", "key"]).select("note_id", "statement", "of_key")


def session_facts(spark, d):
    """What each session's prompt shows as known: lines and digest of the latest 25 active notes on its note subjects."""
    n = V.notes(spark, d, "status", "session").withColumn("order", V.number_of(F.col("note_id")))
    asked = n.where(F.col("session").isNotNull()).select("conv_id", "session", "subject").distinct()
    f = O.known_facts(n, asked)
    return f.select("conv_id", "session", F.size(F.split("facts", "\n- \\[")).alias("lines"), F.md5("facts").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        texttile_gaps, texttile_depth, texttile_segments, segment_summary, fixed_windows, strided_sample, gap_sessions, cohesion_by_label, mutual_knn_edges,
        entity_stats, top_entities, speaker_extract, entity_groups, alias_pairs, alias_canonical, note_supersede, note_stats, note_render, note_visible,
        review_classes, review_pairs, reconcile_pairs, note_scopes, relation_ops, relation_updates, relation_conflicts, note_provenance, date_arithmetic, attribution_strip,
        node_summary, region_summary, memory_map, grown_tree, layer_stats, note_lookup, session_facts,
    )
}

_EP, _NT = V.SQL_EPISODES, V.SQL_NOTES
_SEQ = f"""WITH {_EP},
u0 AS (SELECT conv_id, episode_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM ep WHERE {V.sql_usable('embedding')}),
u AS (SELECT conv_id, episode_id, row_number() OVER (PARTITION BY conv_id ORDER BY episode_id) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
             list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u0),
z AS (SELECT *, greatest(3, CAST(round_even(sqrt(n) / 2, 0) AS INTEGER)) AS w FROM u),
x AS (SELECT conv_id, pos, n, w, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM z WHERE n >= 4 * w),
cs AS (SELECT conv_id, dim, n, w, pos + 1 AS upto, sum(x) OVER (PARTITION BY conv_id, dim ORDER BY pos) AS s FROM x UNION ALL SELECT conv_id, dim, n, w, 0, 0 FROM x WHERE pos = 0),
bl AS (SELECT m.conv_id, m.upto AS pos, m.w, m.dim, m.s - l.s AS a, r.s - m.s AS b FROM cs m JOIN cs l ON l.conv_id = m.conv_id AND l.dim = m.dim AND l.upto = m.upto - m.w
       JOIN cs r ON r.conv_id = m.conv_id AND r.dim = m.dim AND r.upto = m.upto + m.w),
gp AS (SELECT conv_id, pos, w, round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 0), 9) AS gap FROM bl GROUP BY ALL),
rn AS (SELECT *, sum(lf) OVER (PARTITION BY conv_id ORDER BY pos) AS lrun, sum(rf) OVER (PARTITION BY conv_id ORDER BY pos DESC) AS rrun
       FROM (SELECT *, coalesce(CAST(lag(gap) OVER o < gap AS INTEGER), 0) AS lf, coalesce(CAST(lead(gap) OVER o < gap AS INTEGER), 0) AS rf FROM gp WINDOW o AS (PARTITION BY conv_id ORDER BY pos))),
dp AS (SELECT conv_id, pos, round(first_value(gap) OVER (PARTITION BY conv_id, lrun ORDER BY pos) + first_value(gap) OVER (PARTITION BY conv_id, rrun ORDER BY pos DESC) - 2 * gap, 9) AS depth FROM rn),
ct AS (SELECT conv_id, pos FROM (SELECT *, avg(depth) OVER (PARTITION BY conv_id) + stddev_pop(depth) OVER (PARTITION BY conv_id) / 2 AS c, coalesce(lag(depth) OVER o, depth) AS p, coalesce(lead(depth) OVER o, depth) AS q FROM dp WINDOW o AS (PARTITION BY conv_id ORDER BY pos))
       WHERE depth > c + 1e-9 AND depth >= p AND depth >= q),
sg AS (SELECT u.conv_id, episode_id, CAST(sum(CASE WHEN ct.pos IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY u.conv_id ORDER BY u.pos) AS BIGINT) AS segment FROM u LEFT JOIN ct ON ct.conv_id = u.conv_id AND ct.pos = u.pos)"""
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_CAPITALS)
_ENT = f"""WITH {_EP},
sn AS (SELECT conv_id, seq, unnest(string_split(regexp_replace(text, '([.!?:])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS s FROM ep),
wd AS (SELECT conv_id, seq, unnest(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')[2:]) AS w FROM sn),
nm AS (SELECT conv_id, seq, regexp_replace(w, '^[.,!?;:\"''()\\[\\]]+|[.,!?;:\"''()\\[\\]]+$', '', 'g') AS name FROM wd),
st AS (SELECT conv_id, name, count(*) AS count, min(seq) AS first_seq, max(seq) AS last_seq FROM nm WHERE regexp_full_match(name, '[A-Z][a-z]{{2,}}') AND name NOT IN ({_STOPS}) GROUP BY ALL),
lw AS (SELECT conv_id, seq, upper(left(w, 1)) || w[2:] AS name FROM (SELECT conv_id, seq, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM ep) WHERE regexp_full_match(w, '[a-z]{{3,}}')),
es AS (SELECT st.*, (SELECT count(*) FROM lw WHERE lw.conv_id = st.conv_id AND lw.name = st.name AND lw.seq >= st.first_seq) AS lower_count FROM st),
sp AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, 'Speaker\\s+([A-Z][A-Za-z\\-'']+)\\s+says', 1)) AS name FROM ep),
tc AS (SELECT conv_id, name, 0 AS tier, 0 AS count FROM sp UNION ALL SELECT conv_id, name, 1, count FROM es WHERE count >= 2 AND count / (count + lower_count) >= 0.75 AND (conv_id, name) NOT IN (SELECT (conv_id, name) FROM sp)),
te AS (SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY tier, count DESC, name) AS rank FROM tc),
ap AS (SELECT a.conv_id, a.name AS short, b.name AS long FROM te a JOIN te b USING (conv_id) WHERE a.rank <= 60 AND b.rank <= 60 AND length(a.name) >= 3
       AND (length(a.name) < length(b.name) OR (length(a.name) = length(b.name) AND a.name < b.name)) AND lower(a.name) <> lower(b.name)
       AND (starts_with(lower(b.name), lower(a.name)) OR levenshtein(lower(a.name), lower(b.name)) <= 1))"""
_ACTIVE = "coalesce(lower(trim(status)), 'active') = 'active'"
_PLAIN = "regexp_replace(trim(lower(regexp_replace(coalesce(statement, ''), '\\s+', ' ', 'g'))), '[\\s.]+$', '')"
_PL = lambda a: _PLAIN.replace("statement", f"{a}.statement")
_REC = f"""{_ENT}, {_NT},
tw AS (SELECT conv_id, note_id, lower(concat_ws(' ', subject, statement)) AS t FROM nt),
wn AS (SELECT DISTINCT conv_id, note_id, unnest(list_concat(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+(?:[''’-][\\p{{L}}\\p{{N}}_]+)+'))) AS word FROM tw),
ne AS (SELECT DISTINCT wn.conv_id, note_id, name AS entity FROM wn JOIN te ON te.conv_id = wn.conv_id AND lower(te.name) = wn.word WHERE te.rank <= 20 AND length(te.name) >= 3),
k AS (SELECT conv_id, note_id, lower(trim(subject)) AS subject, lower(trim(subject)) || '::' || lower(trim(attribute)) AS key, lower(trim(attribute)) AS attribute, {_ACTIVE} AS active,
             coalesce(CASE WHEN trim(valid_from) <> '' THEN valid_from END, recorded_time, '') AS at_, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM nt WHERE {V.sql_usable('embedding')}),
pr AS (SELECT a.note_id, b.note_id AS other_id FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.subject = b.subject UNION SELECT a.note_id, b.note_id FROM ne a JOIN ne b ON a.conv_id = b.conv_id AND a.entity = b.entity),
ps AS (SELECT a.note_id, b.note_id AS other_id, a.attribute, a.key = b.key AS same, b.at_, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS sim
       FROM pr JOIN k a ON a.note_id = pr.note_id JOIN k b ON b.note_id = pr.other_id AND b.conv_id = a.conv_id WHERE b.active AND pr.other_id < pr.note_id AND CAST(regexp_extract(pr.note_id, '(\\d+)$', 1) AS BIGINT) % 100 = 0),
rp AS (SELECT note_id, other_id, sim, CASE WHEN same AND sim >= 0.6 AND attribute IN ({', '.join(repr(a) for a in O.STATEFUL)}) THEN 'update' ELSE 'independent' END AS relation
       FROM ps WHERE (same AND sim >= 0.6) OR sim >= 0.8 QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY at_ DESC, other_id DESC) <= 4),
jd AS (SELECT rp.note_id, rp.other_id, CASE WHEN {_PL('a')} = {_PL('b')} THEN 'same' WHEN relation = 'update' THEN 'update' WHEN lower(trim(a.subject)) || '::' || lower(trim(a.attribute)) = lower(trim(b.subject)) || '::' || lower(trim(b.attribute)) THEN 'conflict' ELSE 'independent' END AS relation2
       FROM rp JOIN nt a ON a.note_id = rp.other_id JOIN nt b ON b.note_id = rp.note_id)"""
_STEM_FREE = "(SELECT conv_id, episode_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '(?m)^\\s*(?:DATE:[^|\\n]*\\|\\s*)?(?:[A-Z][\\w''-]*(?:\\s+[A-Z][\\w''-]*)?\\s+says:\\s*)', '', 'g'), '[\\p{L}\\p{N}_]+'))) AS name FROM ep)"

SQL = {
    "texttile_gaps": f"{_SEQ} SELECT conv_id, pos, w, round(gap, 5) AS gap FROM gp",
    "texttile_depth": f"{_SEQ} SELECT conv_id, pos, round(depth, 3) AS depth FROM dp",
    "texttile_segments": f"{_SEQ} SELECT * FROM sg",
    "segment_summary": f"{_SEQ} SELECT conv_id, segment, count(*) AS n, min(episode_id) AS first_id, max(episode_id) AS last_id FROM sg GROUP BY ALL HAVING count(*) >= 3",
    "segment_notes": f"""{_SEQ}, st AS (SELECT u.conv_id, u.episode_id, u.pos, segment, nullif(session_datetime, '') AS stamp FROM sg JOIN u ON u.conv_id = sg.conv_id AND u.episode_id = sg.episode_id JOIN ep ON ep.episode_id = u.episode_id),
gr AS (SELECT conv_id, segment, count(*) AS n, arg_min(stamp, CASE WHEN stamp IS NOT NULL THEN pos END) AS event_time, arg_max(stamp, CASE WHEN stamp IS NOT NULL THEN pos END) AS recorded_time FROM st GROUP BY ALL HAVING count(*) >= 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, segment) AS r FROM gr)
SELECT conv_id, 'gs-' || left(sha256(conv_id || '|' || CAST(segment AS VARCHAR)), 10) AS note_id, 'group ' || CAST(r - 1 AS VARCHAR) AS subject, CAST(n AS INTEGER) AS members, event_time, recorded_time FROM rk WHERE r <= 60""",
    "fixed_windows": f"WITH {_EP}, n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM ep) SELECT episode_id, CAST(floor(seq / ceil(n / 8)) AS BIGINT) AS block FROM n",
    "strided_sample": f"WITH {_EP}, n AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY conv_id) // 14) AS step FROM ep) SELECT conv_id, episode_id, seq FROM n WHERE seq % step = 0 AND seq // step < 14",
    "gap_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS f FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, f DESC ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS first_at, count(*) AS events FROM s GROUP BY user_id, s",
    "cohesion_by_label": "WITH u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u), s AS (SELECT label, dim, sum(x) AS x, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT sum(x * x) AS q, max(n) AS n FROM (SELECT dim, sum(x) AS x, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY dim)) SELECT label, max(s.n) AS n, round((sum(x * x) - max(s.n)) / (max(s.n) * (max(s.n) - 1)), 5) AS cohesion, (SELECT round((q - n) / (n * (n - 1)), 5) FROM a) AS overall FROM s GROUP BY label",
    "mutual_knn_edges": "WITH u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)), k AS (SELECT greatest(2, CAST(floor(log2(greatest(2, count(*)))) AS BIGINT)) AS k FROM u), n AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.vec_id) <= (SELECT k FROM k)) SELECT a.vec_id, a.other, round(a.sim, 5) AS sim FROM n a JOIN n b ON a.vec_id = b.other AND a.other = b.vec_id WHERE a.vec_id < a.other AND a.sim > 0",
    "entity_stats": f"{_ENT} SELECT * FROM es",
    "top_entities": f"{_ENT} SELECT conv_id, name, CAST(rank AS INTEGER) AS rank FROM te WHERE rank <= 20",
    "speaker_extract": f"{_ENT} SELECT * FROM sp",
    "entity_groups": f"{_ENT}, m AS {_STEM_FREE} SELECT m.conv_id, m.name, count(*) AS members, min(episode_id) AS first_id FROM m JOIN te ON te.conv_id = m.conv_id AND te.name = m.name WHERE te.rank <= 20 GROUP BY ALL HAVING count(*) >= 2",
    "alias_pairs": f"{_ENT} SELECT * FROM ap",
    "alias_canonical": f"{_ENT}, f AS (SELECT conv_id, short AS name, long AS c FROM ap QUALIFY row_number() OVER (PARTITION BY conv_id, short ORDER BY length(long) DESC, long) = 1) SELECT a.conv_id, a.name, coalesce(d.c, c.c, b.c, a.c) AS canonical FROM f a LEFT JOIN f b ON b.conv_id = a.conv_id AND b.name = a.c LEFT JOIN f c ON c.conv_id = a.conv_id AND c.name = b.c LEFT JOIN f d ON d.conv_id = a.conv_id AND d.name = c.c",
    "note_supersede": f"WITH {_STANDING} SELECT conv_id, note_key, note_id, day, CASE WHEN lead(note_id) OVER w IS NOT NULL THEN 'superseded' ELSE 'active' END AS status, lead(note_id) OVER w AS superseded_by, coalesce(until, lead(day) OVER w) AS valid_until FROM standing WINDOW w AS (PARTITION BY conv_id, note_key ORDER BY day)",
    "note_stats": f"{_REC} SELECT (SELECT count(*) FROM nt) AS notes, (SELECT count_if({_ACTIVE}) FROM nt) AS active, (SELECT count_if(NOT {_ACTIVE}) FROM nt) AS superseded, (SELECT count(DISTINCT lower(trim(subject))) FROM nt) AS subjects, (SELECT count(*) FROM jd WHERE relation2 = 'conflict') AS conflicts",
    "note_render": f"WITH {_NT}, w AS (SELECT *, trim(coalesce(statement, '')) AS s, coalesce(CASE WHEN trim(event_time) <> '' THEN event_time END, CASE WHEN trim(recorded_time) <> '' THEN recorded_time END) AS t FROM nt) SELECT note_id, concat_ws(' ', s, CASE WHEN t IS NOT NULL AND NOT contains(s, t) THEN '(as of ' || t || ')' END, CASE WHEN NOT {_ACTIVE} AND trim(valid_until) <> '' THEN '[superseded on ' || valid_until || ']' END) AS shown FROM w",
    "note_visible": f"WITH {_NT} SELECT conv_id, count(*) AS visible FROM nt WHERE {_ACTIVE} GROUP BY conv_id",
    "review_classes": f"WITH {_NT}, v AS (SELECT conv_id, lower(trim(subject)) || '::' || lower(trim(attribute)) AS note_key, {_PLAIN} AS value, note_id FROM nt WHERE {_ACTIVE}), c AS (SELECT conv_id, note_key, note_id, min(note_id) OVER w AS class_id, count(*) OVER (PARTITION BY conv_id, note_key) - count(*) OVER w AS links FROM v WHERE conv_id IS NOT NULL AND note_key IS NOT NULL WINDOW w AS (PARTITION BY conv_id, note_key, value)) SELECT * FROM c WHERE links > 0",
    "review_pairs": f"WITH pk AS ({SEARCH_SQL['note_hybrid']}), {_NT}, h AS (SELECT DISTINCT qid, note_id, lower(trim(subject)) || '::' || lower(trim(attribute)) AS note_key, lower(trim(statement)) AS value FROM pk JOIN nt USING (note_id) WHERE {_ACTIVE}) SELECT DISTINCT a.note_id AS id_a, b.note_id AS id_b, a.note_key FROM h a JOIN h b ON a.qid = b.qid AND a.note_key = b.note_key AND a.note_id < b.note_id AND a.value <> b.value",
    "reconcile_pairs": f"{_REC} SELECT note_id, other_id, round(sim, 6) AS sim, relation FROM rp",
    "note_scopes": f"{_REC} SELECT ne.conv_id, entity, count(*) AS notes FROM ne JOIN nt USING (note_id) WHERE {_ACTIVE} GROUP BY ALL",
    "relation_ops": f"{_REC} SELECT CASE relation2 WHEN 'same' THEN 'noop' WHEN 'update' THEN 'update' WHEN 'conflict' THEN 'conflict' ELSE 'add' END AS op, count(*) AS n FROM jd GROUP BY ALL",
    "relation_updates": f"{_REC} SELECT j.other_id AS note_id, min(j.note_id) AS superseded_by, arg_min(coalesce(nw.valid_from, nw.recorded_time), j.note_id) AS valid_until FROM jd j JOIN nt nw ON nw.note_id = j.note_id WHERE relation2 = 'update' GROUP BY j.other_id",
    "relation_conflicts": f"{_REC} SELECT j.other_id AS note_a, j.note_id AS note_b, a.statement AS statement_a, b.statement AS statement_b, coalesce(a.event_time, a.recorded_time) AS time_a, coalesce(b.event_time, b.recorded_time) AS time_b FROM jd j JOIN nt a ON a.note_id = j.other_id JOIN nt b ON b.note_id = j.note_id WHERE relation2 = 'conflict'",
    "region_summary": f"""{_ENT}, dg AS (SELECT conv_id, seq, seq // 6 AS node, text, ts_raw, coalesce(image_path, '') <> '' AS image, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS t FROM ep),
ww AS (SELECT conv_id, node, seq, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM dg),
an AS (SELECT conv_id, node, lower(w) AS w, count(*) AS n FROM ww WHERE regexp_full_match(w, '[a-zA-Z]{{5,}}') GROUP BY ALL),
a8 AS (SELECT conv_id, node, string_agg(w, ' ' ORDER BY n DESC, w) AS anchors FROM (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY conv_id, node ORDER BY n DESC, w) <= 8) GROUP BY ALL),
cp AS (SELECT conv_id, node, w, min((seq, p)) AS z FROM ww WHERE regexp_full_match(w, '[A-Z][a-z]{{2,}}') AND w NOT IN ({_STOPS}) GROUP BY ALL),
c5 AS (SELECT conv_id, node, string_agg(w, ' ' ORDER BY z) AS entities FROM (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY conv_id, node ORDER BY z) <= 5) GROUP BY ALL),
sm AS (SELECT conv_id, node, arg_min(text, CASE WHEN trim(text) <> '' THEN seq END) AS txt, min(seq) AS first_seq, max(seq) AS last_seq, min(ts_raw) AS first_at, max(ts_raw) AS last_at, count_if(image) AS images FROM dg GROUP BY ALL)
SELECT sm.conv_id, sm.node, coalesce(anchors, '') AS anchors, md5(coalesce(left(string_split(regexp_replace(trim(txt), '([.!?])\\s+', '\\1' || chr(1)), chr(1))[1], 200), '')) AS summary, coalesce(entities, '') AS entities, first_seq, last_seq, first_at, last_at, images
FROM sm LEFT JOIN a8 ON a8.conv_id = sm.conv_id AND a8.node = sm.node LEFT JOIN c5 ON c5.conv_id = sm.conv_id AND c5.node = sm.node""",
    "layer_stats": f"{_ENT}, {_NT} SELECT (SELECT count(*) FROM ep) AS episodes, (SELECT count(*) FROM es WHERE count >= 2 AND count / (count + lower_count) >= 0.75) AS entities, (SELECT count(*) FROM nt) AS notes",
    "note_lookup": f"WITH {_NT}, k AS (SELECT *, lower(trim(subject)) || '::' || lower(trim(attribute)) AS key FROM nt), c AS (SELECT note_id, statement, count(*) OVER (PARTITION BY conv_id, key) AS of_key FROM k WHERE key IS NOT NULL AND conv_id IS NOT NULL) SELECT * FROM c WHERE CAST(regexp_extract(note_id, '(\\d+)$', 1) AS BIGINT) % 100 = 0",
    "session_facts": f"WITH {_NT}, r AS (SELECT *, lower(subject) AS s, CAST(regexp_extract(note_id, '(\\d+)$', 1) AS BIGINT) AS o FROM nt), q AS (SELECT DISTINCT conv_id, session, s FROM r WHERE session IS NOT NULL), f AS (SELECT q.conv_id, q.session, o, '- [' || subject || '/' || attribute || '] ' || statement AS line FROM q JOIN r ON r.conv_id = q.conv_id AND r.s = q.s WHERE {_ACTIVE} QUALIFY row_number() OVER (PARTITION BY q.conv_id, q.session ORDER BY o DESC) <= 25), a AS (SELECT conv_id, session, coalesce(string_agg(line, chr(10) ORDER BY o), '') AS facts FROM f GROUP BY ALL) SELECT conv_id, session, CAST(len(string_split(facts, chr(10) || '- [')) AS INTEGER) AS lines, md5(facts) AS digest FROM a",
    "note_provenance": f"WITH {_EP}, {_NT}, x AS (SELECT note_id, unnest(provenance) AS episode_id FROM nt) SELECT note_id, count(DISTINCT episode_id) AS sources FROM x WHERE episode_id IN (SELECT episode_id FROM ep) GROUP BY note_id",
    "date_arithmetic": f"WITH {_EP}, s AS (SELECT episode_id, {_day('session_datetime')} AS day FROM ep) SELECT episode_id, CAST(day - INTERVAL 1 MONTH AS DATE) AS month_back, CAST(date_trunc('month', day - INTERVAL 2 MONTH) AS DATE) AS two_months, CAST(day - CAST(coalesce(nullif((isodow(day) - 1) % 7, 0), 7) AS INTEGER) AS DATE) AS last_monday, CAST(day(day) AS VARCHAR) || ' ' || monthname(day) || ' ' || CAST(year(day) AS VARCHAR) AS shown FROM s WHERE day IS NOT NULL",
    "attribution_strip": f"WITH {_EP} SELECT episode_id, md5(regexp_replace(text, '(?m)^\\s*(?:DATE:[^|\\n]*\\|\\s*)?(?:[A-Z][\\w''-]*(?:\\s+[A-Z][\\w''-]*)?\\s+says:\\s*)', '', 'g')) AS bare FROM ep",
    "node_summary": f"WITH {_EP}, c AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest({V.sql_tokens('text')}) AS w FROM ep) WHERE length(w) >= 5 GROUP BY ALL) SELECT conv_id, w AS word, n, CAST(row_number() OVER o AS INTEGER) AS rank FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY n DESC, w) QUALIFY row_number() OVER o <= 8",
}
