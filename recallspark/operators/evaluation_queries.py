"""Queries of evaluation and ledger, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions import text as T
from recallspark.functions.vectors import usable
from recallspark.models import answer_confidence
from recallspark.operators import evaluation as E
from recallspark.operators import views as V
from recallspark.plans import judge as J


def answer_normalise(spark, d):
    return V.questions(spark, d).select("pq_id", T.normalise_answer(F.col("prediction")).alias("prediction_plain"), T.normalise_answer(F.col("gold")).alias("gold_plain"))


def exact_match(spark, d):
    return V.questions(spark, d).select("pq_id", T.exact_match(F.col("prediction"), F.col("gold")).alias("em"))


def token_f1(spark, d):
    return V.questions(spark, d).select("pq_id", F.round(T.token_f1(F.col("prediction"), F.col("gold")), 6).alias("f1"))


def bleu1(spark, d):
    return V.questions(spark, d).select("pq_id", F.round(T.bleu1(F.col("prediction"), F.col("gold")), 6).alias("bleu1"))


def _scored(spark, d):
    q = V.questions(spark, d, "retrieved_evidence", "gold_evidence", "metrics")
    m = E.retrieval_metrics(F.col("retrieved_evidence"), F.col("gold_evidence"))
    return q.select("*", *[c.alias(k) for k, c in m.items()])


def retrieval_metrics(spark, d):
    s = _scored(spark, d)
    return s.select("pq_id", F.col("n_gold").cast("int").alias("n_gold"), *[F.round(c, 6).alias(c) for c in ("recall_5", "hit_5", "all_5", "recall_10", "hit_10", "all_10", "recall_30", "mrr")])


def gold_in_pack(spark, d):
    s = V.questions(spark, d, "retrieved_evidence", "gold_evidence")
    g, r = F.coalesce("gold_evidence", F.array().cast("array<string>")), F.coalesce("retrieved_evidence", F.array().cast("array<string>"))
    return s.select("pq_id", F.arrays_overlap(g, r).alias("any_gold"), ((F.size(g) > 0) & (F.size(F.array_except(g, r)) == 0)).alias("all_gold"))


def metric_rollup(spark, d):
    s = _scored(spark, d).select(T.category_label(F.col("category")).alias("cat"), T.token_f1(F.col("prediction"), F.col("gold")).alias("f1"), F.col("recall_10"), F.col("mrr"), F.col("metrics.latency_s").alias("latency_s"))
    r = E.rollup(s, ["f1", "recall_10", "mrr", "latency_s"], "cat")
    return r.select("metric", "category", F.round("mean", 5).alias("mean"), "n", F.round("std", 5).alias("std"))


def macro_micro(spark, d):
    """Mean of category means and mean over all, per run, in percent, categories 1 to 4."""
    s = V.questions(spark, d).where(F.col("category").isin(1, 2, 3, 4)).select("run_name", "category", T.token_f1(F.col("prediction"), F.col("gold")).alias("f1"))
    c = s.groupBy("run_name", "category").agg(F.avg("f1").alias("m"), F.sum("f1").alias("s"), F.count("*").alias("n"))
    return c.groupBy("run_name").agg(F.round(F.avg("m") * 100, 4).alias("macro"), F.round(F.sum("s") / F.sum("n") * 100, 4).alias("micro"))


def percentile_costs(spark, d):
    c = V.calls(spark, d).withColumn("role", F.coalesce("role", F.lit("none")))
    return E.exact_percentiles(c, "latency_s", [50, 95], "role")


def ledger_by_role(spark, d):
    return E.ledger_by_role(V.calls(spark, d))


def question_costs(spark, d):
    """Per question: calls and tokens, and the time that is not the reader's."""
    c = V.calls(spark, d).where(F.col("pq_id").isNotNull())
    total = F.sum(F.coalesce("latency_s", F.lit(0.0)))
    reader = F.sum(F.when(F.col("role") == "reader", F.coalesce("latency_s", F.lit(0.0))).otherwise(0.0))
    return c.groupBy("pq_id").agg(
        F.count("*").alias("calls"), F.sum((F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).cast("bigint")).alias("tokens"),
        F.round(reader, 5).alias("reader_s"), F.round(F.greatest(F.lit(0.0), total - reader), 5).alias("other_s"),
    )


def call_budget(spark, d):
    """Questions whose number of reader calls is not one."""
    q = V.questions(spark, d).select("pq_id")
    c = V.calls(spark, d).where(F.col("role") == "reader").groupBy("pq_id").agg(F.count("*").alias("n"))
    return q.join(c, "pq_id", "left").select("pq_id", F.coalesce("n", F.lit(0)).alias("reader_calls")).where(F.col("reader_calls") != 1)


def judge_key(spark, d):
    q = V.questions(spark, d)
    return q.select("pq_id", T.judge_key("v2", "judge", F.col("question"), F.col("gold"), F.col("prediction")).alias("key"))


def judge_cache_merge(spark, d):
    """Verdict cache of the first half of the runs, merged with the others' verdicts; first wins."""
    q = V.questions(spark, d)
    rows = q.select(T.judge_key("v2", "judge", F.col("question"), F.col("gold"), F.col("prediction")).alias("key"), F.col("pq_id").alias("order"), T.exact_match(F.col("prediction"), F.col("gold")).alias("verdict"), F.col("run_name"))
    first = lambda df: df.groupBy("key").agg(F.min("order").alias("order"), F.min_by("verdict", "order").alias("verdict"))
    cache = first(rows.where(F.col("run_name") < "g"))
    return E.merge_cache(cache, rows.where(F.coalesce(F.col("run_name") >= "g", F.lit(True))).select("key", "order", "verdict"))


def dedupe_distinct_answers(spark, d):
    """Distinct answers to judge, with how many records share each."""
    q = V.questions(spark, d)
    return q.groupBy("question", "gold", "prediction").agg(F.count("*").alias("records"), F.min("pq_id").alias("first_id"))


def judge_rollup(spark, d):
    """Per run: records, judged, unjudged and mean verdict in percent; unjudged ones do not count as wrong."""
    q = V.questions(spark, d, "metrics")
    v = F.col("metrics.exact_match")
    return q.groupBy("run_name").agg(F.count("*").alias("n"), F.count(v).alias("judged"), (F.count("*") - F.count(v)).alias("unjudged"), F.round(F.avg(v) * 100, 4).alias("score"))


def running_metrics(spark, d):
    """Mean F1 and hit at 10 so far within each run, in the order of ids, at every tenth record."""
    s = _scored(spark, d).select("pq_id", "run_name", T.token_f1(F.col("prediction"), F.col("gold")).alias("f1"), "hit_10").where(F.col("run_name").isNotNull())
    sums = {"n": F.lit(1), "sum_f1": F.col("f1"), "judged": F.col("hit_10").isNotNull().cast("int"), "hits": F.coalesce("hit_10", F.lit(0.0))}
    r = V.running_sum(s, "run_name", "pq_id", sums).where(F.col("n") % 10 == 0)
    return r.select("run_name", "n", F.round(F.col("sum_f1") / F.col("n"), 6).alias("f1"), F.round(F.try_divide("hits", "judged"), 6).alias("hit_10"))


def category_labels(spark, d):
    return V.questions(spark, d).groupBy("category").agg(F.count("*").alias("n")).select(T.category_label(F.col("category")).alias("label"), "n")


def abstentions(spark, d):
    q = V.questions(spark, d)
    a = T.abstained(T.answer_text(F.col("prediction")))
    return q.groupBy("run_name").agg(F.count("*").alias("n"), F.sum(a.cast("bigint")).alias("abstained"))


def shard_select(spark, d):
    """Work by shard: the position modulo the number of shards."""
    e = V.with_seq(V.episodes(spark, d))
    return e.groupBy("conv_id", F.pmod("seq", F.lit(4)).alias("shard")).agg(F.count("*").alias("n"))


def bootstrap_interval(spark, d):
    """Bootstrap interval of the mean F1 by category, from 1,000 resamples."""
    q = V.questions(spark, d).select("pq_id", T.category_label(F.col("category")).alias("category"), T.token_f1(F.col("prediction"), F.col("gold")).alias("f1"))
    r = E.bootstrap_ci(q, "f1", "category")
    return r.select("category", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


def _costs(spark, d):
    """Stage times per question from its calls: the reader's, what summaries and planning took as encoder time stands in, the judge's as reranker time."""
    c = V.calls(spark, d).where(F.col("pq_id").isNotNull())
    of = lambda *roles: F.sum(F.when(F.lower(F.trim("role")).isin(*roles), F.coalesce("latency_s", F.lit(0.0))).otherwise(0.0))
    total = F.sum(F.coalesce("latency_s", F.lit(0.0)))
    s = c.groupBy("pq_id").agg(total.alias("t"), of("reader").alias("r"), of("planner").alias("e"), of("judge").alias("j"))
    parts = E.question_cost(F.col("t"), F.col("r"), F.col("e"), F.col("j"), F.lit(0.0))
    return s.select("pq_id", *[x.alias(k) for k, x in parts.items()])


def stage_costs(spark, d):
    """A question's time by stage; what no stage accounts for is other, 0 at least."""
    return _costs(spark, d).select("pq_id", *[F.round(c, 5).alias(c) for c in ("total_s", "reader_s", "embed_s", "rerank_s", "retrieval_other_s", "retrieval_s")])


def cost_summary(spark, d):
    """Sum, mean and percentiles of the six timings over all questions of each run."""
    runs = V.questions(spark, d).select("pq_id", F.coalesce("run_name", F.lit("none")).alias("run"))
    r = E.cost_summary(_costs(spark, d).join(runs, "pq_id"), "run")
    return r.select("run", "timing", "n", F.round("sum", 2).alias("sum"), F.round("mean", 3).alias("mean"), F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"))


def ledger_since(spark, d):
    """The ledger of the calls from the middle of the ids on."""
    c = V.calls(spark, d)
    half = c.agg((F.max("call_id") / 2).alias("half"))
    return E.ledger_since(c.join(F.broadcast(half)), F.col("call_id") >= F.col("half"))  # one row


def verdicts(spark, d):
    """Verdicts read from replies: the predictions stand in for what a judge said."""
    q = V.questions(spark, d)
    v = J.parse_verdict(F.col("prediction"), F.when(F.col("prediction").rlike(r"^\{.*\}$"), F.col("prediction")))
    return q.select("run_name", v["score"].alias("score")).groupBy("run_name").agg(F.count("*").alias("n"), F.count("score").alias("judged"))


def confidence_features(spark, d):
    """What log-probabilities say, with vectors standing in: minus each component's size, the runner-up half as likely again."""
    e = V.episodes(spark, d, "embedding").where(usable(F.col("embedding"), 96))
    lp = F.transform("embedding", lambda x: F.struct((-F.abs(x.cast("double"))).alias("logprob"), (-1.5 * F.abs(x.cast("double"))).alias("second")))
    c = answer_confidence(lp)
    return e.select("episode_id", *[F.round(c[k], 6).alias(k) for k in ("lp_mean", "lp_min", "lp_sum", "lp_margin_mean", "lp_margin_min")], c["n_tokens"].alias("n_tokens"))


def dataset_statistics(spark, d):
    e = V.episodes(spark, d, "session_id")
    q = V.questions(spark, d).agg(F.count("*").alias("questions"), F.sum((F.col("category") == 5).cast("bigint")).alias("adversarial"))
    s = e.agg(F.countDistinct("conv_id").alias("conversations"), F.countDistinct("conv_id", "session_id").alias("sessions"), F.count("*").alias("episodes"))
    return s.join(F.broadcast(q))  # one row each


def evidence_images(spark, d):
    """Questions whose gold evidence points at a turn with an image.

    What follows the colon of an evidence id is compared with the ends of the turns' ids.
    Each turn offers the ends of its id, so the comparison is an equi-join.
    """
    part = F.split("evidence", ":")
    q = V.questions(spark, d, "gold_evidence").select("pq_id", F.col("sample").alias("conv_id"), F.explode("gold_evidence").alias("evidence"))
    q = q.where(F.contains("evidence", F.lit(":"))).select("pq_id", "conv_id", part[1].alias("tail"))
    e = V.episodes(spark, d, "evidence_ids", "image_path").where(F.coalesce("image_path", F.lit("")) != "").select("conv_id", F.explode("evidence_ids").alias("id")).where(F.length("id") > 0)
    ends = e.select("conv_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("id") + 1), lambda i: F.substr("id", i))).alias("tail")).distinct()
    return q.join(ends, ["conv_id", "tail"], "left_semi").select("pq_id").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        answer_normalise, exact_match, token_f1, bleu1, retrieval_metrics, gold_in_pack, metric_rollup, macro_micro, percentile_costs, ledger_by_role, question_costs,
        call_budget, judge_key, judge_cache_merge, dedupe_distinct_answers, judge_rollup, running_metrics, category_labels, abstentions, shard_select,
        bootstrap_interval, stage_costs, cost_summary, ledger_since, verdicts, confidence_features, dataset_statistics, evidence_images,
    )
}


def _plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])(?:(?:a|an|the)(?:$|[^\\p{{L}}\\p{{N}}_]))+', '\\1 ', 'g'), '\\s+', ' ', 'g'))"


_Q = f"""WITH {V.SQL_QUESTIONS},
pl AS (SELECT *, {_plain('prediction')} AS pp, {_plain('gold')} AS gg FROM qs),
tk AS (SELECT *, list_filter(string_split(pp, ' '), lambda x: x <> '') AS a, list_filter(string_split(gg, ' '), lambda x: x <> '') AS b FROM pl),
ov AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS n FROM tk),
sc AS (SELECT *, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 OR n = 0 THEN 0 ELSE 2.0::DOUBLE * n / (len(a) + len(b)) END AS f1 FROM ov)"""
_R = """,
gd AS (SELECT *, list_distinct(list_filter(coalesce(gold_evidence, []), lambda g: g IS NOT NULL AND g <> '')) AS w, coalesce(retrieved_evidence, []) AS r FROM sc),
rm AS (SELECT *, len(w) AS n_gold, """ + ", ".join(
    f"CASE WHEN len(w) > 0 THEN len(list_intersect(w, r[1:{k}]))::DOUBLE / len(w) END AS recall_{k}, CASE WHEN len(w) > 0 THEN CAST(len(list_intersect(w, r[1:{k}])) > 0 AS INTEGER)::DOUBLE END AS hit_{k}, CASE WHEN len(w) > 0 THEN CAST(len(list_intersect(w, r[1:{k}])) = len(w) AS INTEGER)::DOUBLE END AS all_{k}"
    for k in (5, 10, 30)
) + ", CASE WHEN len(w) > 0 THEN coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(w, lambda g: coalesce(list_position(r, g), 0)), lambda p: p > 0)), 0) END AS mrr FROM gd)"
_CAT = "CASE category WHEN 1 THEN 'multi_hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open_domain' WHEN 4 THEN 'single_hop' WHEN 5 THEN 'adversarial' ELSE 'cat_' || coalesce(CAST(category AS VARCHAR), 'None') END"
_COST = f"""WITH {V.SQL_CALLS},
sc AS (SELECT pq_id, sum(coalesce(latency_s, 0)) AS t, sum(CASE WHEN lower(trim(role)) = 'reader' THEN coalesce(latency_s, 0) ELSE 0 END) AS r, sum(CASE WHEN lower(trim(role)) = 'planner' THEN coalesce(latency_s, 0) ELSE 0 END) AS e,
              sum(CASE WHEN lower(trim(role)) = 'judge' THEN coalesce(latency_s, 0) ELSE 0 END) AS j FROM cl WHERE pq_id IS NOT NULL GROUP BY pq_id)"""
_KEY = "left(sha256(concat_ws(chr(31), 'v2', 'judge', coalesce(question, ''), coalesce(gold, ''), coalesce(prediction, ''))), 32)"

SQL = {
    "answer_normalise": f"{_Q} SELECT pq_id, pp AS prediction_plain, gg AS gold_plain FROM sc",
    "exact_match": f"{_Q} SELECT pq_id, CAST(pp = gg AS INTEGER)::DOUBLE AS em FROM sc",
    "token_f1": f"{_Q} SELECT pq_id, round(f1, 6) AS f1 FROM sc",
    "bleu1": f"{_Q} SELECT pq_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE (CASE WHEN n = 0 THEN 0.1::DOUBLE / len(a) ELSE n::DOUBLE / len(a) END) * (CASE WHEN len(a) >= len(b) THEN 1 ELSE exp(1 - len(b)::DOUBLE / len(a)) END) END, 6) AS bleu1 FROM sc",
    "retrieval_metrics": f"{_Q}{_R} SELECT pq_id, CAST(n_gold AS INTEGER) AS n_gold, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("recall_5", "hit_5", "all_5", "recall_10", "hit_10", "all_10", "recall_30", "mrr")) + " FROM rm",
    "gold_in_pack": f"WITH {V.SQL_QUESTIONS} SELECT pq_id, list_has_any(coalesce(gold_evidence, []), coalesce(retrieved_evidence, [])) AS any_gold, len(coalesce(gold_evidence, [])) > 0 AND list_has_all(coalesce(retrieved_evidence, []), coalesce(gold_evidence, [])) AS all_gold FROM qs",
    "metric_rollup": f"{_Q}{_R}, l AS (SELECT {_CAT} AS cat, unnest([{{'m': 'f1', 'v': f1}}, {{'m': 'recall_10', 'v': recall_10}}, {{'m': 'mrr', 'v': mrr}}, {{'m': 'latency_s', 'v': metrics.latency_s}}]) AS s FROM rm), k AS (SELECT s.m AS metric, cat, s.v AS v FROM l WHERE s.v IS NOT NULL AND NOT isnan(s.v)) SELECT metric, CASE WHEN grouping(cat) = 1 THEN 'overall' ELSE cat END AS category, round(avg(v), 5) AS mean, count(*) AS n, round(stddev_samp(v), 5) AS std FROM k GROUP BY GROUPING SETS ((metric, cat), (metric))",
    "macro_micro": f"{_Q}, c AS (SELECT run_name, category, avg(f1) AS m, sum(f1) AS s, count(*) AS n FROM sc WHERE category IN (1, 2, 3, 4) GROUP BY ALL) SELECT run_name, round(avg(m) * 100, 4) AS macro, round(sum(s) / sum(n) * 100, 4) AS micro FROM c GROUP BY run_name",
    "percentile_costs": f"WITH {V.SQL_CALLS}, o AS (SELECT coalesce(role, 'none') AS role, latency_s AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY coalesce(role, 'none')) AS n FROM cl WHERE latency_s IS NOT NULL WINDOW w AS (PARTITION BY coalesce(role, 'none') ORDER BY latency_s)) SELECT role, max(n) AS n, max(CASE WHEN i = round_even(0.5::DOUBLE * (n - 1), 0) + 1 THEN x END) AS p50, max(CASE WHEN i = round_even(0.95::DOUBLE * (n - 1), 0) + 1 THEN x END) AS p95 FROM o GROUP BY role",
    "ledger_by_role": f"WITH {V.SQL_CALLS} SELECT coalesce(role, 'none') AS role, count(*) AS calls, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens, round(sum(latency_s), 3) AS latency_s, count_if(NOT coalesce(ok, true)) AS failed, count_if(coalesce(truncated, false)) AS truncated, count_if(coalesce(output_capped, false)) AS output_capped, count_if(coalesce(transport_failed, false)) AS transport_failed FROM cl GROUP BY ALL",
    "question_costs": f"WITH {V.SQL_CALLS}, s AS (SELECT pq_id, count(*) AS calls, CAST(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS BIGINT) AS tokens, sum(coalesce(latency_s, 0)) AS t, sum(CASE WHEN role = 'reader' THEN coalesce(latency_s, 0) ELSE 0 END) AS r FROM cl WHERE pq_id IS NOT NULL GROUP BY pq_id) SELECT pq_id, calls, tokens, round(r, 5) AS reader_s, round(greatest(0, t - r), 5) AS other_s FROM s",
    "call_budget": f"WITH {V.SQL_QUESTIONS}, {V.SQL_CALLS}, c AS (SELECT pq_id, count(*) AS n FROM cl WHERE role = 'reader' GROUP BY pq_id) SELECT qs.pq_id, coalesce(n, 0) AS reader_calls FROM qs LEFT JOIN c USING (pq_id) WHERE coalesce(n, 0) <> 1",
    "judge_key": f"WITH {V.SQL_QUESTIONS} SELECT pq_id, {_KEY} AS key FROM qs",
    "judge_cache_merge": f"{_Q}, v AS (SELECT {_KEY} AS key, pq_id AS ord, CAST(pp = gg AS INTEGER)::DOUBLE AS verdict, coalesce(run_name >= 'g', true) AS late FROM sc) SELECT key, ord AS \"order\", verdict FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY late, ord) = 1",
    "dedupe_distinct_answers": f"WITH {V.SQL_QUESTIONS} SELECT question, gold, prediction, count(*) AS records, min(pq_id) AS first_id FROM qs GROUP BY ALL",
    "judge_rollup": f"WITH {V.SQL_QUESTIONS} SELECT run_name, count(*) AS n, count(metrics.exact_match) AS judged, count(*) - count(metrics.exact_match) AS unjudged, round(avg(metrics.exact_match) * 100, 4) AS score FROM qs GROUP BY run_name",
    "running_metrics": f"{_Q}{_R}, w AS (SELECT run_name, row_number() OVER o AS n, avg(f1) OVER (PARTITION BY run_name ORDER BY pq_id ROWS UNBOUNDED PRECEDING) AS f1, avg(hit_10) OVER (PARTITION BY run_name ORDER BY pq_id ROWS UNBOUNDED PRECEDING) AS hit_10 FROM rm WHERE run_name IS NOT NULL WINDOW o AS (PARTITION BY run_name ORDER BY pq_id)) SELECT run_name, n, round(f1, 6) AS f1, round(hit_10, 6) AS hit_10 FROM w WHERE n % 10 = 0",
    "abstentions": f"WITH {V.SQL_QUESTIONS}, b AS (SELECT run_name, trim(regexp_replace(trim(prediction), '^```[A-Za-z]*\\s*|\\s*```$', '', 'g')) AS bare FROM qs), f AS (SELECT run_name, coalesce(CASE WHEN starts_with(bare, '{{') AND json_valid(bare) THEN json_extract_string(bare, '$.answer') END, bare) AS x FROM b), a AS (SELECT run_name, trim(regexp_replace(trim(regexp_replace(x, '(?i)^\\s*answer\\s*:\\s*', '')), '^[\"'']|[\"'']$', '', 'g')) AS a FROM f) SELECT run_name, count(*) AS n, count_if(starts_with(upper(trim(coalesce(a, ''))), 'NOT_FOUND')) AS abstained FROM a GROUP BY run_name",
    "stage_costs": f"{_COST} SELECT pq_id, round(t, 5) AS total_s, round(r, 5) AS reader_s, round(e, 5) AS embed_s, round(j, 5) AS rerank_s, round(greatest(0, t - r - e - j), 5) AS retrieval_other_s, round(t - r, 5) AS retrieval_s FROM sc",
    "cost_summary": f"{_COST}, {V.SQL_QUESTIONS}, l AS (SELECT coalesce(run_name, 'none') AS run, unnest([{{'k': 'total_s', 'v': round(t, 6)}}, {{'k': 'reader_s', 'v': round(r, 6)}}, {{'k': 'embed_s', 'v': round(e, 6)}}, {{'k': 'rerank_s', 'v': round(j, 6)}}, {{'k': 'retrieval_other_s', 'v': round(greatest(0, t - r - e - j), 6)}}, {{'k': 'retrieval_s', 'v': round(t - r, 6)}}]) AS s FROM sc JOIN qs USING (pq_id)), o AS (SELECT run, s.k AS timing, s.v AS v, row_number() OVER (PARTITION BY run, s.k ORDER BY s.v) AS i, count(*) OVER (PARTITION BY run, s.k) AS n FROM l) SELECT run, timing, max(n) AS n, round(round(sum(v), 3), 2) AS sum, round(round(avg(v), 4), 3) AS mean, round(round(max(CASE WHEN i = round_even(0.5::DOUBLE * (n - 1), 0) + 1 THEN v END), 4), 3) AS p50, round(round(max(CASE WHEN i = round_even(0.95::DOUBLE * (n - 1), 0) + 1 THEN v END), 4), 3) AS p95 FROM o GROUP BY run, timing",
    "ledger_since": f"WITH {V.SQL_CALLS} SELECT coalesce(role, 'none') AS role, count(*) AS calls, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens, round(sum(latency_s), 3) AS latency_s, count_if(NOT coalesce(ok, true)) AS failed, count_if(coalesce(truncated, false)) AS truncated, count_if(coalesce(output_capped, false)) AS output_capped, count_if(coalesce(transport_failed, false)) AS transport_failed FROM cl WHERE call_id >= (SELECT max(call_id) / 2 FROM cl) GROUP BY ALL",
    "verdicts": f"WITH {V.SQL_QUESTIONS}, v AS (SELECT run_name, upper(coalesce(prediction, '')) AS u, regexp_matches(coalesce(prediction, ''), '^\\{{.*\\}}$') AS j FROM qs) SELECT run_name, count(*) AS n, count_if(j OR contains(u, 'WRONG') OR contains(u, 'CORRECT')) AS judged FROM v GROUP BY run_name",
    "confidence_features": f"WITH {V.SQL_EPISODES}, v AS (SELECT episode_id, list_transform(embedding, lambda x: -abs(x::DOUBLE)) AS l FROM ep WHERE {V.sql_usable('embedding')}) SELECT episode_id, round(list_avg(l), 6) AS lp_mean, round(list_min(l), 6) AS lp_min, round(list_sum(l), 6) AS lp_sum, round(list_avg(list_transform(l, lambda x: -x / 2)), 6) AS lp_margin_mean, round(list_min(list_transform(l, lambda x: -x / 2)), 6) AS lp_margin_min, CAST(len(l) AS INTEGER) AS n_tokens FROM v",
    "category_labels": f"WITH {V.SQL_QUESTIONS} SELECT {_CAT} AS label, count(*) AS n FROM qs GROUP BY category",
    "shard_select": f"WITH {V.SQL_EPISODES} SELECT conv_id, seq % 4 AS shard, count(*) AS n FROM ep GROUP BY ALL",
    "dataset_statistics": f"WITH {V.SQL_EPISODES}, {V.SQL_QUESTIONS} SELECT (SELECT count(DISTINCT conv_id) FROM ep) AS conversations, (SELECT count(*) FROM (SELECT DISTINCT conv_id, session_id FROM ep WHERE conv_id IS NOT NULL AND session_id IS NOT NULL)) AS sessions, (SELECT count(*) FROM ep) AS episodes, (SELECT count(*) FROM qs) AS questions, (SELECT count_if(category = 5) FROM qs) AS adversarial",
    "evidence_images": f"WITH {V.SQL_EPISODES}, {V.SQL_QUESTIONS}, q AS (SELECT pq_id, sample AS conv_id, unnest(gold_evidence) AS evidence FROM qs), t AS (SELECT pq_id, conv_id, string_split(evidence, ':')[2] AS tail FROM q WHERE contains(evidence, ':')), e AS (SELECT conv_id, unnest(evidence_ids) AS id FROM ep WHERE coalesce(image_path, '') <> '') SELECT DISTINCT pq_id FROM t WHERE EXISTS (SELECT 1 FROM e WHERE e.conv_id = t.conv_id AND length(id) > 0 AND ends_with(id, tail))",
}
