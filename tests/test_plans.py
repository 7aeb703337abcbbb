"""Search, prompts, judge, planner, consolidation, summaries and the facade on small fixtures."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from recallspark.engine import MemoryEngine
from recallspark.functions.jsonx import items_in, items_of
from recallspark.models import Scripted
from recallspark.operators import context as C
from recallspark.operators import notes as O
from recallspark.plans import consolidate as K
from recallspark.plans import judge as J
from recallspark.plans import planner as P
from recallspark.plans import reader as A
from recallspark.plans.retrieve import RetrievalConfig, build_layer, confidence, evidence, rerank, retrieve, search
from recallspark.plans.summaries import summarise_groups

TEXTS = ["red fox runs", "blue hen sleeps", "green owl flies high", "grey cat waits", "red owl sings"]


@pytest.fixture
def layer(spark):
    rows = [("c", f"e-{i}", t, "s" if i < 3 else "t", "2023-05-08", ["Ann"], "a red kayak" if i == 3 else None, [f"D{i}"]) for i, t in enumerate(TEXTS)]
    e = spark.createDataFrame(rows, "conv_id string, episode_id string, text string, session string, stamp string, speakers array<string>, caption string, evidence_ids array<string>")
    n = spark.createDataFrame([("c", "n-1", "the owl is green", ["e-2", "e-4", "gone"]), ("c", "n-2", "a hen", None)], "conv_id string, note_id string, text string, provenance array<string>")
    return build_layer(e, n, RetrievalConfig())


def asked(spark, *terms):
    return spark.createDataFrame([(i, "c", t) for i, t in enumerate(terms, 1)], "qid bigint, conv_id string, terms string")


def test_boosts_lift_what_the_question_names(spark, layer):
    q = asked(spark, "what did Ann do in May 2023?", "nothing")
    wanted = {r.qid: (r.speakers, r.years, r.months) for r in C.constraints(q, layer.names).collect()}
    assert wanted[1] == (["ann"], ["2023"], [5]) and wanted[2] == (None, [], [])
    pairs = q.select("qid", "conv_id").join(layer.episodes.select("conv_id", "episode_id"), "conv_id")
    assert {(r.qid, r.boost) for r in C.boosts(pairs, C.constraints(q, layer.names), layer.episodes).collect()} == {(1, 0.23)}
    steps = q.where("qid = 1").select("qid", "conv_id", F.lit("red").alias("terms"), F.lit("red Ann").alias("semantic"), F.lit("").alias("keywords"))
    plain = {r.id: r.score for r in search(steps, layer, RetrievalConfig(boosts={"speaker": 0.0, "year": 0.0, "month": 0.0})).collect()}
    lifted = {r.id: r.score for r in search(steps, layer, RetrievalConfig()).collect()}
    assert set(plain) == set(lifted) and all(lifted[i] == pytest.approx(plain[i] + 0.1) for i in plain)


def test_captions_fold_in(spark, layer):
    q = asked(spark, "owl [Image caption: red kayak]").select("qid", "conv_id", F.lit("owl").alias("terms"), F.lit("owl").alias("semantic"), C.caption_keywords(F.col("terms")).alias("keywords"))
    without = {r.id for r in search(q, layer, RetrievalConfig(scan_top_k=1)).collect()}
    found = {r.id: r.score for r in search(q, layer, RetrievalConfig(scan_top_k=1, multimodal=True)).collect()}
    assert "e-3" not in without and found["e-3"] > 0


def test_expansions_join_and_fuzzy_and_slots(spark, layer):
    q = asked(spark, "green owl")
    cfg = RetrievalConfig(top_k=4, scan_top_k=1, note_top_k=1, prf_docs=0, context_window=0)
    got = [(r.kind, r.id) for r in retrieve(q, None, None, cfg, layer).orderBy("place").collect()]
    assert ("episode", "e-4") in got and ("note", "n-1") in got  # e-4 only through the note
    fuzzy = retrieve(q, None, None, RetrievalConfig(lexical_scorer="fuzzy", top_k=3, note_slots=1, prf_docs=0, context_window=0), layer)
    assert [r.kind for r in fuzzy.orderBy("place").collect()][0] == "note"
    with pytest.raises(ValueError):
        retrieve(q, None, None, RetrievalConfig(lexical_scorer="x"), layer)


def test_a_failed_reranker_keeps_the_pool_in_order(spark, layer):
    class Broken:
        def score(self, q, p):
            return None

    pool = spark.createDataFrame([(1, "episode", "e-0", 0.2, 2), (1, "episode", "e-4", 0.9, 1)], "qid bigint, kind string, id string, score double, rank int")
    extra = spark.createDataFrame([(1, "episode", "e-1", 0.1)], "qid bigint, kind string, id string, score double")
    texts = layer.episodes.select(F.col("episode_id").alias("id"), "text")
    ids = lambda cfg: [r.id for r in rerank(pool, extra, asked(spark, "red"), texts, cfg).orderBy(F.desc("score")).collect()]
    assert ids(RetrievalConfig(reranker=Broken())) == ["e-4", "e-0"]
    assert ids(RetrievalConfig(rerank=False)) == ["e-4", "e-0", "e-1"]
    assert set(ids(RetrievalConfig())) == {"e-4", "e-0", "e-1"} and ids(RetrievalConfig(rerank_pool=1))[-1] == "e-0"


def test_evidence_and_confidence(spark, layer):
    packs = retrieve(asked(spark, "red fox"), None, None, RetrievalConfig(top_k=2), layer).persist()
    found = evidence(packs, layer).first()
    assert found.retrieved[0] == "D0" and confidence(packs).first().rr_margin >= 0


def test_prompts_have_dates_facts_conflicts_and_images(spark):
    rows = spark.createDataFrame(
        [(1, "b", 2, "I came yesterday", "1:00 pm on 8 May, 2023", date(2023, 5, 10), "x.jpg", True), (1, "a", 1, "plain {question}", None, date(2023, 5, 10), "y.jpg", False)],
        "qid int, id string, seq int, text string, stamp string, now date, image_path string, ranked boolean",
    )
    e = A.excerpts(rows)
    notes = spark.createDataFrame([(1, 1, "Ann works.")], "qid int, place int, shown string")
    clash = spark.createDataFrame([(1, "A", "2020", "B", None)], "qid int, statement_a string, time_a string, statement_b string, time_b string")
    q = spark.createDataFrame([(1, "what happened 2 days ago?", date(2023, 5, 10)), (2, "else?", None)], "qid int, terms string, now date")
    got = {r.qid: r for r in A.prompts(q, e, A.facts(notes, clash), A.ReaderConfig(system_prompt="Be brief.")).collect()}
    p = got[1].prompt
    assert p.startswith("Be brief.\n\n") and "PASSAGE 1 (recorded unknown):\nplain {question}" in p
    assert "PASSAGE 2 (recorded 8 May 2023, 2 days before the current date):\nI came yesterday (7 May 2023, 3 days before the current date)" in p
    assert "- Ann works." in p and '- "A" (2020) against "B" (undated)' in p and "2 days ago (8 May 2023)" in p
    assert got[1].images == ["x.jpg"] and "1. passage 2" in p and got[2].prompt is None
    said = {r.qid: (r.answer, r.abstained) for r in A.read(A.prompts(q, e), Scripted(lambda p: 'Answer: "the fair"')).collect()}
    assert said == {1: ("the fair", False), 2: ("", False)}
    away = A.read(A.prompts(q, e), Scripted(lambda p: "NOT_FOUND here")).where("qid = 1").first()
    assert (away.answer, away.abstained) == ("", True)
    why = A.read(A.prompts(q, e, cfg=A.ReaderConfig("reason")), Scripted(lambda p: "so and so\nANSWER: two"), A.ReaderConfig("reason")).where("qid = 1").first()
    assert why.answer == "two" and why.reasoning.startswith("so")
    with pytest.raises(ValueError):
        A.prompts(q, e, cfg=A.ReaderConfig("loud"))


def test_judge_asks_once_and_again_and_caches(spark):
    rows = spark.createDataFrame([(1, "q", "g", "p"), (2, "q", "g", "p"), (3, "q", "g", " "), (4, "q", "g", "odd"), (5, "q", None, "p"), (6, "q", "g", "bad")], "qid int, question string, gold string, prediction string")

    def reply(p):
        said = p.partition("ANSWER: ")[2].split("\n")[0]
        return {"p": 'so: {"verdict": "correct", "reason": "same"}', "bad": "It is WRONG."}.get(said, "hm")

    scored, cache = J.judge(rows, Scripted(reply))
    assert {r.qid: r.judge for r in scored.collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: None, 5: 0.0, 6: 0.0}
    assert cache.count() == 2
    again, _ = J.judge(rows, Scripted(lambda p: "hm"), cache)
    assert {r.qid: r.judge for r in again.collect()}[1] == 1.0
    files = spark.createDataFrame([("a.json",), ("a.j2.json",), ("b.json",)], "file string")
    assert {(r.file, r.read) for r in J.preferred_files(spark, files).collect()} == {("a.json", "a.j2.json"), ("b.json", "b.json")} and J.judged_path("x/a.json") == "x/a.j2.json"


def test_planner_steps_and_fallback(spark):
    q, maps = asked(spark, "who?", "when?"), spark.createDataFrame([("c", "few turns")], "conv_id string, map string")
    steps = [{"id": "a", "terms": "x"}, {"terms": " "}, {"question": "y?"}, {"scan_terms": "z", "inspect_question": "w"}, {"terms": "late"}]

    def reply(p):
        return json.dumps({"needs_multiple_moments": False, "steps": steps}) if "who?" in p else "none"

    got = [(r.qid, r.step, r.terms, r.question, r.from_model) for r in P.plan(q, maps, Scripted(reply)).orderBy("qid", "step").collect()]
    assert got == [(1, 1, "x", "x", True), (1, 2, "y?", "y?", True), (1, 3, "z", "w", True), (2, 1, "when?", "when?", False)]
    assert P.plan(q, maps, Scripted(reply), P.PlannerConfig("adaptive")).where("qid = 1").count() == 1


def test_consolidation_supersedes_and_records_conflicts(spark):
    e = spark.createDataFrame(
        [("c", "e1", 0, "one", "2023-01-01", ["Ann"], ["D1"]), ("c", "e2", 1, "two", "2023-02-01", ["Ann"], ["D2"]), ("c", "e3", 2, "three", "2023-03-01", ["Ann"], ["D3"])],
        "conv_id string, episode_id string, seq bigint, text string, stamp string, speakers array<string>, evidence_ids array<string>",
    )
    said = {"one": "Ann works as a baker in town", "two": "Ann works as a baker in Rome", "three": "Ann works as a baker in Oslo"}

    def reply(p):
        if "SESSION:" in p:
            text = p.partition("SESSION:\n")[2].split("\n")[0]
            assert ("ALREADY KNOWN" in p) == (text != "one")
            return json.dumps({"notes": [{"subject": "Ann", "attribute": "Job", "statement": said[text], "event_time": "null"}, {"subject": "", "statement": "x"}, {"subject": "Bo"}]})
        assert "EARLIER (2023-0" in p
        return json.dumps({"relations": [{"pair": "1", "relation": "update" if "Rome" in p and "Oslo" not in p else "conflict", "reason": "r"}]})

    made, conflicts, ops = K.consolidate(e, Scripted(reply))
    got = {r.statement: (r.status, r.valid_until, r.attribute, r.evidence_ids) for r in made.collect()}
    assert got[said["one"]] == ("superseded", "2023-02-01", "job", ["D1"]) and got[said["three"]][0] == "active"
    assert {(r.statement_a, r.statement_b) for r in conflicts.collect()} == {(said["two"], said["three"])} and {r.op: r["count"] for r in ops.collect()} == {"update": 1, "conflict": 1}
    # the same pair in review, judged without a model: a stateful attribute is an update
    ids = {r.statement: r.note_id for r in made.collect()}
    queue = spark.createDataFrame([(ids[said["two"]], ids[said["three"]]), (ids[said["one"]], ids[said["two"]])], "id_a string, id_b string")
    fixed, _, ops = K.reconcile_queue(queue, made, None)
    assert {r.op: r["count"] for r in ops.collect()} == {"update": 1} and fixed.where("status = 'active'").count() == 1
    packs = spark.createDataFrame([(7, ids[said["three"]])], "qid int, note_id string")
    assert O.conflicts_of(conflicts, packs).count() == 1
    empty, none, ops = K.consolidate(e.where("1 = 0"), Scripted(reply))
    assert empty.count() == none.count() == ops.count() == 0


def test_consolidation_runs_as_many_jobs_for_any_number_of_sessions(spark):
    schema = "conv_id string, episode_id string, seq bigint, text string, stamp string, speakers array<string>, evidence_ids array<string>"

    def reply(p):
        return json.dumps({"notes": [{"subject": "Ann", "attribute": "Job", "statement": p.partition("SESSION:\n")[2].partition("\n")[0]}]})

    jobs, context = {}, spark.sparkContext
    for n in (2, 30):
        rows = [(c, f"{c}{i}", i, f"Ann works as a baker in town {i}", f"2023-{i:02d}", ["Ann"], []) for c in ("c", "d") for i in range(n)]
        group = f"consolidate-{n}"
        e = spark.createDataFrame([*rows, (None, "x", 0, "Ann works as a baker", "2023-01", ["Ann"], [])], schema)
        context.setJobGroup(group, "consolidation")
        made, _, ops = K.consolidate(e, Scripted(reply), K.ConsolidationConfig(use_model=False))
        got = sorted((r.conv_id or "", r.order, r.status, r.valid_until) for r in made.collect())
        context.setLocalProperty("spark.jobGroup.id", None)
        jobs[n] = len(context.statusTracker().getJobIdsForGroup(group))
        last = [("active", None) if i == n - 1 else ("superseded", f"2023-{i + 1:02d}") for i in range(n)]
        assert got == [("", 0, "active", None)] + [(c, 8 * i, *last[i]) for c in ("c", "d") for i in range(n)]
        assert {r.op: r["count"] for r in ops.collect()} == {"update": 2 * n - 2}
    assert 0 < jobs[30] <= jobs[2] + 3


def test_items_outside_spark_are_those_of_spark(spark):
    found = [
        '{"notes": [{"a": "x", "b": 1.50}, {"a": {"k": [1, 2]}, "b": true}, "{\\"a\\": \\"in text\\"}", " {\\"b\\": null}", "x", 3, null, [1], {}]}',
        '{"notes": {"a": "x"}}', '{"notes": "x"}', '{"notes": null}', '{"notes": []}', "{}", '{"more": [1], "notes" : [ {"a" : "é\\n", "c": [] } ] }', None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "i int, t string")
    got = {r.i: [x.asDict() for x in r.n] for r in df.select("i", items_of(F.col("t"), "notes", "a string, b string").alias("n")).collect()}
    assert got == {i: items_in(t, "notes", ["a", "b"]) for i, t in enumerate(found)}


def test_adjudication_batches_and_falls_back(spark):
    notes = spark.createDataFrame([(f"n{i}", f"s{i}", None, "2020") for i in range(6)], "note_id string, statement string, event_time string, recorded_time string")
    pairs = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}", "independent") for i in range(5)], "group string, old_id string, new_id string, fallback string")
    calls = []

    def reply(p):
        calls.append(p)
        return json.dumps({"relations": [{"pair": 1, "relation": "SAME"}, {"pair": 2, "relation": "odd"}, "x"]}) if "s0" in p else "broken"

    got = {r.old_id: (r.relation, r.reason) for r in K.adjudicate(pairs, notes, Scripted(reply), K.ConsolidationConfig(most_pairs=2)).collect()}
    assert got["n0"] == ("same", "") and got["n1"][0] == "independent" and got["n4"] == ("independent", "missing") and len(got) == 5


def test_summaries_keep_the_largest_groups(spark):
    rows = [("c", g, f"e{g}{i}", g * 100 + i, f"Bo says: word {i}", "2023-01-01") for g, n in ((1, 2), (2, 3), (3, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id string, group_id int, episode_id string, seq bigint, text string, stamp string")
    texts = df.select("episode_id", "seq", "text", "stamp")
    made = summarise_groups(df.select("conv_id", "group_id", "episode_id"), texts, Scripted(lambda p: f"A summary of {p.count(chr(10) + '- word')} excerpts.")).collect()
    assert {r.subject: (len(r.provenance), r.statement) for r in made} == {"group 0": (40, "A summary of 14 excerpts."), "group 1": (3, "A summary of 3 excerpts.")}
    assert all(r.evidence_ids == [] for r in made) and summarise_groups(df.select("conv_id", "group_id", "episode_id"), texts, Scripted(lambda p: "short")).count() == 0
    assert summarise_groups(df.select("conv_id", "group_id", "episode_id"), texts, Scripted(lambda p: "x" * 30), most=1).count() == 1


def test_engine_end_to_end(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path / "layer"), RetrievalConfig(scan_top_k=5, top_k=7))
    engine.check()
    e = spark.createDataFrame([("c", f"e-{i}", i, t, "s", "2023-05-08", ["Ann"], [f"D{i}"]) for i, t in enumerate(TEXTS)], "conv_id string, episode_id string, seq bigint, text string, session string, stamp string, speakers array<string>, evidence_ids array<string>")
    engine.remember(e.where("seq < 3"))
    engine.remember(e)  # what is there is left as it is
    assert engine.parts()["episodes"].count() == 5 and engine.parts()["corpus"].first().n_docs == 5
    q = asked(spark, "which owl flies high?").withColumn("gold", F.lit("green owl flies high")).withColumn("category", F.lit(4))
    scored, by = engine.evaluate(q)
    assert scored.first().answer and by.where("category = 'overall'").count() == 2
    engine.model = Scripted(lambda p: json.dumps({"notes": [{"subject": "Ann", "attribute": "pet", "statement": "Ann saw a green owl."}]}) if "SESSION:" in p else "green owl")
    engine.consolidate()
    got = engine.ask(asked(spark, "what did Ann see?")).first()
    assert got.answer == "green owl" and got.retrieved and got.from_notes
