"""Whole jobs against the direct way: what a cut would lose."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from recallspark.functions import text as T
from recallspark.operators import grouping as G
from recallspark.operators import history as H
from recallspark.operators import lexical as L
from recallspark.operators import search_queries as Q
from recallspark.plans.retrieve import RetrievalConfig, retrieve


def test_fuzzy_search_counts_tokens_behind_the_twelfth(spark, tmp_path):
    names = [f"w{c}{c}{c}{c}{c}{c}{c}" for c in "abcdefghijklmnop"]
    rows = [("c", "e-100", " ".join(names)), ("c", "e-101", names[0]), ("c", "e-102", " ".join(names[12:]))]
    rows = [(*r, None, datetime(2024, 1, 1)) for r in rows]
    schema = "conv_id string, episode_id string, raw_text string, episode_utterances array<string>, ingested_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "episodes.parquet"))
    got = {r.episode_id: (r["rank"], r.overlap) for r in Q.fuzzy_search(spark, str(tmp_path)).collect()}
    assert got == {"e-100": (1, 1.0), "e-102": (2, 0.25), "e-101": (3, 0.0625)}


def test_fuzzy_blocks_give_the_expression_s_scores(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abé"), rng.integers(1, 9)))
    rows = [("c", f"e-{i:03}", " ".join(word() for _ in range(rng.integers(0, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "conv_id string, episode_id string, text string").withColumn("t", F.array_distinct(T.tokens(F.col("text"))))
    stems = docs.select("conv_id", "episode_id", F.transform("t", T.stem).alias("s"))
    q = stems.where("episode_id < 'e-020'").select(F.col("episode_id").alias("qid"), "conv_id", F.col("s").alias("want"))
    got = L.fuzzy_top(q, stems.withColumnRenamed("s", "have"), 10, block=7, asked=5)
    asked = docs.where("episode_id < 'e-020'").select(F.col("episode_id").alias("qid"), "conv_id", F.col("t").alias("want"))
    pairs = asked.join(docs, "conv_id").withColumn("overlap", F.round(T.fuzzy_overlap(F.col("want"), F.col("t")), 9))
    right = L.top_k(pairs, "overlap", 10, ["episode_id"])
    rows_of = lambda df: sorted(map(tuple, df.select("qid", "rank", "episode_id", "overlap").collect()))
    assert rows_of(got) == rows_of(right) and got.count() == 200


def test_mutual_neighbours_cross_labels_and_blocks(spark):
    v = np.random.default_rng(1).normal(size=(70, 5)).round(1)
    v[9] = v[3]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    near = {i: sorted((j for j in range(70) if j != i), key=lambda j: (-sim[i, j], j))[:6] for i in range(70)}
    want = {(i, j) for i in near for j in near[i] if i < j and i in near[j] and sim[i, j] > 0}
    rows = spark.createDataFrame([(i, i % 7, v[i].tolist()) for i in range(70)], "vec_id bigint, label int, embedding array<float>")
    found = G.mutual_neighbours(rows, "vec_id", block=16).collect()
    assert {(r.vec_id, r.other) for r in found} == want and any(r.vec_id % 7 != r.other % 7 for r in found)


def test_mixture_finds_other_numbers_of_groups_and_all_variance(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 40)) * 20
    v = np.concatenate([c + rng.normal(size=(30, 40)) for c in centres])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, x array<double>")
    assert len(G.select_mixture(rows).means) == 6
    noise = rng.normal(size=(300, 40))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(noise)], "vec_id bigint, embedding array<double>")
    assert len(G.project(rows).first().x) > 32


def test_a_change_of_status_alone_is_kept(spark):
    schema = "conv_id string, note_id string, subject string, attribute string, statement string, event_time string, recorded_time string, valid_from string, valid_until string, status string, ingested_at timestamp"
    days = [("n1", "A", "2024-01-01", "active"), ("n2", "A", "2024-02-01", "superseded"), ("n3", "A", "2024-03-01", "superseded"), ("n4", "A", "2024-04-01", "active")]
    notes = spark.createDataFrame([("c", i, "Ann", "job", v, None, None, d, None, s, datetime(2024, 1, 1)) for i, v, d, s in days], schema)
    kinds = spark.createDataFrame([("job", True)], "attribute string, stateful boolean")
    found = {tuple(own): sorted((str(r.start), *[r[a] for a in own]) for r in rows.collect()) for own, rows in H.note_satellites(notes, kinds)}
    assert found == {
        ("value", "until"): [("2024-01-01", "a", None)],
        ("status",): [("2024-01-01", "active"), ("2024-02-01", "superseded"), ("2024-04-01", "active")],
    }
    assert [(str(r.start), r.end) for r in H.note_history(notes, kinds).collect()] == [("2024-01-01", None)]


def test_packs_have_their_neighbours(spark):
    texts = ["red fox", "blue hen", "green owl", "grey cat"]
    e = spark.createDataFrame([("c", f"e-{i}", t, "s" if i < 3 else "t") for i, t in enumerate(texts)], "conv_id string, episode_id string, text string, session string")
    q = spark.createDataFrame([(1, "c", "green owl")], "qid bigint, conv_id string, terms string")
    n = spark.createDataFrame([], "conv_id string, note_id string, text string, provenance array<string>")
    got = {r.id: (r.kind, r.place) for r in retrieve(q, e, n, RetrievalConfig(top_k=1, scan_top_k=1, prf_docs=0)).collect()}
    assert got == {"e-2": ("episode", 1), "e-1": ("neighbour", 2)}
