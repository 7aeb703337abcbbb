"""Operators on micro-inputs, properties, and the contract of the entry module."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.operators import episodes as E
from recallspark.operators import evaluation as V
from recallspark.operators import grouping as G
from recallspark.operators import ranking as R
from recallspark.operators import segmentation as S
from recallspark.operators.fusion import fuse, hybrid_search, minmax
from recallspark.operators.lexical import bm25
from recallspark.operators.views import with_seq
from recallspark.sources import dialogues, store


def test_minmax_of_a_constant_list_is_one(spark):
    rows = spark.createDataFrame([("q", 0.0), ("q", 0.0), ("r", 1.0), ("r", 3.0)], "qid string, s double")
    assert sorted(r.m for r in rows.select(minmax(F.col("s")).alias("m")).collect()) == [0.0, 1.0, 1.0, 1.0]


def test_bm25_ignores_row_order_and_keeps_empty_documents(spark):
    docs = [("c", f"e-{i}", t) for i, t in enumerate(["red fox", "red red hen", "", None, "blue"])]
    asked = spark.createDataFrame([("q", "c", "red fox")], "qid string, conv_id string, terms string")
    score = lambda d: {r.episode_id: round(r.lex, 9) for r in bm25(asked, spark.createDataFrame(d, "conv_id string, episode_id string, text string")).collect()}
    a, b = score(docs), score(docs[::-1])
    assert a == b and set(a) == {"e-0", "e-1"} and a["e-0"] > a["e-1"]


def test_hybrid_handles_missing_vectors(spark):
    docs = spark.createDataFrame([("c", "e-1", "red fox", [1.0, 0.0]), ("c", "e-2", "hen", None), ("c", "e-3", "x", [0.0, 0.0]), ("c", "e-4", "y", [1.0])], "conv_id string, episode_id string, text string, embedding array<float>")
    asked = spark.createDataFrame([("q", "c", "hen", [1.0, 0.0])], "qid string, conv_id string, terms string, vector array<float>")
    found = hybrid_search(asked, docs, 5, 5, dim=2).collect()
    assert {r.episode_id for r in found} == {"e-1", "e-2"}
    with pytest.raises(ValueError):
        fuse(docs, "none")


def test_packs_and_pools(spark):
    rows = [("q", "episode", i, float(10 - i)) for i in range(4)] + [("q", "note", 9, 0.5), ("q", "note", 8, 7.5)]
    c = spark.createDataFrame(rows, "qid string, kind string, id int, score double")
    ids = lambda df: [r.id for r in df.orderBy("place").collect()]
    assert ids(R.pack_compete(c, 3)) == [0, 1, 2]
    assert ids(R.pack_additive(c, 2, 1)) == [0, 1, 8]
    assert ids(R.pack_slots(c, 3, 1)) == [8, 0, 1]
    lists = spark.createDataFrame([("q", 1, 5, 9.0), ("q", 1, 6, 8.0), ("q", 2, 6, 9.0), ("q", 2, 7, 1.0)], "qid string, list_no int, id int, score double")
    assert [r.id for r in R.pool_round_robin(lists, 3).orderBy("rank").collect()] == [5, 6, 7]
    z = {r.id: r.z for r in R.zscore_by_kind(c).collect()}
    assert z[9] == 0.5 and abs(sum(z[i] for i in range(4))) < 1e-9


def test_sequence_numbers_and_neighbours(spark):
    docs = with_seq(spark.createDataFrame([("c", f"e-{i:07d}") for i in (5, 30_001, 12_000, 9_999)] + [("d", "x")], "conv_id string, episode_id string"))
    assert {(r.episode_id, r.seq) for r in docs.collect()} == {("e-0000005", 0), ("e-0009999", 1), ("e-0012000", 2), ("e-0030001", 3), ("x", 0)}
    all_ = docs.select("conv_id", "seq", F.lit("s").alias("session"), F.col("episode_id").alias("id"))
    got = R.neighbours(all_.where("seq = 1").select(F.lit("q").alias("qid"), "conv_id", "seq", "session"), all_, 1)
    assert sorted(r.seq for r in got.collect()) == [0, 1, 2]


def brute_tiles(u):
    n = len(u)
    w = max(3, round(n**0.5 / 2))
    if n < 4 * w:
        return []
    gaps = []
    for i in range(w, n - w + 1):
        a, b = u[i - w : i].mean(0), u[i : i + w].mean(0)
        gaps.append(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    depth = []
    for i, g in enumerate(gaps):
        lo = hi = i
        while lo > 0 and gaps[lo - 1] >= gaps[lo]:
            lo -= 1
        while hi < len(gaps) - 1 and gaps[hi + 1] >= gaps[hi]:
            hi += 1
        depth.append(gaps[lo] + gaps[hi] - 2 * g)
    cut = np.mean(depth) + np.std(depth) / 2
    return [i + w for i, x in enumerate(depth) if x > cut and (i == 0 or x >= depth[i - 1]) and (i == len(depth) - 1 or x >= depth[i + 1])]


@pytest.mark.parametrize("n", [11, 12, 40])
def test_tiles_against_the_direct_way(spark, n):
    rng = np.random.default_rng(n)
    u = rng.normal(size=(n, 4))
    u[n // 2 :] += 2
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = spark.createDataFrame([("c", i, u[i].tolist()) for i in range(n)], "conv_id string, pos bigint, vector array<double>")
    segments = [r.segment for r in S.tile_segments(rows).orderBy("pos").collect()]
    cuts = [i for i in range(1, n) if segments[i] != segments[i - 1]]
    assert cuts == brute_tiles(u)


def test_utterance_segments():
    long = "a " * 300
    cfg = E.SegmentConfig()
    assert E.cut_points([(long, None, False)] * 4, cfg) == [0, 0, 1, 1]
    assert E.cut_points([("x", 0, False), ("y", 300, False), ("z", 600.5, False)], cfg) == [0, 0, 1]
    assert E.cut_points([("x", 0, False), ("i", 1, True), ("y", 2, False)], cfg) == [0, 1, 2]
    assert E.cut_points([], cfg) == []


def test_percentiles_round_half_to_even(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(6)] + [("a", None), ("b", 1.0)], "k string, v double")
    got = {r.k: (r.p50, r.n) for r in V.exact_percentiles(rows, "v", [50], "k").collect()}
    assert got == {"a": (2.0, 6), "b": (1.0, 1)}


def test_bootstrap_brackets_the_mean(spark):
    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(200)], "k string, v double").withColumn("id", F.monotonically_increasing_id())
    r = V.bootstrap_ci(rows, "v", "k", 100).first()
    assert r.ci_low < 2.98 < r.ci_high


def test_communities(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (7, 8, 1.0)], "src bigint, dst bigint, weight double")
    got = {r.id: r.group_id for r in G.communities(edges, 4).collect()}
    assert got[1] == got[2] == got[3] != got[7]


SAMPLES = [
    {
        "qa": [{"question": "Who?", "answer": 7, "evidence": ["D1:1"], "category": 1}, {"question": "No?", "adversarial_answer": "x", "category": 5}],
        "conversation": {
            "speaker_a": "Ann", "session_1": [{"speaker": "Ann", "dia_id": "D1:1", "text": "hi", "img_url": "u", "blip_caption": "cat"}, {"speaker": "Bo", "dia_id": "D1:2"}],
            "session_1_date_time": "1:00 pm on 8 May, 2023", "session_2": [], "session_2_date_time": "x", "session_3": [{"speaker": "Ann", "dia_id": "D3:1", "text": "lost"}],
        },
    }
]


def test_dialogue_source_and_layer(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(SAMPLES))
    samples = dialogues.read_samples(spark, str(path))
    rows = dialogues.turns(samples).orderBy("global_seq").collect()
    assert [(r.text, r.has_image) for r in rows] == [("[Image: cat] hi", True), ("", False)]
    assert [r.gold for r in dialogues.questions(samples).orderBy("n").collect()] == ["7", "x"]
    eps = dialogues.to_episodes(dialogues.turns(samples))
    assert eps.where("global_seq = 0").first().raw_text == "DATE: 1:00 pm on 8 May, 2023 | Speaker Ann says: [Image: cat] hi"
    assert dialogues.statistics(samples).first().turns == 2
    store.save_layer(str(tmp_path / "layer"), eps.select("conv_id", "episode_id", F.col("raw_text").alias("text")))
    layer = store.load_layer(spark, str(tmp_path / "layer"))
    assert layer["episodes"].count() == 2 and layer["postings"].count() > 0 and layer["corpus"].first().n_docs == 2
    with pytest.raises(FileNotFoundError):
        store.load_layer(spark, str(tmp_path / "none"))


def test_entry_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "p3_found" in queries
    assert entry.entry(spark).columns == ["qid", "episode_id", "rank", "lex", "sem", "score"]
