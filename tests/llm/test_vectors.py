"""The vector search against brute force and on awkward rows."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm.neighbours import Config, exact_search, fit, fit_cells, group_cells, joined, nearest_neighbours, neighbour_pairs, probed_cells, set_copies_apart

SMALL = Config(dim=8, subspaces=4, codewords=16, rows_per_cell=64, shortlist=60, shard_rows=128, max_copies=20, k=5)
SCHEMA = "id string, embedding array<float>, kind string, shard int, near string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)


def brute(rows, k):
    seen = {i: np.array(v, float) for i, v in rows}
    ids = sorted(seen)
    u = np.array([seen[i] / np.linalg.norm(seen[i]) for i in ids])
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {ids[i]: {ids[j] for j in np.argsort(-s[i], kind="stable")[:k]} for i in range(len(ids))}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(f"v{i:04d}", (centres[i % 12] + 0.3 * rng.normal(size=8)).astype("float32").tolist()) for i in range(600)]
    truth = brute(rows, 5)
    got = {r.id: {n.id for n in r.near} for r in nearest_neighbours([frame(spark, rows + rows[:50])], SMALL).collect()}
    assert set(got) == set(truth) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[i] & truth[i]) / 5 for i in truth]) >= 0.9
    asked = frame(spark, rows[:7])
    exact = {r.id: {n.id for n in r.near} for r in exact_search(asked, frame(spark, rows), 5, 8, block=3).collect()}
    assert exact == {i: truth[i] for i, _ in rows[:7]}


def test_regions_give_the_same_lists(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(f"v{i:04d}", (centres[i % 12] + 0.3 * rng.normal(size=8)).astype("float32").tolist()) for i in range(900)]
    truth = brute(rows, 5)
    many = replace(SMALL, rows_per_cell=32, max_cells=8, train_per_cell=64)  # 256 rows a model: four regions
    few = [(f"w{i}", rows[i][1]) for i in range(20)]  # beside a table that needs one model
    lists = nearest_neighbours([frame(spark, rows + [("x", None), (None, rows[0][1])]), frame(spark, few)], many).collect()
    got = {r.id: {n.id for n in r.near} for r in lists}
    assert set(got) == set(truth) | {i for i, _ in few} and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[i] & truth[i]) / 5 for i in truth]) >= 0.9
    assert all(n[0] == i[0] for i, near in got.items() for n in near)


def test_regions_write_a_vector_once_a_shard(spark, monkeypatch):
    from recallspark.llm import neighbours

    rng = np.random.default_rng(4)
    rows = [(f"v{i:04d}", rng.normal(size=8).astype("float32").tolist()) for i in range(900)]
    stored = []
    monkeypatch.setattr(neighbours, "stash", lambda df, label="t": stored.extend(df.columns) or df)
    lists = nearest_neighbours([frame(spark, rows)], replace(SMALL, rows_per_cell=32, max_cells=8, train_per_cell=64))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in stored and "CoGroups" not in plan  # no copy of the vectors beside those at their shards
    # regions that all vectors are near to: the probes are chosen over all of them
    x = np.array([v for _, v in rows], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cfg = replace(SMALL, probe_margin=9.0, max_probes=6)
    model = joined(np.zeros((4, 8), np.float32), [fit_cells(x[i::4], 225, replace(cfg, rows_per_cell=16, seed=i)) for i in range(4)], cfg)
    top, use = probed_cells(x, model, cfg)
    score = x @ model.centroids.T - 0.5 * (model.centroids**2).sum(1)
    assert use.all() and top.shape == (900, 6)
    assert np.allclose(np.take_along_axis(score, top, 1), -np.sort(-score, axis=1)[:, :6], atol=1e-5)


def test_unusable_rows_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0] * 8), ("b", [2.0] * 8), ("c", None), ("d", [0.0] * 8), ("e", [nan] + [1.0] * 7), ("f", [inf] + [1.0] * 7), ("g", [1.0]), ("h", [None] + [1.0] * 7), (None, [1.0] * 8), ("i", [1e-30] * 8)]
    got = {r.id: [n.id for n in r.near] for r in nearest_neighbours([frame(spark, rows)], SMALL).collect()}
    assert got == {"a": ["b", "i"], "b": ["a", "i"], "i": ["a", "b"]}
    assert nearest_neighbours([frame(spark, [])], SMALL).count() == 0
    assert nearest_neighbours([frame(spark, rows[:1])], SMALL).count() == 0


def test_hot_copies_stay_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(f"v{i:04d}", rng.normal(size=8).astype("float32").tolist()) for i in range(60)] + [(f"w{i:04d}", [1.0] * 8) for i in range(100)]
    lists = nearest_neighbours([frame(spark, rows)], SMALL)
    got = {r.id: [(n.id, -n.far) for n in r.near] for r in lists.collect()}
    assert len(got) == 160 and all(len(v) == 5 for v in got.values())
    for i in range(100):
        assert all(n.startswith("w") and n != f"w{i:04d}" and c == pytest.approx(1.0) for n, c in got[f"w{i:04d}"])
    pairs = neighbour_pairs(lists).collect()
    assert len({(p.id_a, p.id_b) for p in pairs}) == len(pairs) and all(p.id_a < p.id_b for p in pairs)


def test_hot_copies_leave_the_vectors_in_place(spark):
    rows = [(None, [1.0] * 8)] + [(f"v{i}", [float(i + 2)] + [1.0] * 7) for i in range(9)] + [(f"w{i:04d}", [1.0] * 8) for i in range(100)]
    df = frame(spark, rows).select("id", "embedding")
    hot = df.groupBy(F.lit(0).alias("kind"), F.xxhash64("embedding").alias("print")).count().where("count > 20")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (kept,), tails = set_copies_apart([df], hot, SMALL)
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in kept.collect()) == [f"v{i}" for i in range(9)] + [f"w{i:04d}" for i in range(6)]
        assert tails.count() == 94 and all([n.id for n in r.near] == [f"w{i:04d}" for i in range(5)] for r in tails.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shards_are_bounded():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(50, 8)).astype("float32")
    shard = group_cells(c, np.full(50, 0.02), 0.1)
    assert np.bincount(shard).max() <= 5 and len(np.unique(shard)) >= 10
    model = fit(np.ones((10, 8), "float32"), 1_000_000, SMALL)
    assert model.blocks.max() > 1  # a shard no cut can divide is searched in blocks


def test_queries_of_the_tables(spark):
    from recallspark.llm.neighbours_queries import p1_found

    found = p1_found(spark, "/root/testdata/sf0.001")
    assert found.columns == ["kind", "id_a", "id_b"] and found.where(F.col("id_a") >= F.col("id_b")).count() == 0
