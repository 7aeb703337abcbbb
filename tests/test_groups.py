"""Grouping methods, their reports, and the tree, against plain ways."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.models import HashEncoder, Scripted
from recallspark.operators import episodes as E
from recallspark.operators import group_methods as M
from recallspark.operators import tree as T


def blobs(k=4, n=30, d=5, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([c + 0.1 * rng.normal(size=(n, d)) for c in rng.normal(size=(k, d)) * 5]), np.repeat(np.arange(k), n)


def same(labels, truth):
    return len({(a, b) for a, b in zip(labels, truth)}) == len(set(truth)) == len(set(labels))


def test_ward_and_density_find_separate_groups():
    x, truth = blobs()
    assert same(M.ward_labels(x, np.ones(len(x))), truth)
    far = np.vstack([x, [[100.0] * 5]])
    found = M.density_labels(far, np.ones(len(far)), 5)
    assert found[-1] == -1 and same(found[:-1][found[:-1] >= 0], truth[found[:-1] >= 0]) and (found[:-1] >= 0).mean() > 0.8
    assert (M.ward_labels(x[:3], np.ones(3)) == 0).all() and (M.density_labels(x[:3], np.ones(3), 5) == -1).all()


def test_ward_merges_like_the_direct_way():
    x = np.random.default_rng(2).normal(size=(25, 3))
    groups, heights = [[i] for i in range(25)], []
    while len(groups) > 1:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        best = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        heights.append(np.sqrt(2 * cost(groups[best[0]], groups[best[1]])))
        groups[best[1]] += groups.pop(best[0])
    gap = int(np.argmax(np.diff(heights)))
    assert len(set(M.ward_labels(x, np.ones(25)))) == 25 - gap - 1


def test_rows_beyond_the_centres_are_all_placed(spark):
    x, truth = blobs(3, 60)
    rows = spark.createDataFrame([(f"k{i:03}", v.tolist()) for i, v in enumerate(x)], "key string, x array<double>")
    centres, weight, placed = M.micro_centres(rows, "key", most=20)
    assert placed.count() == 180 and weight.sum() == 180 and len(centres) <= 20
    got = {r.key: r.label for r in M.by_centre(placed, M.ward_labels(centres, weight), "key").collect()}
    assert all(len({got[f"k{i:03}"] for i in np.flatnonzero(truth == b)}) == 1 for b in range(3)) and len(set(got.values())) > 1


def test_modularity_finds_cliques(spark):
    edges = [(i, j, 1.0) for base in (0, 10, 20) for i in range(base, base + 6) for j in range(base, i)] + [(5, 10, 1.0), (15, 20, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = M.modularity_communities(df, levels=2, rounds=6)
    got = {r.id: r.group_id for r in found.collect()}
    assert same([got[i] for i in sorted(got)], [i // 10 for i in sorted(got)]) and min(got.values()) == 0
    one = M.modularity(df, df.select(F.col("src").alias("id")).union(df.select("dst")).distinct().withColumn("group_id", F.lit(0)))
    assert M.modularity(df, found) > 0.5 and one == pytest.approx(0)
    assert M.modularity_communities(df.where("1 = 0")).count() == 0


def test_topics_outline_and_aliases(spark):
    docs = spark.createDataFrame([("c", f"e{i}", i, f"word {i}") for i in range(10)], "conv_id string, episode_id string, seq long, text string")
    topics = M.propose_topics(docs, Scripted(lambda p: json.dumps({"topics": ["a trip", " a trip", "", "x" * 200]})))
    assert [r.label for r in topics.collect()] == ["a trip"]
    assert M.distinct_topics(["red fox", "red fox", "blue"], HashEncoder()) == ["red fox", "blue"]
    spans = M.outline_groups(docs, Scripted(lambda p: '{"spans": [[3, "two"], {"start": 7, "label": "three"}, ["x"], [99, "no"]]}'))
    got = {r.episode_id: r.label for r in spans.collect()}
    assert len(got) == 10 and got["e0"] == got["e5"] == "two" and got["e6"] == got["e9"] == "three"
    assert M.outline_groups(docs, Scripted(lambda p: "no")).count() == 0
    pairs = spark.createDataFrame([("c", "Jon", "Jonathan"), ("c", "Mel", "Melanie"), ("c", "Jonathan", "Jonathans")], "conv_id string, short string, long string")
    said = '{"pairs": [{"n": 1, "same": true, "canonical": "Jonathan"}, {"n": 2, "same": true, "canonical": "Jonathans"}, {"n": 3, "same": true, "canonical": "Bob"}]}'
    judged = M.judged_aliases(pairs, Scripted(lambda p: said))
    assert {(r.short, r.canonical) for r in judged.collect()} == {("Jon", "Jonathan"), ("Jonathan", "Jonathans")}
    assert {(r.name, r.canonical) for r in M.collapse_aliases(judged).collect()} == {("Jon", "Jonathans"), ("Jonathan", "Jonathans")}


def test_index_reports_and_registry(spark):
    members = spark.createDataFrame([("c", 0, "t", "e1"), ("c", 0, "t", "e2"), ("c", 1, None, "e3")], "conv_id string, group_id int, label string, episode_id string")
    names = spark.createDataFrame([("c", "Ann", "e1"), ("c", "Anna", "e2"), ("c", "Bo", "e1")], "conv_id string, name string, episode_id string")
    canonical = spark.createDataFrame([("c", "Ann", "Anna")], "conv_id string, name string, canonical string")
    index = M.group_index(members, M.entity_members(names, canonical)).persist()
    assert {(r.group_id, r.episode_id) for r in index.collect()} == {("topic-0", "e1"), ("topic-0", "e2"), ("topic-1", "e3"), ("entity-anna", "e1"), ("entity-anna", "e2")}
    dirty = M.mark_dirty(index, spark.createDataFrame([("e1",)], "episode_id string"))
    assert {(r.group_id, r.new_since) for r in M.mark_dirty(index, spark.createDataFrame([("e3",), ("e1",)], "episode_id string"), dirty).collect()} == {("topic-0", 2), ("topic-1", 1), ("entity-anna", 2)}
    d = M.diagnostics(spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "k string, group_id int"), "k").first()
    assert (d.groups, d.largest, d.memberships, d.shared) == (2, 2, 1.5, 0.5)
    x, truth = blobs()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, embedding array<double>")
    groups = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "k long, group_id int")
    r = M.cohesion(groups, rows, "k").first()
    assert r.cohesion > 0.9 and r.gap > 0.3 and r.n_scored == 4
    assert len(M.METHODS) == 13 and sum(needs for _, needs in M.METHODS.values()) == 5
    assert same([r.group_id for r in M.METHODS["agglom"][0](rows, "k").orderBy("k").collect()], truth)
    hard = M.hard_groups(spark.createDataFrame([(1, -1), (2, 0)], "k int, label int"), "k").collect()
    assert [(r.k, r.group_id) for r in hard] == [(2, 0)]


def test_tree_splits_and_keeps_everything(spark):
    texts = ["harbour boats and sails today.", "garden roses and tulips bloom.", "harbour boats leave early.", "garden tulips need water."] * 8
    docs = spark.createDataFrame([("c", f"e{i:02}", i, t, f"2023-01-{i % 28 + 1:02}", i % 5 == 0) for i, t in enumerate(texts)], "conv_id string, episode_id string, seq long, text string, stamp string, image boolean")
    nodes = T.routing_tree(docs).persist()
    rows = nodes.collect()
    leaves = [r for r in rows if r.kind == "leaf"]
    assert sorted(e for r in leaves for e in r.episode_ids) == [f"e{i:02}" for i in range(32)]
    assert all(len(r.episode_ids) <= T.LEAF for r in leaves)
    children = {r.node: sum(x.parent == r.node for x in rows) for r in rows if r.kind == "region"}
    assert max(children.values()) <= T.FAN_OUT and sum(r.parent is None for r in rows) == 1
    root = next(r for r in rows if r.parent is None)
    assert (root.first_seq, root.last_seq, root.images) == (0, 31, 7) and "harbour" in root.anchors
    assert T.depth(nodes).first().depth == max(r.level for r in rows) + 1 and T.descend(docs, nodes).count() == 32
    lines = [r.line for r in T.printed(nodes).orderBy("line_no").collect()]
    assert len(lines) == len(rows) and lines[0].startswith("region") and lines[1].startswith("  ")
    assert {r.block for r in T.routing_tree(docs, block=10).collect()} == {0, 1, 2, 3}
    assert T.routing_tree(docs.where("1 = 0")).count() == 0


def test_sequence_tree_has_one_root_whatever_the_length(spark):
    docs = spark.range(20_000).select(F.lit("c").alias("conv_id"), F.col("id").alias("seq")).union(spark.range(5).select(F.lit("d"), F.col("id")))
    rows = E.sequence_tree(docs).where("parent is null").collect()
    assert {(r.conv_id, r.episodes) for r in rows} == {("c", 20_000), ("d", 5)}
    assert E.sequence_tree(docs.where("1 = 0")).count() == 0


def test_episodes_from_utterances(spark):
    rows = [("c", "s", 0, 2, "b", None, "2023-01-02", "D2", "i.jpg", None), ("c", "s", 0, 1, "A b", "Ann", "2023-01-03", "D1", None, "cap"), ("c", "s", 0, 3, None, "Ann", None, None, None, None)]
    u = spark.createDataFrame(rows, "conv_id string, session_id string, segment int, n int, text string, speaker string, timestamp string, dia_id string, image_path string, dataset_caption string")
    e = E.from_utterances(u).first()
    assert (e.raw_text, e.token_count, e.timestamp, e.image_path, e.image_caption_detailed) == ("A b b ", 3, "2023-01-02", "i.jpg", "cap")
    assert e.speakers == ["Ann", "Unknown"] and e.episode_speakers == ["Ann", "Unknown", "Ann"] and e.evidence_ids == ["D1", "D2"]
    one = E.construct(spark.createDataFrame([("c", 0, "Hi, there!", "D1")], "conv_id string, seq long, text string, dia_id string"), "2024-01-01T00:00:00").first()
    assert (one.normalized_text, one.token_count, one.evidence_ids, one.timestamp) == ("hi there", 2, ["D1"], "2024-01-01T00:00:00")
