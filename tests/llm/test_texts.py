"""Splitting, packing and mixing against the direct way."""

from datetime import datetime

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recallspark.llm.mixing import mix, mix_report, quotas, settle
from recallspark.llm.packing import best_fit_decreasing, pack, packing_report
from recallspark.llm.splitting import TOKEN, bisect, split_episodes, split_text
from recallspark.llm.tokens import count_tokens, cut_to_capacity

WORDS = st.lists(st.sampled_from(["a", "Bb.", "c,", "d!\n\n", "e\n", " f", "St.", "g? "]), min_size=1, max_size=300)


@settings(max_examples=60, deadline=None)
@given(WORDS, st.integers(3, 40), st.integers(0, 2))
def test_cores_are_the_text(parts, limit, overlap):
    text = " ".join(parts)
    pieces = split_text(text, parts[:5], limit, overlap)
    n = len(TOKEN.findall(text))
    if pieces is None:
        assert n <= limit
        return
    assert "".join(text[p[0] : p[1]] for p in pieces) == text
    tokens = TOKEN.findall(text)
    at = 0
    for start, end, back, size, _, body in pieces:
        own = TOKEN.findall(text[start:end])
        assert size <= limit and len(TOKEN.findall(body)) == size == len(own) + back
        assert back == min(overlap, at) and TOKEN.findall(body)[:back] == tokens[at - back : at]
        at += len(own)


def test_cuts_prefer_strong_boundaries():
    import numpy as np

    power = np.zeros(100, np.int8)
    power[[30, 48, 70]] = [5, 2, 4]
    assert bisect(power, 60) == [0, 30, 70] or bisect(power, 75) == [0, 30]
    assert bisect(np.zeros(10, np.int8), 5) == [0, 5]


EPISODES = "episode_id string, conv_id string, raw_text string, episode_utterances array<string>, ingested_at timestamp, token_count int, piece_no int, text string"


def test_split_handles_odd_rows(spark):
    long = "word " * 900
    at = datetime(2024, 1, 1)
    rows = [
        ("a", "c", long, None, at, 3, 1, "x"), ("a", "c", long, None, datetime(2024, 1, 2), None, 1, "x"), ("b", "c", " \t", ["word " * 500, None, "tail " * 500], at, 1, 1, "x"),
        ("c", "c", None, None, at, 9999, 1, "x"), (None, "c", long, None, at, 1, 1, "x"), ("d", "c", "x" * 100_000, [], at, 1, 1, "x"),
        ("e", None, "word " * 800, None, None, 1, 1, "x"), ("f", "c", long, ["word word", "lost words"], at, 1, 1, "x"),
    ]
    got = split_episodes(spark.createDataFrame(rows, EPISODES)).toPandas()
    assert set(got.episode_id) == {"a", "b", "f"}
    assert (got.tokens <= 800).all() and (got[got.piece_no > 1].overlap_tokens == 50).all()
    assert got[got.episode_id == "f"].text.iloc[-1].endswith("lost words")
    assert (got[got.episode_id == "a"].n_pieces == len(got[got.episode_id == "a"])).all()
    assert split_episodes(spark.createDataFrame([], EPISODES)).count() == 0
    with pytest.raises(ValueError):
        split_episodes(spark.createDataFrame([], EPISODES), 10, 10)


def naive_bins(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 40))
def test_histogram_packing_is_item_by_item_packing(sizes, capacity):
    histogram = {s: sizes.count(s) for s in set(sizes)}
    plan, bins = best_fit_decreasing(histogram, capacity)
    rooms = [capacity] * bins
    for s, n in histogram.items():
        rows = [p for p in plan if p[0] == s]
        for rank in range(n):
            _, first, container, each = max((p for p in rows if p[1] <= rank), key=lambda p: p[1])
            rooms[container + (rank - first) // each] -= s
    assert all(r >= 0 for r in rooms) and sorted(rooms) == naive_bins(sizes, capacity)


def test_pack_whole_texts(spark):
    texts = ["one two three", None, "", "  ", "one two three", "long word " * 400, "é" * 50] + ["w " * n for n in range(1, 60)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, container string, tokens int")
    got = pack(docs, 128).toPandas()
    assert got.groupby("container").tokens.sum().max() <= 128
    assert set(got.doc_id) == {i for i, t in enumerate(texts) if t} and not got.duplicated(["doc_id", "part_no"]).any()
    for i, part in got.sort_values("part_no").groupby("doc_id"):
        assert "".join(texts[i][a:b] for a, b in zip(part.start_char, part.end_char)) == texts[i]
        assert (len(part) == 1) == (count_tokens(texts[i]) <= 128)
    report = packing_report(pack(docs, 128), 128).first()
    assert report.containers <= report.least_by_volume * 1.2 + 1
    assert pack(docs.where("1 = 0")).count() == 0


def test_cut_to_capacity_of_unbroken_text():
    text = "日本語" * 500 + " end"
    parts = cut_to_capacity(text, 64)
    assert "".join(text[a:b] for a, b, _ in parts) == text and max(n for _, _, n in parts) <= 64


def test_quotas():
    assert quotas({"a": (0.5, 1), "b": (0.5, 1)}, {"a": 100, "b": 100}) == {"a": 100.0, "b": 100.0}
    q = quotas({"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 3)}, {"a": 1000, "b": 10})
    assert q["b"] == 20 and q["c"] == 0 and q["a"] > 400
    assert quotas({"a": (0.5, 0)}, {"a": 5}) == {"a": 0.0}


def test_settling_keeps_the_mass():
    rows = [[i, "s", 1 + i % 7, 0, 0.3] for i in range(500)]
    mass = sum(r[2] * r[4] for r in rows)
    done = list(settle(iter(rows), 1))
    assert len(done) == 500 and sum(r[4] is not None for r in done) <= 1
    assert sum(r[2] * (r[3] + (r[4] or 0)) for r in done) == pytest.approx(mass)


def test_mix(spark):
    rows = [(i, "w " * (5 + i % 9), " News " if i % 2 else "news") for i in range(3000)] + [(10_000 + i, "tale " * 40, "Tale-Book") for i in range(30)]
    rows += [(-1, None, "news"), (-2, "x", None), (-3, "x", "other"), (-4, "", "tale_book")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("news", 0.8, 1, "r"), ("tale_book", 0.2, 4, "r"), ("none", 0.0, None, "r")], "source string, target_share double, max_repeats int, records string")
    used = mix(docs, targets, fan_in=2)
    got = used.toPandas()
    assert len(got) == len(rows) and got.uses.min() == 0
    assert got[got.source == "news"].uses.max() <= 1 and got[got.source == "tale_book"].uses.max() <= 4
    assert (got[got.doc_id < 0].uses == 0).all()
    report = mix_report(used, targets).toPandas().set_index("source")
    assert abs(report.actual_share["news"] - 0.8) < 0.01 and abs(report.actual_share["tale_book"] - 0.2) < 0.01
    assert mix(docs.where("1 = 0"), targets).count() == 0
    assert isinstance(got, pd.DataFrame)
