"""Versions of attributes on hand-made notes."""

from datetime import datetime

import pytest

from recallspark.operators import history as H

NOTES = (
    "conv_id string, note_id string, subject string, attribute string, statement string, event_time string, recorded_time string, "
    "valid_from string, valid_until string, status string, ingested_at timestamp, start string, value string, key string"
)


def note(i, statement, day, until=None, at=1, subject="Ann", attribute="job", conv="c"):
    return (conv, i, subject, attribute, statement, None, None, day, until, "active", datetime(2024, 1, 1, at), "x", "y", "z")


@pytest.fixture
def kinds(spark):
    return spark.createDataFrame([("job", True), ("trip", False), (None, True)], "attribute string, stateful boolean")


def versions(spark, kinds, rows):
    found = H.note_history(spark.createDataFrame(rows, NOTES), kinds).collect()
    return sorted((r.note_key, str(r.start), str(r.end) if r.end else "open") for r in found)


def test_touching_equal_values_merge_and_gaps_stay(spark, kinds):
    rows = [
        note("n1", "Ann works.", "2024-01-01"), note("n2", " ANN  works ", "2024-02-01"), note("n3", "Ann rests", "1 Mar 2024", "2024-03-10"),
        note("n4", "Ann rests", "1:00 pm on 20 March, 2024"),
    ]
    assert versions(spark, kinds, rows) == [
        ("ann::job", "2024-01-01", "2024-03-01"), ("ann::job", "2024-03-01", "2024-03-10"), ("ann::job", "2024-03-20", "open"),
    ]


def test_repeats_late_rows_and_same_day(spark, kinds):
    rows = [
        note("n1", "A", "2024-01-01", at=1), note("n1", "B", "2024-01-02", at=5), note("n1", "B", "2024-01-02", at=5),
        note("n2", "C", "2024-01-02", at=5), note("n3", "D", "2024-01-02", at=2), note("n4", "E", "2024-01-05", "2023-01-01"),
    ]
    assert versions(spark, kinds, rows) == [("ann::job", "2024-01-02", "2024-01-05"), ("ann::job", "2024-01-05", "open")]


def test_nulls_blank_dates_and_stateless(spark, kinds):
    rows = [note("n1", None, " "), note(None, "A", "2024-01-01"), note("n2", None, "2024-01-01"), note("n3", "x", "31 February 2024"), note("n4", "x", "2024-01-01", attribute="trip"), note("n5", "x", "2024-01-01", subject=None)]
    assert versions(spark, kinds, rows) == [("ann::job", "2024-01-01", "open")]
    assert versions(spark, kinds, []) == []


def test_insert_only_append(spark):
    schema = "k string, d int, v string"
    stored = H.append_satellite(None, spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y")], schema), ["k"], "d", ["v"])
    assert sorted((r.d, r.v) for r in stored.collect()) == [(1, "x"), (3, "y")]
    more = H.append_satellite(stored, spark.createDataFrame([("a", 4, "y"), ("a", 5, "z"), ("b", 1, None)], schema), ["k"], "d", ["v"])
    assert sorted((r.k, r.d) for r in more.collect()) == [("a", 5), ("b", 1)]
    slow, fast = H.split_by_change_rate(spark.createDataFrame([("a", i, str(i), "s") for i in range(5)], "k string, d int, f string, s string"), ["k"], "d", ["f", "s"])
    assert (slow, fast) == (["s"], ["f"])


def test_batches_append_to_what_one_build_gives(spark):
    schema = "k string, d int, v string"
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None), ("a", 5, "y"), ("a", 6, "x"), ("b", 4, ""), ("c", 9, "z")]
    df = spark.createDataFrame(rows, schema)
    whole = H.append_satellite(None, df, ["k"], "d", ["v"])
    stored = H.append_satellite(None, df.where("d < 2"), ["k"], "d", ["v"])
    for lo, hi in ((2, 4), (4, 6), (4, 6), (6, 99)):
        part = df.where(f"d >= {lo} and d < {hi}").join(stored.select("k", "d"), ["k", "d"], "left_anti")
        stored = stored.unionByName(H.append_satellite(stored, part, ["k"], "d", ["v"]))
    view = lambda s: sorted((r.k, r.d, r.v, r.end) for r in H.satellite_view(s, ["k"], "d").collect())
    assert view(stored) == view(whole) and len(view(whole)) == 6
