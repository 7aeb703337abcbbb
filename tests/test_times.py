"""Question times, stamps, running sums and percentiles with one hot group, late rows, layers."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recallspark.functions import dates as D
from recallspark.functions import phrases as P
from recallspark.operators import evaluation as E
from recallspark.operators import views as V
from recallspark.sources import dialogues, store
from recallspark.streaming import ingest as I

NOW = date(2023, 5, 10)  # a Wednesday


@pytest.mark.parametrize("text,note,windows", [
    ("two weeks ago", "around 26 April 2023", [(date(2023, 4, 23), date(2023, 4, 29))]), ("a couple of days ago", "8 May 2023", [(date(2023, 5, 7), date(2023, 5, 9))]),
    ("a month ago", "around 10 April 2023", [(date(2023, 3, 26), date(2023, 4, 25))]), ("3 years ago", "around May 2020", []), ("last Friday", "5 May 2023", [(date(2023, 5, 4), date(2023, 5, 6))]),
    ("last week", "1 May 2023 to 7 May 2023", [(date(2023, 5, 1), date(2023, 5, 7))]), ("last weekend", "6 May 2023 to 7 May 2023", [(date(2023, 5, 6), date(2023, 5, 7))]),
    ("last month", "April 2023", [(date(2023, 4, 1), date(2023, 4, 30))]), ("last year", "2022", []), ("in the last month", "since 10 April 2023", []), ("the past two weeks", "since 26 April 2023", []),
    ("last 3 days", "since 7 May 2023", []), ("this week", "since 8 May 2023", []), ("this year", "since 1 January 2023", []), ("9999 years ago", None, []), ("0 days ago", None, []),
])
def test_question_times(text, note, windows):
    got, found = P.question_time(f"What was {text}?", NOW)
    assert (f"({note})" in got if note else "(" not in got) and found == windows


def test_question_times_in_columns(spark):
    rows = spark.createDataFrame([("yesterday", NOW), (None, NOW), ("yesterday", None)], "t string, now date")
    got = [tuple(r.r) for r in rows.select(P.resolve_question("t", "now").alias("r")).collect()]
    assert got[0][0] == "yesterday (9 May 2023)" and len(got[0][1]) == 1 and got[1] == (None, []) and got[2] == ("yesterday", [])
    inside = spark.createDataFrame([(date(2023, 5, 9),), (date(2022, 1, 1),)], "d date").select(D.in_windows(F.col("d"), F.array(F.struct(F.lit(date(2023, 5, 8)).alias("lo"), F.lit(NOW).alias("hi")))).alias("x"))
    assert [r.x for r in inside.collect()] == [True, False]
    assert P.annotate("we met today", NOW, now=NOW) == "we met today (10 May 2023, the current date)"


def test_stamps(spark):
    rows = spark.createDataFrame([("2023-05-08T13:56:00",), ("1:56 pm on 8 May, 2023",), ("soon",), (None,)], "s string")
    got = [tuple(r) for r in rows.select(D.iso_day(F.col("s")), D.epoch_seconds(F.col("s"))).collect()]
    assert got == [("2023-05-08", 1683554160.0), ("2023-05-08", None), ("soon", None), (None, None)]


def test_one_hot_group(spark):
    """One key holds most rows; buckets and cells must give what a sort would."""
    rows = [("hot", i, float((i * 7919) % 1000)) for i in range(3000)] + [("cold", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    got = {(r.k, r.o): (r.n, r.s) for r in V.running_sum(df, "k", "o", {"n": F.lit(1), "s": F.col("v")}, bucket=100).collect()}
    total = 0.0
    for i in range(3000):
        total += rows[i][2]
        assert got[("hot", i)] == (i + 1, pytest.approx(total))
    p = {r.k: r for r in E.exact_percentiles(df, "v", [0, 50, 95, 100], "k", cells=10).collect()}
    values = sorted(r[2] for r in rows[:3000])
    assert (p["hot"].p0, p["hot"].p50, p["hot"].p95, p["hot"].p100) == (values[0], values[1500], values[round(0.95 * 2999)], values[-1]) and p["cold"].p50 == 1.0
    scaled = {(r.k, r.o): r.scaled for r in E.minmax_scaled(df, "v", "k").where("o = 0").collect()}
    assert scaled == {("hot", 0): 0.0, ("cold", 0): 1.0}
    cost = df.select("k", *[F.col("v").alias(c) for c in E.TIMINGS])
    assert E.cost_summary(cost, "k").count() == 12


def test_bootstrap_has_a_thousand_resamples_and_hot_groups(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), (F.col("id") % 10).cast("double").alias("v"), "id")
    r = E.bootstrap_ci(df, "v", "k").first()
    assert 4.2 < r.ci_low < 4.5 < r.ci_high < 4.8 and abs(r.mean_of_means - 4.5) < 0.05
    assert E.bootstrap_ci(df.where("1 = 0"), "v", "k").count() == 0


def test_layer_appends_once(spark, tmp_path):
    path = str(tmp_path / "layer")
    rows = spark.createDataFrame([("c", "e1", "red fox"), ("c", "e2", "blue")], "conv_id string, episode_id string, text string")
    store.append_layer(path, rows)
    store.append_layer(path, rows)
    parts = store.load_layer(spark, path)
    assert parts["episodes"].count() == 2 and parts["postings"].count() == 3 and parts["corpus"].first().n_docs == 2
    store.add_episode(spark, str(tmp_path / "other"), "c", 0, "Hello you", "2024-01-01")
    u = spark.createDataFrame([("c", "s", 0, "hello", "Ann", "2024-01-01T00:00:00", "D1", None, None), ("c", "s", 1, "later", "Bo", "2024-01-01T01:00:00", "D2", None, None)], "conv_id string, session_id string, n long, text string, speaker string, timestamp string, dia_id string, image_path string, dataset_caption string")
    store.add_utterances(str(tmp_path / "third"), u)
    assert spark.read.parquet(str(tmp_path / "third/episodes")).count() == 2  # an hour's pause
    assert store.changed_since(spark, path, 0) and not store.changed_since(spark, path, 4e9)
    store.write_results(rows, str(tmp_path / "run"), {"top_k": 10}, rows.groupBy("conv_id").count())
    assert spark.read.json(str(tmp_path / "run/per_question")).count() == 2 and "top_k" in spark.read.text(str(tmp_path / "run/config")).first().value


def test_missing_keys_are_named(spark):
    bad = spark.createDataFrame([(0, [("q", "a")], {"speaker_a": "A"}), (1, None, {"speaker_a": "A", "speaker_b": "B"})], "sample_id int, qa array<struct<question string, answer string>>, conversation map<string,string>")
    with pytest.raises(KeyError, match="qa .first in 1., speaker_b .first in 0."):
        dialogues.require(bad)
    dialogues.require(bad.where("1 = 0"))


def test_streamed_segments_close_by_topic_and_time_out(spark, tmp_path):
    at = datetime(2024, 1, 1)
    words = ["a b c d e f", "a b c d e f", "x y z u v w", "x y z u v w"]
    rows = [("c", at + timedelta(seconds=i), t) for i, t in enumerate(words)] + [("d", at + timedelta(hours=5), "later")]
    df = spark.createDataFrame(rows, "conv_id string, ts timestamp, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([("d", at + timedelta(hours=9), "last")], df.schema).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    out = stream.groupBy("conv_id").applyInPandasWithState(I.segment_state(most=100, least=6), I.SEGMENT, I.STATE, "append", "EventTimeTimeout")
    found = []
    query = out.writeStream.outputMode("append").foreachBatch(lambda b, n: found.extend((r.conv_id, r.segment, r.utterances) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert ("c", 0, 2) in found and ("c", 1, 2) in found  # the second by timing out


def test_late_rows_and_dirty_groups(spark, tmp_path):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("e1", at), ("e2", at + timedelta(hours=1))], "episode_id string, ts timestamp")
    assert [r.episode_id for r in I.late_rows(df, "ts", df).collect()] == ["e1"]
    spark.createDataFrame([("c", "g", "e1"), ("c", "g", "e2")], "conv_id string, group_id string, episode_id string").write.parquet(str(tmp_path / "groups"))
    sink = I.count_fresh(str(tmp_path))
    for number, part in enumerate((df.where("episode_id = 'e1'"), df)):
        sink(part, number)
        sink(part, number)
    assert I.dirty_of(spark, str(tmp_path)).first().new_since == 3 and I.dirty_of(spark, str(tmp_path), 0).first().new_since == 2
