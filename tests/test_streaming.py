"""Streams over small folders."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recallspark.streaming import ingest as I


def test_append_is_idempotent_and_adds_up(spark, tmp_path):
    rows = [("c", f"e-{i}", "red fox") for i in range(3)]
    sink = I.append_layer(str(tmp_path / "layer"))
    for number, part in enumerate((rows[:2], rows[2:] + rows[2:])):
        df = spark.createDataFrame(part, "conv_id string, episode_id string, text string")
        sink(df, number)
        sink(df, number)
    assert tuple(I.corpus_of(spark, str(tmp_path / "layer")).first()) == ("c", 3, 6)


def test_stateful_segments(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("c", at + timedelta(seconds=s), 10) for s in (0, 100, 400, 1000)]
    spark.createDataFrame(rows, "conv_id string, ts timestamp, tokens bigint").write.parquet(str(tmp_path / "in"))
    stream = I.read_stream(spark, str(tmp_path / "in"), "conv_id string, ts timestamp, tokens bigint", "ts")
    out = stream.groupBy("conv_id").applyInPandasWithState(I.segment_state(), I.SEGMENT, I.STATE, "append", "NoTimeout")
    got = I.run_available(out, str(tmp_path / "cp"), str(tmp_path / "out"), "append").collect()
    assert [(r.segment, r.utterances, r.tokens) for r in got] == [(0, 3, 30)]


def test_sessions_and_windows(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", at + timedelta(seconds=s), 1.0) for s in (0, 300, 601)], "k string, ts timestamp, value double")
    assert sorted(r.events for r in I.sessions(df, "k", "ts").collect()) == [1, 2]
    assert sum(r.n for r in I.windows(df, "ts", "10 minutes", "5 minutes").select(F.col("n")).collect()) == 6
