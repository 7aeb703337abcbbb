"""Structured Streaming: incremental append, sessions, windows, stateful segments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions.text import tokens
from recallspark.operators.lexical import postings


def read_stream(spark: SparkSession, path: str, schema, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A folder (or file pattern) of Parquet as a stream; ``ts`` becomes the watermarked time."""
    rows = spark.readStream.schema(schema).parquet(path)
    if ts:
        rows = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows


def once_per_id(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Redelivered rows dropped within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def append_layer(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: episodes, postings and per-batch corpus deltas.

    Deltas are summed when read, so an append never rewrites the index. Each batch
    writes to its own folder, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["conv_id", "episode_id"])
        fresh.write.mode("overwrite").parquet(f"{path}/episodes/batch={number}")
        postings(fresh).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        delta = fresh.groupBy("conv_id").agg(F.count("*").alias("n_docs"), F.sum(F.size(tokens(F.col("text")))).alias("total_len"))
        delta.write.mode("overwrite").parquet(f"{path}/corpus/batch={number}")

    return write


def corpus_of(spark: SparkSession, path: str) -> DataFrame:
    deltas = spark.read.parquet(f"{path}/corpus")
    return deltas.groupBy("conv_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "300 seconds") -> DataFrame:
    return stream.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("events"))


def windows(stream: DataFrame, ts: str, size: str, slide: str | None = None, *by: str) -> DataFrame:
    """Tumbling or sliding counts and sums."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(df: DataFrame, checkpoint: str, out: str, mode: str = "complete") -> DataFrame:
    """Run a streaming plan over what is there and return its result table."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(out)


SEGMENT = "conv_id string, segment bigint, first_at timestamp, utterances bigint, tokens bigint"
STATE = "number bigint, held bigint, size bigint, first double, last double, words array<string>"


def segment_state(most: int = 800, least: int = 500, gap_s: float = 300.0, min_overlap: float = 0.15, idle_s: float | None = None):
    """State function for ``applyInPandasWithState``: segments that close at a token ceiling, a pause or a change of topic.

    Rows: conv_id, ts, and text or tokens (topics are judged by texts). The last segment of a conversation comes out when no row
    has come for ``idle_s`` (by default the pause): the state then times out, which
    needs ``timeoutConf="ProcessingTimeTimeout"`` or, with a watermark on ``ts``, ``"EventTimeTimeout"``.
    Rows of a batch are taken in the order of their time; a row later than the watermark
    never gets here, one that comes late but within it joins the segment open by then.
    """
    word = re.compile(r"\w+")
    wait = gap_s if idle_s is None else idle_s

    def out(key, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], number, pd.Timestamp(first, unit="s"), held, size) for number, first, held, size in rows], columns=["conv_id", "segment", "first_at", "utterances", "tokens"])

    def step(key, frames: Iterator[pd.DataFrame], state):
        number, held, size, first, last, words = state.get if state.exists else (0, 0, 0, 0.0, 0.0, [])
        words = set(words)
        if state.hasTimedOut:
            state.update((number + 1, 0, 0, 0.0, 0.0, []))
            yield out(key, [(number, first, held, size)] if held else [])
            return
        closed = []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        texts = rows["text"] if "text" in rows else [None] * len(rows)
        counts = rows["tokens"] if "tokens" in rows else [len((t or "").split()) for t in texts]
        for ts, text, n in zip(rows["ts"], texts, counts):
            at, n, own = ts.timestamp(), int(n), set(word.findall((text or "").lower()))
            shared = len(words & own) / len(words | own) if words and own else 0.0
            if held and ((size + n > most and size >= least) or at - last > gap_s or (size >= least and text is not None and shared < min_overlap)):
                closed.append((number, first, held, size))
                number, held, size, words = number + 1, 0, 0, set()
            first = at if not held else first
            held, size, last, words = held + 1, size + n, at, words | own
        state.update((number, held, size, first, last, sorted(words)))
        if held:
            try:
                state.setTimeoutTimestamp(max(int((last + wait) * 1000), state.getCurrentWatermarkMs() + 1))
            except Exception:  # noqa: BLE001 - not event time
                try:
                    state.setTimeoutDuration(max(1, int(wait * 1000)))
                except Exception:  # noqa: BLE001 - no timeout configured: the last segment stays open
                    pass
        yield out(key, closed)

    return step


def count_fresh(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that counts, for each group of ``path``/groups, the episodes it gained: what a summary lacks.

    Counts are appended per batch, so a repeated batch replaces itself; ``dirty_of`` sums them.
    """

    def write(batch: DataFrame, number: int) -> None:
        index = batch.sparkSession.read.parquet(f"{path}/groups")
        found = index.join(batch.select("episode_id").distinct(), "episode_id", "left_semi").groupBy("conv_id", "group_id").agg(F.count("*").alias("new_since"))
        found.write.mode("overwrite").parquet(f"{path}/dirty/batch={number}")

    return write


def dirty_of(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """Episodes each group gained in the batches after the one its summary was made in."""
    rows = spark.read.parquet(f"{path}/dirty").where(F.col("batch") > after)
    return rows.groupBy("conv_id", "group_id").agg(F.sum("new_since").alias("new_since"))


def late_rows(batch: DataFrame, ts: str, seen: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows that a watermark would drop, for a batch that must keep them: those older than the newest one seen by more than ``late``.

    The policy: within the watermark rows join by their time; beyond it they are appended at the tail by a batch job.
    """
    newest = seen.agg(F.max(ts).alias("_newest"))
    return batch.join(F.broadcast(newest)).where(F.col(ts) < F.col("_newest") - F.expr(f"INTERVAL {late}")).drop("_newest")  # one row
