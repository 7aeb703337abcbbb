"""A memory layer on disk: one Parquet table per part, and result files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions.dates import epoch_seconds
from recallspark.operators.episodes import SegmentConfig, construct, from_utterances, segment_utterances
from recallspark.operators.lexical import corpus_stats, postings
from recallspark.session import stash

PARTS = ("episodes", "notes", "postings", "corpus")


def save_layer(path: str, episodes: DataFrame, notes: DataFrame | None = None, partitions: str = "conv_id") -> None:
    """Write episodes (with their vectors, if they have any), notes and the lexical index anew, split by conversation for pruning."""
    write_parts(path, episodes, notes, partitions, "overwrite")


def append_layer(path: str, episodes: DataFrame, notes: DataFrame | None = None, partitions: str = "conv_id") -> None:
    """Add episodes and notes to a layer: their rows, their postings, and their share of the corpus statistics.

    Nothing that is stored is rewritten; statistics are summed when read. Episodes
    whose id the layer has are left out, so a repeated append changes nothing.
    """
    spark = episodes.sparkSession
    if exists(spark, f"{path}/episodes"):
        known = spark.read.parquet(f"{path}/episodes").select("episode_id")
        episodes = stash(episodes.dropDuplicates(["episode_id"]).join(known, "episode_id", "left_anti").select(*episodes.columns), "fresh")
    if notes is not None and exists(spark, f"{path}/notes"):
        notes = stash(notes.join(spark.read.parquet(f"{path}/notes").select("note_id"), "note_id", "left_anti").select(*notes.columns), "fresh")
    write_parts(path, episodes, notes, partitions, "append")


def write_parts(path: str, episodes: DataFrame, notes: DataFrame | None, partitions: str, mode: str) -> None:
    episodes = episodes if mode == "append" else stash(episodes, "layer")
    episodes.write.mode(mode).partitionBy(partitions).parquet(f"{path}/episodes")
    if notes is not None:
        notes.write.mode(mode).partitionBy(partitions).parquet(f"{path}/notes")
    postings(episodes).write.mode(mode).partitionBy(partitions).parquet(f"{path}/postings")
    corpus_stats(episodes).write.mode(mode).parquet(f"{path}/corpus")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def add_episode(spark: SparkSession, path: str, conv_id: str, seq: int, text: str, now: str, **more) -> None:
    """One episode into a layer: the same way as many."""
    row = {"conv_id": conv_id, "seq": seq, "text": text} | more
    one = construct(spark.createDataFrame([row]), now).withColumn("text", F.col("raw_text"))
    append_layer(path, one)


def add_utterances(path: str, utterances: DataFrame, cfg: SegmentConfig = SegmentConfig()) -> None:
    """Utterances into a layer as the episodes the segmenter makes of them.

    ``utterances``: conv_id, session_id, n, text, speaker, timestamp, dia_id, image_path, dataset_caption.
    """
    image = F.coalesce("image_path", F.lit("")) != ""
    cut = segment_utterances(utterances.select("conv_id", "session_id", "n", "text", epoch_seconds(F.col("timestamp")).alias("at"), image.alias("image")), cfg)
    made = from_utterances(utterances.join(cut, ["conv_id", "session_id", "n"]))
    append_layer(path, made.withColumn("text", F.col("raw_text")))


def load_layer(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a layer; index tables that are missing are derived."""
    def read(part: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{part}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    out = {part: read(part) for part in PARTS}
    if out["episodes"] is None:
        raise FileNotFoundError(f"no layer at {path}")
    out["postings"] = out["postings"] if out["postings"] is not None else postings(out["episodes"])
    out["corpus"] = summed(out["corpus"]) if out["corpus"] is not None else corpus_stats(out["episodes"])
    return {k: v for k, v in out.items() if v is not None}


def summed(corpus: DataFrame) -> DataFrame:
    """Corpus statistics of all appends together."""
    rows = corpus.groupBy("conv_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
    return rows.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(1.0))


def write_results(results: DataFrame, path: str, config: dict | None = None, aggregates: DataFrame | None = None) -> None:
    """A run on disk: its rows, and beside them its configuration and aggregates if there are any."""
    results.write.mode("overwrite").json(path if config is None and aggregates is None else f"{path}/per_question")
    if config is not None:
        results.sparkSession.createDataFrame([(json.dumps(config, default=str),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    if aggregates is not None:
        aggregates.write.mode("overwrite").json(f"{path}/aggregates")


def changed_since(spark: SparkSession, path: str, since) -> bool:
    """Whether a stored part has files newer than ``since`` (seconds since 1970): what a cache of it must be checked against."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(p, True)
    while files.hasNext():
        if files.next().getModificationTime() / 1000 > since:
            return True
    return False


def discover_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows with their file; judged twins, unfinished files and shards are passed over."""
    rows = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
    named = rows.withColumn("file", F.col("_metadata.file_name")).withColumn("changed_at", F.col("_metadata.file_modification_time"))
    return named.where(~F.col("file").rlike(r"\.j2\.|\.INCOMPLETE\.|\.shard\d+"))
