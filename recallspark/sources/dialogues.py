"""Dialogue collections in JSON: one array of samples, each with sessions and questions.

A conversation is a map of mixed values (speakers, stamps, sessions), so it is read
as strings by key and parsed after unnesting. The array's position is the sample's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QA = "array<struct<question string, answer string, evidence array<string>, category int, adversarial_answer string>>"
SAMPLE = f"array<struct<qa {QA}, conversation map<string,string>>>"
TURNS = "array<struct<speaker string, dia_id string, text string, img_url string, blip_caption string>>"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, qa, conversation; one file is one collection."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", SAMPLE)).alias("sample_id", "s")).select("sample_id", "s.qa", "s.conversation")


def require(samples: DataFrame) -> None:
    """Fail where a sample lacks its questions, its conversation, a speaker, or a question its text: one pass over all samples."""
    lacking = {
        "qa": F.col("qa").isNull(), "conversation": F.col("conversation").isNull(), "question": F.exists(F.coalesce("qa", F.array()), lambda q: q["question"].isNull()),
        "speaker_a": F.try_element_at("conversation", F.lit("speaker_a")).isNull(), "speaker_b": F.try_element_at("conversation", F.lit("speaker_b")).isNull(),
    }
    found = samples.agg(*[F.min(F.when(c, F.col("sample_id"))).alias(k) for k, c in lacking.items()]).first().asDict()
    if missing := {k: v for k, v in found.items() if v is not None}:
        raise KeyError("missing in samples: " + ", ".join(f"{k} (first in {v})" for k, v in missing.items()))


def turns(samples: DataFrame) -> DataFrame:
    """One row per turn of the sessions that have a stamp; captions of images in front of the text."""
    entries = samples.select("sample_id", "conversation", F.explode("conversation").alias("key", "value"))
    dated = entries.where(F.col("key").rlike(r"^session_\d+$")).withColumn("session_datetime", F.try_element_at("conversation", F.concat("key", F.lit("_date_time"))))
    rows = dated.where(F.col("session_datetime").isNotNull()).select(
        "sample_id", F.col("key").alias("session_id"), "session_datetime", F.posexplode(F.from_json("value", TURNS)).alias("turn", "t")
    )
    text = F.coalesce("t.text", F.lit(""))
    both = F.col("t.img_url").isNotNull() & F.col("t.blip_caption").isNotNull()
    fused = F.when(both, F.concat(F.lit("[Image: "), F.col("t.blip_caption"), F.lit("] "), text)).otherwise(text)
    number = F.regexp_extract("session_id", r"(\d+)", 1).cast("int")
    w = Window.partitionBy("sample_id").orderBy(number, "turn")
    return rows.select(
        "sample_id", "session_id", "session_datetime", "turn", (F.row_number().over(w) - 1).alias("global_seq"),
        F.col("t.speaker").alias("speaker"), F.col("t.dia_id").alias("dia_id"), fused.alias("text"), both.alias("has_image"),
    )


def questions(samples: DataFrame) -> DataFrame:
    rows = samples.select("sample_id", F.posexplode("qa").alias("n", "q"))
    answer = F.when(F.col("q.category") == 5, F.coalesce("q.adversarial_answer", "q.answer")).otherwise(F.col("q.answer"))
    return rows.select("sample_id", "n", F.col("q.question").alias("question"), answer.alias("gold"), F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence"), F.col("q.category").alias("category"))


def to_episodes(rows: DataFrame) -> DataFrame:
    """Turns as episodes, with a deterministic id."""
    stamp = F.when(F.col("session_datetime").isNotNull(), F.concat(F.lit("DATE: "), F.col("session_datetime"), F.lit(" | "))).otherwise(F.lit(""))
    return rows.select(
        F.col("sample_id").cast("string").alias("conv_id"), F.sha2(F.concat_ws("|", "sample_id", "global_seq"), 256).alias("episode_id"), "global_seq",
        F.concat(stamp, F.lit("Speaker "), F.col("speaker"), F.lit(" says: "), F.col("text")).alias("raw_text"), "speaker", "session_id", "session_datetime",
        F.array("dia_id").alias("evidence_ids"),
    )


def statistics(samples: DataFrame) -> DataFrame:
    t = turns(samples).agg(F.count("*").alias("turns"), F.countDistinct("sample_id", "session_id").alias("sessions"))
    q = questions(samples).agg(F.count("*").alias("questions"), F.sum((F.col("category") == 5).cast("bigint")).alias("adversarial"))
    return t.join(F.broadcast(q))  # one row each
