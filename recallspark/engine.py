"""The engine as one object: a memory layer, its models, and what can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.models import ExtractiveReader, SafeReranker, check_encoder, check_reranker, encode_column
from recallspark.operators import notes as O
from recallspark.operators.evaluation import rollup
from recallspark.functions.text import category_label, exact_match, token_f1
from recallspark.plans import reader as A
from recallspark.plans.consolidate import ConsolidationConfig, consolidate
from recallspark.plans.planner import PlannerConfig, plan
from recallspark.plans.retrieve import Layer, RetrievalConfig, build_layer, confidence, evidence, retrieve
from recallspark.plans.summaries import summarise_groups
from recallspark.session import stash
from recallspark.sources import store


@dataclass
class MemoryEngine:
    """Storage and retrieval over DataFrames. Every method works on all conversations at once."""

    spark: SparkSession
    path: str
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    reading: A.ReaderConfig = field(default_factory=A.ReaderConfig)
    model: object = field(default_factory=ExtractiveReader)

    def check(self) -> None:
        """Fail now rather than in the middle of a run."""
        check_encoder(self.retrieval.encoder)
        check_reranker(self.retrieval.reranker)
        self.retrieval.reranker = SafeReranker(self.retrieval.reranker)

    def remember(self, episodes: DataFrame, notes: DataFrame | None = None) -> None:
        """Append episodes (conv_id, episode_id, text, more) and notes, with their vectors."""
        store.append_layer(self.path, encode_column(episodes, "text", self.retrieval.encoder), notes)

    def parts(self) -> dict[str, DataFrame]:
        return store.load_layer(self.spark, self.path)

    def layer(self) -> Layer:
        parts = self.parts()
        notes = parts.get("notes", self.spark.createDataFrame([], "conv_id string, note_id string, subject string, attribute string, statement string, status string, event_time string, recorded_time string, valid_until string, provenance array<string>, evidence_ids array<string>"))
        shown = notes.withColumns({"text": O.render(), "found": F.concat_ws(" ", "subject", "attribute", "statement")})
        encoded = encode_column(shown.drop("embedding"), "found", self.retrieval.encoder)
        return build_layer(parts["episodes"], encoded, self.retrieval, stored_vectors=True)

    def consolidate(self, cfg: ConsolidationConfig | None = None) -> DataFrame:
        """Notes of all sessions, written to the layer; returns how often each operation was applied."""
        made, conflicts, operations = consolidate(self.layer().episodes, self.model, cfg or ConsolidationConfig(), self.retrieval.encoder)
        made.drop("order").write.mode("overwrite").partitionBy("conv_id").parquet(f"{self.path}/notes")
        conflicts.write.mode("overwrite").parquet(f"{self.path}/conflicts")
        return operations

    def summarise(self, members: DataFrame) -> DataFrame:
        """Summaries of groups (conv_id, group_id, episode_id) as notes, appended to the layer."""
        e = self.layer().episodes
        made = stash(summarise_groups(members, e.select("episode_id", "seq", "text", "stamp"), self.model), "summaries")
        made.write.mode("append").partitionBy("conv_id").parquet(f"{self.path}/notes")
        return made

    def ask(self, questions: DataFrame, maps: DataFrame | None = None, planner: PlannerConfig | None = None) -> DataFrame:
        """Answers of questions (qid, conv_id, terms and, where times are to be resolved, now) with what they rest on."""
        layer = self.layer()
        steps = plan(questions, maps, self.model, planner or PlannerConfig()) if maps is not None else None
        packs = stash(retrieve(questions, None, None, self.retrieval, layer, steps), "packs")
        e = layer.episodes.select(F.col("episode_id").alias("id"), "text", "stamp")
        rows = packs.where(F.col("kind") != "note").select("qid", "id", "seq", (F.col("kind") == "episode").alias("ranked")).join(e, "id")
        rows = rows.join(questions.select("qid", "now"), "qid") if "now" in questions.columns else rows
        held = packs.where(F.col("kind") == "note").select("qid", F.col("id").alias("note_id"), "place")
        shown = held.join(layer.notes.select("note_id", F.col("text").alias("shown")), "note_id")
        conflicts = self.spark.read.parquet(f"{self.path}/conflicts") if store.exists(self.spark, f"{self.path}/conflicts") else None
        known = A.facts(shown, O.conflicts_of(conflicts, held) if conflicts is not None else None, self.reading.most_conflicts)
        asked = A.prompts(questions, A.excerpts(rows, self.reading.resolve_relative_dates), known, self.reading)
        said = A.read(asked, self.model, self.reading)
        return said.join(evidence(packs, layer), "qid", "left").join(confidence(packs), "qid", "left")

    def evaluate(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Answers scored against ``gold`` (questions with gold and category), and the scores by category."""
        said = stash(self.ask(questions).join(questions.select("qid", F.col("terms").alias("question"), "gold", "category"), "qid"), "answers")
        scored = said.select("*", token_f1(F.col("answer"), F.col("gold")).alias("f1"), exact_match(F.col("answer"), F.col("gold")).alias("exact_match"), category_label(F.col("category")).alias("category_name"))
        return scored, rollup(scored, ["f1", "exact_match"], "category_name")
