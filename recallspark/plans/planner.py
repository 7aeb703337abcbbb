"""Plans of a question: a map of the memory, one call, at most three sub-queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.jsonx import items_of, salvaged_json
from recallspark.models import call_column
from recallspark.plans.reader import fill

#: What each style asks for.
RULES = {
    "conservative": "Use one step unless the question clearly needs facts from different moments.",
    "multiquery": "Give two or three steps that word the same need differently, so that a search finds it either way.",
    "adaptive": "First say whether facts from several moments are needed; only then give more than one step.",
}
PROMPT = (
    "Plan searches of a memory of conversations.\n\nWHAT IT HOLDS:\n{map}\n\nQUESTION: {question}\n\n{rules} Give terms a search by words would find, and the question each step answers.\n\n"
    'Reply with JSON alone: {"needs_multiple_moments": true or false, "steps": [{"id": "q1", "terms": "...", "question": "..."}]}'
)
STEP = "id string, terms string, scan_terms string, question string, inspect_question string"


@dataclass
class PlannerConfig:
    style: str = "conservative"
    max_steps: int = 3
    max_tokens: int = 512
    temperature: float = 0.1


def memory_map(regions: DataFrame, entities: DataFrame, episodes: DataFrame, rows: int = 12) -> DataFrame:
    """conv_id, map: a few lines on the first ``rows`` regions of each conversation, its names, size and dates.

    ``regions``: conv_id, node, anchors, entities, first_seq, last_seq, first_at, last_at, images;
    ``entities``: conv_id, name, rank; ``episodes``: conv_id, stamp.
    """
    w = Window.partitionBy("conv_id").orderBy("first_seq", "node")
    top = regions.withColumn("n", F.row_number().over(w)).where(F.col("n") <= rows)
    dates = F.when(F.col("first_at").isNotNull() & F.col("last_at").isNotNull(), F.concat(F.lit(", "), "first_at", F.lit(" to "), "last_at")).otherwise(F.lit(""))
    images = F.when(F.col("images") > 0, F.concat(F.lit(", images: "), F.col("images").cast("string"))).otherwise(F.lit(""))
    line = F.concat(F.lit("- "), F.array_join(F.slice("anchors", 1, 6), ", "), F.lit(" | "), F.array_join(F.slice("entities", 1, 4), ", "), F.format_string(" (turns %d to %d", "first_seq", "last_seq"), dates, images, F.lit(")"))
    lines = top.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    names = entities.where(F.col("rank") <= 20).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("names"))
    span = episodes.groupBy("conv_id").agg(F.count("*").alias("n_episodes"), F.min("stamp").alias("first_at"), F.max("stamp").alias("last_at"))
    rows_ = span.join(lines, "conv_id", "left").join(names, "conv_id", "left")
    text = F.concat_ws("\n", F.format_string("%d turns", "n_episodes"), F.when(F.col("first_at").isNotNull(), F.concat(F.lit("from "), "first_at", F.lit(" to "), "last_at")), F.concat(F.lit("people and things: "), "names"), "lines")
    return rows_.select("conv_id", text.alias("map"), "n_episodes", "first_at", "last_at")


def plan(questions: DataFrame, maps: DataFrame, model, cfg: PlannerConfig = PlannerConfig()) -> DataFrame:
    """qid, step, terms, question, from_model: the steps of each question (qid, conv_id, terms).

    A reply that cannot be read, or has no step with words, gives the question itself as the only step.
    """
    rows = questions.select("qid", "conv_id", "terms").join(maps.select("conv_id", "map"), "conv_id", "left")
    text = fill(PROMPT, map=F.col("map"), question=F.col("terms"), rules=F.lit(RULES[cfg.style]))
    done = call_column(rows.withColumn("prompt", text), "prompt", model, max_tokens=cfg.max_tokens, temperature=cfg.temperature)
    found = done.withColumn("found", salvaged_json("call.text"))
    read = found.withColumns({"several": F.get_json_object("found", "$.needs_multiple_moments"), "listed": items_of(F.col("found"), "steps", STEP)})
    word = lambda s, *names: F.coalesce(*[F.when(F.trim(s[n]) != "", F.trim(s[n])) for n in names])
    steps = F.transform("listed", lambda s: F.struct(
        F.coalesce(word(s, "terms", "scan_terms"), word(s, "question", "inspect_question")).alias("terms"), F.coalesce(word(s, "question", "inspect_question"), word(s, "terms", "scan_terms")).alias("question")))
    most = F.when(F.lit(cfg.style == "adaptive") & (F.col("several") == "false"), 1).otherwise(cfg.max_steps)
    kept = F.slice(F.filter(steps, lambda s: s["terms"].isNotNull()), F.lit(1), most)
    own = F.array(F.struct(F.col("terms").alias("terms"), F.col("terms").alias("question")))
    read = read.withColumn("kept", kept)
    out = read.select("qid", F.posexplode(F.when(F.size("kept") > 0, F.col("kept")).otherwise(own)).alias("at", "s"), (F.size("kept") > 0).alias("from_model"))
    return out.select("qid", (F.col("at") + 1).alias("step"), "s.terms", "s.question", "from_model")
