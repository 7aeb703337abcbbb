"""From packs to answers: excerpts, notes, contradictions, prompts, one call a question.

Prompts are put together on the JVM; relative dates are resolved by one Arrow pass
over the packed texts that have any. A pack is bounded by its configuration, so are
its prompt and the lists gathered for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.dates import elapsed_phrase, format_day, parse_session_date
from recallspark.functions.phrases import HINT, annotate_dates, annotate_dates_until, resolve_question
from recallspark.functions.text import abstained, answer_text, final_line
from recallspark.models import answer_confidence, call_column

#: Templates by style: {images}, {facts}, {excerpts} and {question} are filled in.
TEMPLATES = {
    "uniform": (
        "You are given passages from earlier conversations. Use them to answer.\n{images}\n{facts}PASSAGES:\n{excerpts}\n\nQUESTION: {question}\n\n"
        "How to answer:\n- Rely on the passages; where they do not say it outright, infer what they support best, also for what somebody would probably do or like.\n"
        "- Give only the answer, as briefly as completeness allows; if several things are asked for, give them all.\n"
        "- Keep the passages' wording and way of writing dates; what stands in brackets behind a time is its date.\n"
        "- Say NOT_FOUND, and nothing else, if no passage has to do with the question.\n\nANSWER:"
    ),
    "short": (
        "Answer from these passages alone.\n{images}\n{facts}PASSAGES:\n{excerpts}\n\nQUESTION: {question}\n\n"
        "Give the shortest phrase that answers, all items of a list, and times as they relate to the day a passage was recorded. If the answer is not there, say NOT_FOUND.\n\nANSWER:"
    ),
    "reason": (
        "You are given passages from earlier conversations.\n{images}\n{facts}PASSAGES:\n{excerpts}\n\nQUESTION: {question}\n\n"
        "Think first, in four sentences at most: which passages matter and how they fit together. Then write one last line that begins with \"ANSWER:\" and holds the shortest complete "
        "answer in the passages' wording, all items if several are asked for, or NOT_FOUND if no passage has to do with the question.\n"
    ),
}


@dataclass
class ReaderConfig:
    style: str = "uniform"
    system_prompt: str = ""
    resolve_relative_dates: bool = True
    max_tokens: int = 256
    reason_max_tokens: int = 768
    temperature: float = 0.0
    confidence: bool = False
    most_conflicts: int = 5
    suffix: str = ""


def excerpts(rows: DataFrame, resolve: bool = True) -> DataFrame:
    """qid, excerpts, image_paths, image_labels of the packed episodes, in the order of ``seq``.

    ``rows``: qid, id, seq, text, stamp, and where there are: now (date), description,
    image_path, ranked (false for neighbours, whose images are not attached).
    """
    have = set(rows.columns)
    column = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    day, now = parse_session_date(F.col("stamp")), column("now", "date")
    text = F.trim("text")
    described = F.when(F.coalesce(column("description", "string"), F.lit("")) != "", F.concat(text, F.lit("\n[Image description: "), column("description", "string"), F.lit("]"))).otherwise(text)
    r = rows.select("qid", "id", "seq", described.alias("text"), day.alias("day"), now.alias("now"), "stamp", column("image_path", "string").alias("image_path"), F.coalesce(column("ranked", "boolean"), F.lit(True)).alias("ranked"))
    if resolve:
        hinted = F.col("day").isNotNull() & F.col("text").rlike(HINT)
        once = r.where(hinted & F.col("now").isNull()).withColumn("text", annotate_dates("text", "day"))
        both = r.where(hinted & F.col("now").isNotNull()).withColumn("text", annotate_dates_until("text", "day", "now"))
        r = r.where(~F.coalesce(hinted, F.lit(False))).unionByName(once).unionByName(both)
    said = F.coalesce(format_day(F.col("day")), F.col("stamp"), F.lit("unknown"))
    said = F.when(F.col("now").isNotNull() & F.col("day").isNotNull(), F.concat(said, F.lit(", "), elapsed_phrase(F.col("day"), F.col("now")))).otherwise(said)
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("seq", "id")))
    block = F.concat(F.lit("PASSAGE "), F.col("n").cast("string"), F.lit(" (recorded "), said, F.lit("):\n"), F.col("text"))
    first = Window.partitionBy("qid", "image_path").orderBy("n")
    shown = F.col("ranked") & (F.coalesce("image_path", F.lit("")) != "")
    r = r.withColumn("image", F.when(shown & (F.row_number().over(first) == 1), F.struct("image_path", F.concat(F.lit("passage "), F.col("n").cast("string")).alias("label"))))
    lines = F.array_sort(F.collect_list(F.struct("n", block.alias("block"), "image")))
    images = F.filter(F.transform("lines", lambda x: x["image"]), lambda x: x.isNotNull())
    return r.groupBy("qid").agg(lines.alias("lines")).select(
        "qid", F.array_join(F.transform("lines", lambda x: x["block"]), "\n\n").alias("excerpts"), F.size("lines").alias("n_excerpts"),
        F.transform(images, lambda x: x["image_path"]).alias("image_paths"), F.transform(images, lambda x: x["label"]).alias("image_labels"),
    )


def facts(notes: DataFrame, conflicts: DataFrame | None = None, most: int = 5) -> DataFrame:
    """qid, facts: the packed notes (qid, place, shown) as a block, and up to ``most`` contradictions among them.

    ``conflicts``: qid, statement_a, time_a, statement_b, time_b.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: F.concat(F.lit("- "), x["shown"]))
    head = "KNOWN FACTS (condensed from earlier sessions; one marked as superseded no longer holds):\n"
    block = notes.groupBy("qid").agg(F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n\n")).alias("facts"))
    if conflicts is None:
        return block
    when = lambda c: F.coalesce(F.col(c), F.lit("undated"))
    line = F.concat(F.lit('- "'), "statement_a", F.lit('" ('), when("time_a"), F.lit(') against "'), "statement_b", F.lit('" ('), when("time_b"), F.lit(")"))
    listed = conflicts.groupBy("qid").agg(F.slice(F.array_sort(F.collect_set(line)), 1, most).alias("c"))
    both = block.join(listed, "qid", "left")
    more = F.when(F.size("c") > 0, F.concat(F.lit("THESE FACTS CONTRADICT EACH OTHER:\n"), F.array_join("c", "\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    return both.select("qid", F.concat("facts", more).alias("facts"))


def image_note(paths: Column, labels: Column, own: Column) -> Column:
    """What the prompt says of attached images, in the order in which they are attached."""
    numbered = F.transform(labels, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    lead = F.when(own, F.lit("The first image belongs to the question, the others to the passages. ")).otherwise(F.lit("Some passages come with images; use them too. "))
    return F.when(F.size(paths) > 0, F.concat(lead, F.lit("Images in order: "), F.array_join(numbered, "; "), F.lit(".\n"))).otherwise(F.lit(""))


def fill(template: str, **parts: Column) -> Column:
    """The template with columns in its places; what a column holds is never read as a place."""
    pieces, rest = [], template
    while rest:
        at = {name: rest.find("{" + name + "}") for name in parts}
        at = {name: i for name, i in at.items() if i >= 0}
        if not at:
            pieces.append(F.lit(rest))
            break
        name = min(at, key=at.get)
        pieces += [F.lit(rest[: at[name]]), F.coalesce(parts[name], F.lit(""))]
        rest = rest[at[name] + len(name) + 2 :]
    return F.concat(*pieces)


def prompts(questions: DataFrame, excerpts: DataFrame, facts: DataFrame | None = None, cfg: ReaderConfig = ReaderConfig()) -> DataFrame:
    """qid, prompt, images: the prompt is NULL where a question has neither passage nor fact.

    ``questions``: qid, terms, and where there are: now (its times are resolved), image_path.
    """
    if cfg.style not in TEMPLATES:
        raise ValueError(f"unknown style {cfg.style!r}")
    asked = F.col("terms")
    if "now" in questions.columns:
        asked = F.when(F.col("now").isNull(), asked).otherwise(resolve_question("terms", "now")["text"])
    q = questions.select("qid", asked.alias("question"), (F.col("image_path") if "image_path" in questions.columns else F.lit(None).cast("string")).alias("own"))
    q = q.withColumn("question", F.concat("question", F.lit("\n\n" + cfg.suffix.strip())) if cfg.suffix else F.col("question"))
    rows = q.join(excerpts, "qid", "left").join(facts, "qid", "left") if facts is not None else q.join(excerpts, "qid", "left").withColumn("facts", F.lit(""))
    own = F.coalesce("own", F.lit("")) != ""
    none = F.array().cast("array<string>")
    paths = F.concat(F.when(own, F.array("own")).otherwise(none), F.coalesce("image_paths", none))
    labels = F.concat(F.when(own, F.array(F.lit("the question's own image"))).otherwise(none), F.coalesce("image_labels", none))
    rows = rows.withColumns({"paths": paths, "labels": labels})
    text = fill(TEMPLATES[cfg.style], images=image_note(F.col("paths"), F.col("labels"), own), facts=F.col("facts"), excerpts=F.col("excerpts"), question=F.col("question"))
    text = F.concat(F.lit(cfg.system_prompt.strip() + "\n\n"), text) if cfg.system_prompt else text
    some = F.col("excerpts").isNotNull() | (F.coalesce("facts", F.lit("")) != "")
    return rows.select("qid", F.when(some, text).alias("prompt"), F.col("paths").alias("images"), F.coalesce("n_excerpts", F.lit(0)).alias("n_excerpts"))


def read(prompts: DataFrame, model, cfg: ReaderConfig = ReaderConfig()) -> DataFrame:
    """qid, answer, abstained, prompt_chars, n_images, reasoning, confidence, call.

    An abstention has an empty answer and says so; a failed call has an empty answer too.
    """
    limit = cfg.reason_max_tokens if cfg.style == "reason" else cfg.max_tokens
    done = call_column(prompts, "prompt", model, images="images", max_tokens=limit, temperature=cfg.temperature, **({"logprobs": True} if cfg.confidence else {}))
    said = F.coalesce("call.text", F.lit(""))
    bare = final_line(said) if cfg.style == "reason" else answer_text(said)
    rows = done.withColumn("bare", F.coalesce(bare, F.lit("")))
    away = abstained(F.col("bare"))
    return rows.select(
        "qid", F.when(away, "").otherwise(F.col("bare")).alias("answer"), away.alias("abstained"), F.coalesce(F.length("prompt"), F.lit(0)).alias("prompt_chars"),
        F.coalesce("call.images_sent", F.lit(0)).alias("n_images"), F.when(F.lit(cfg.style == "reason"), F.substring(said, -600, 600)).otherwise(F.lit("")).alias("reasoning"),
        answer_confidence(F.col("call.logprobs")).alias("confidence"), "call",
    )
