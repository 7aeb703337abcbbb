"""Command line: python -m recallspark COMMAND ... (``-h`` for the arguments of each)."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import functions as F

from recallspark.engine import MemoryEngine
from recallspark.models import ExtractiveReader, make_model
from recallspark.operators.context import sampled_questions
from recallspark.operators.evaluation import print_summary
from recallspark.operators.segmentation import tile_segments
from recallspark.functions.vectors import unit, usable
from recallspark.plans.judge import judge, judged_path
from recallspark.plans.reader import ReaderConfig
from recallspark.plans.retrieve import RetrievalConfig
from recallspark.session import local_session
from recallspark.sources import dialogues, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recallspark", description=__doc__)
    p.add_argument("--backend", choices=["offline", "local", "chat"], default="offline")
    p.add_argument("--model", default="")
    p.add_argument("--url", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("layer", help="folder of the memory layer")
        return c

    command("build", "a dialogue file into a layer").add_argument("dialogues")
    command("consolidate", "notes from sessions")
    command("summarise", "notes from segments")
    for name, text in (("ask", "one question"), ("evaluate", "all questions of a dialogue file")):
        c = command(name, text)
        for f in fields(RetrievalConfig):
            if isinstance(f.default, bool):
                c.add_argument(f"--{f.name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=f.default)
            elif isinstance(f.default, (int, float, str)):
                c.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
        c.add_argument("--style", default="uniform")
        if name == "ask":
            c.add_argument("conversation")
            c.add_argument("question")
            c.add_argument("--now", default=None, help="yyyy-MM-dd; resolves times in the question")
        else:
            c.add_argument("dialogues")
            c.add_argument("out")
            c.add_argument("--most", type=int, default=0, help="questions a conversation, 0 for all")
    j = sub.add_parser("judge", help="verdicts on a result file")
    j.add_argument("results")
    j.add_argument("--cache", default=None)
    t = sub.add_parser("tables", help="the tables of a result file")
    t.add_argument("results")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = local_session("recallspark")
    model = ExtractiveReader() if a.backend == "offline" else make_model(a.backend, a.model, **({"url": a.url} if a.url else {}))
    if a.command == "judge":
        rows = spark.read.json(a.results)
        cache = spark.read.parquet(a.cache) if a.cache and store.exists(spark, a.cache) else None
        scored, merged = judge(rows.select("qid", "question", "gold", F.col("answer").alias("prediction")), model, cache)
        rows.join(scored, "qid", "left").write.mode("overwrite").json(judged_path(a.results))
        if a.cache:
            merged.write.mode("overwrite").parquet(a.cache)
        return
    if a.command == "tables":
        print(print_summary(spark.read.json(a.results)))
        return
    known = {f.name for f in fields(RetrievalConfig)}
    cfg = RetrievalConfig(**{k: v for k, v in vars(a).items() if k in known})
    engine = MemoryEngine(spark, a.layer, cfg, ReaderConfig(style=getattr(a, "style", "uniform")), model)
    if a.command == "build":
        samples = dialogues.read_samples(spark, a.dialogues)
        dialogues.require(samples)
        e = dialogues.to_episodes(dialogues.turns(samples))
        engine.remember(e.select("conv_id", "episode_id", F.col("global_seq").cast("bigint").alias("seq"), F.col("raw_text").alias("text"), F.col("session_id").alias("session"), F.col("session_datetime").alias("stamp"), F.array("speaker").alias("speakers"), "evidence_ids"))
    elif a.command == "consolidate":
        engine.consolidate().show()
    elif a.command == "summarise":
        e = engine.layer().episodes.where(usable(F.col("embedding"), cfg.encoder.dim))
        s = tile_segments(e.select("conv_id", "episode_id", F.col("seq").alias("pos"), unit(F.col("embedding")).alias("vector")))
        engine.summarise(s.select("conv_id", F.col("segment").alias("group_id"), "episode_id")).select("conv_id", "subject", "statement").show(truncate=80)
    elif a.command == "ask":
        q = spark.createDataFrame([(1, a.conversation, a.question, a.now)], "qid bigint, conv_id string, terms string, now string").withColumn("now", F.col("now").cast("date"))
        engine.ask(q).select("answer", "abstained", "retrieved", "rr_top").show(truncate=False)
    else:
        q = dialogues.questions(dialogues.read_samples(spark, a.dialogues))
        q = q.select(F.xxhash64("sample_id", "n").alias("qid"), F.col("sample_id").cast("string").alias("conv_id"), F.col("question").alias("terms"), "gold", "category")
        scored, by = engine.evaluate(sampled_questions(q, a.most) if a.most else q)
        store.write_results(scored.drop("call"), a.out, vars(a), by)
        print(print_summary(scored))


if __name__ == "__main__":
    main()
