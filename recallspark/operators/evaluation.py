"""Metrics of answers and retrieval, their roll-ups, and the call ledger."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(retrieved: Column, gold: Column, ks: Sequence[int] = (5, 10, 20, 30)) -> dict[str, Column]:
    """recall, hit and all at each k, and the reciprocal rank; NULL without gold."""
    wanted = F.array_distinct(F.filter(F.coalesce(gold, F.array().cast("array<string>")), lambda g: g.isNotNull() & (g != "")))
    ranked = F.coalesce(retrieved, F.array().cast("array<string>"))
    n = F.size(wanted)
    out = {"n_gold": n}
    for k in ks:
        found = F.size(F.array_intersect(wanted, F.slice(ranked, 1, k)))
        out[f"recall_{k}"] = F.when(n > 0, found / n)
        out[f"hit_{k}"] = F.when(n > 0, (found > 0).cast("double"))
        out[f"all_{k}"] = F.when(n > 0, (found == n).cast("double"))
    places = F.filter(F.transform(wanted, lambda g: F.array_position(ranked, g)), lambda p: p > 0)
    out["mrr"] = F.when(n > 0, F.coalesce(1.0 / F.array_min(places), F.lit(0.0)))
    return out


def rollup(records: DataFrame, metrics: Sequence[str], by: str) -> DataFrame:
    """Mean, count and sample deviation of each metric by category and over all."""
    long = records.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"))
    long = long.select(by, "m.metric", "m.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    grouped = long.groupBy(F.col("metric"), by) if by == "metric" else long.rollup("metric", by)
    stats = grouped.agg(F.grouping_id().alias("g"), F.avg("value").alias("mean"), F.count("*").alias("n"), F.stddev_samp("value").alias("std"))
    return stats.where(F.col("g") < 2).select("metric", F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.coalesce(by, F.lit("none"))).alias("category"), "mean", "n", "std")


def percentile(values: Column, q: float) -> Column:
    """Nearest rank, index rounded half to even; NULL for an empty list."""
    ordered = F.array_sort(values)
    at = F.bround(F.lit(q / 100) * (F.size(ordered) - 1), 0).cast("int")
    return F.when(F.size(ordered) > 0, F.try_element_at(ordered, at + 1))


def exact_percentiles(df: DataFrame, value: str, qs: Sequence[float], by: str, cells: int = 1000) -> DataFrame:
    """Nearest-rank percentiles per group.

    A group's range is divided into ``cells``; counts of cells tell which of them
    hold the wanted ranks, and only their values are sorted, so a group's values
    are never all in one task (unless nearly all lie in one cell).
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_x"))
    span = rows.groupBy(by).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count("*").alias("n"))
    at = F.least(F.lit(cells - 1), F.floor((F.col("_x") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * cells))
    placed = rows.join(span, by).select(by, "_x", "n", F.coalesce(at, F.lit(0)).alias("_cell"))
    counts = placed.groupBy(by, "_cell").agg(F.count("*").alias("_k"), F.max("n").alias("n"))
    before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    ranks = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), (F.bround(F.lit(q / 100) * (F.col("n") - 1), 0) + 1).alias("rank")) for q in qs])).alias("r")
    wanted = counts.select(by, "_cell", "_before", "_k", ranks).where((F.col("r.rank") > F.col("_before")) & (F.col("r.rank") <= F.col("_before") + F.col("_k")))
    values = placed.join(wanted.select(by, "_cell").distinct(), [by, "_cell"], "left_semi").groupBy(by, "_cell", "_x").count()
    upto = F.sum("count").over(Window.partitionBy(by, "_cell").orderBy("_x"))
    found = values.withColumn("_upto", upto).join(wanted, [by, "_cell"]).where(F.col("_upto") + F.col("_before") >= F.col("r.rank"))
    picks = found.groupBy(by, "r.q").agg(F.min("_x").alias("_x"))
    out = picks.groupBy(by).agg(*[F.max(F.when(F.col("q") == float(q), F.col("_x"))).alias(f"p{q:g}") for q in qs])
    return span.select(by, "n").join(out, by)


def minmax_scaled(df: DataFrame, value: str, by: str) -> DataFrame:
    """``df`` with ``scaled``: the value in 0..1 within its group, 1 where all are equal; the limits are a partial aggregate."""
    limits = df.groupBy(by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    wide = F.col("_high") - F.col("_low")
    scaled = F.when(wide < 1e-12, F.lit(1.0)).otherwise((F.col(value) - F.col("_low")) / wide)
    return df.join(limits, by).withColumn("scaled", scaled).drop("_low", "_high")


#: Cumulative probabilities of Poisson(1) from 0 to 6.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]


def bootstrap_ci(df: DataFrame, value: str, by: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Poisson bootstrap of the mean: each row draws its weight in every resample.

    Weights come from the row's hash and the resample's number. They are drawn and
    summed inside the Arrow batches, so rows are not multiplied; what is shuffled is
    two sums per batch, group and resample.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(by), F.col(value).cast("double").alias("v"), F.xxhash64(*df.columns, F.lit(seed)).alias("h"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = np.arange(resamples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums: dict = {}
        for frame in frames:
            for group, part in frame.groupby(by, dropna=False):
                held = sums.setdefault(None if pd.isna(group) else group, [np.zeros(resamples), np.zeros(resamples)])
                for start in range(0, len(part), 4096):
                    some = part.iloc[start : start + 4096]
                    z = some["h"].to_numpy().view(np.uint64)[:, None] + salt
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
                    w = np.searchsorted(POISSON, u, "right").astype(float)
                    held[0] += w.sum(0)
                    held[1] += some["v"].to_numpy() @ w
        for group, (w, s) in sums.items():
            yield pd.DataFrame({by: group, "b": range(resamples), "w": w, "s": s})

    kind = dict(rows.dtypes)[by]
    means = rows.mapInPandas(draw, f"{by} {kind}, b int, w double, s double").groupBy(by, "b").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    # The interval's ends are the sorted means at these places.
    ordered = F.array_sort(F.collect_list("m"))  # at most `resamples` values
    low, high = F.try_element_at("o", (F.size("o") * 0.025).cast("int") + 1), F.try_element_at("o", (F.size("o") * 0.975).cast("int"))
    return means.groupBy(by).agg(ordered.alias("o")).select(by, low.alias("ci_low"), high.alias("ci_high"), (F.aggregate("o", F.lit(0.0), lambda a, x: a + x) / F.size("o")).alias("mean_of_means"))


def ledger_by_role(calls: DataFrame) -> DataFrame:
    """Calls, tokens, latency and failures by role; NULL flags and counts are no failure and no tokens."""
    yes = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint"))
    return calls.groupBy(F.coalesce("role", F.lit("none")).alias("role")).agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("prompt_tokens", F.lit(0)).cast("bigint")).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0)).cast("bigint")).alias("completion_tokens"), F.round(F.sum("latency_s"), 3).alias("latency_s"),
        F.sum((~F.coalesce(F.col("ok"), F.lit(True))).cast("bigint")).alias("failed"), yes("truncated").alias("truncated"),
        yes("output_capped").alias("output_capped"), yes("transport_failed").alias("transport_failed"),
    )


def merge_cache(cache: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """The cache with the fresh entries it lacks; the first verdict of a key stands."""
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in fresh.columns if c != key]), F.col("order")).alias("r")).select(key, "r.*")
    return cache.unionByName(first.join(cache.select(key), key, "left_anti"))


TIMINGS = ("total_s", "reader_s", "embed_s", "rerank_s", "retrieval_other_s", "retrieval_s")
COUNTS = ("embed_tokens", "embed_texts", "rerank_pairs", "rerank_tokens")


def question_cost(latency: Column, reader: Column, embed: Column, rerank: Column, load: Column) -> dict[str, Column]:
    """The parts of a question's time: what is no reader, encoder, reranker or loading is other, 0 at least."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    latency, reader, embed, rerank, load = (z(c) for c in (latency, reader, embed, rerank, load))
    other = latency - reader - embed - rerank - load
    parts = {
        "total_s": latency - load, "encoder_load_s": load, "reader_s": reader, "embed_s": embed, "rerank_s": rerank,
        "retrieval_other_s": F.greatest(F.lit(0.0), other), "retrieval_other_raw_s": other, "retrieval_s": latency - reader - load,
    }
    return {k: F.round(c, 6) for k, c in parts.items()}


def cost_summary(costs: DataFrame, by: str) -> DataFrame:
    """``by``, timing, n, sum, mean, p50, p95 for each of the six timings; one row each."""
    long = costs.select(by, F.inline(F.array(*[F.struct(F.lit(t).alias("timing"), F.col(t).cast("double").alias("s")) for t in TIMINGS])))
    keyed = long.withColumn("both", F.to_json(F.struct(by, "timing"), {"ignoreNullFields": "false"}))
    sums = keyed.groupBy("both", by, "timing").agg(F.round(F.sum("s"), 3).alias("sum"), F.round(F.avg("s"), 4).alias("mean"))
    return sums.join(exact_percentiles(keyed, "s", [50, 95], "both"), "both").select(by, "timing", "n", "sum", "mean", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


def ledger_since(calls: DataFrame, index: Column) -> DataFrame:
    """The ledger of the calls at or after an index or time: a filter, then the roll-up."""
    return ledger_by_role(calls.where(index))


def print_summary(results: DataFrame) -> str:
    """A run as text: scores by category, retrieval at each depth, abstentions."""
    have = set(results.columns)
    by = "category_name" if "category_name" in have else "category"
    metrics = [m for m in ("f1", "bleu1", "exact_match", "judge") if m in have]
    lines = [f"{'category':<14}{'n':>7}" + "".join(f"{m:>13}" for m in metrics)]
    stats: dict[str, dict] = {}
    for r in rollup(results, metrics, by).collect():  # a few categories
        stats.setdefault(r.category, {"n": 0})[r.metric] = r["mean"]
        stats[r.category]["n"] = max(stats[r.category]["n"], r["n"])
    for name in sorted(stats, key=lambda c: (c == "overall", c)):
        lines.append(f"{name:<14}{stats[name]['n']:>7}" + "".join(f"{stats[name].get(m, float('nan')) * 100:>13.2f}" for m in metrics))
    depths = [c for c in results.columns if c.startswith(("recall_", "hit_", "all_"))]
    if depths:
        means = results.agg(*[F.avg(c).alias(c) for c in depths]).first()
        lines += ["", *(f"{c:<14}{(means[c] or 0) * 100:>8.2f}" for c in depths)]
    if "abstained" in have:
        lines += ["", f"abstained: {results.where('abstained').count()}"]
    return "\n".join(lines)
