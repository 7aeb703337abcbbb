"""Segments of a sequence: text tiling over vectors, fixed windows, gaps in time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.operators.views import running_sum
from recallspark.session import stash


def tile_gaps(vectors: DataFrame, group: str = "conv_id", least_bucket: int = 4096) -> DataFrame:
    """Cosine of the mean vectors of the w rows before and after each gap.

    ``vectors``: group, pos (from 0 without holes), vector (unit length). w is
    max(3, round(sqrt(n) / 2)) per group; groups of fewer than 4 w rows have no
    gap. Positions are worked on in buckets of at least 4 w, each with the w rows
    around it, so a vector is shuffled once or twice and a long group is many
    tasks; block means are differences of running sums, so the cost is linear in n
    whatever w is. Result: group, pos (first row after the gap), gap, w, n.
    """
    sizes = vectors.groupBy(group).agg(F.count("*").alias("n")).withColumn("w", F.greatest(F.lit(3), F.bround(F.sqrt("n") / 2, 0).cast("int")))
    sizes = sizes.where(F.col("n") >= 4 * F.col("w")).withColumn("size", F.greatest(F.lit(least_bucket), 4 * F.col("w")))
    rows = vectors.join(sizes, group)
    at = lambda shift: F.floor((F.col("pos") + shift) / F.col("size"))
    spread = rows.select(group, "pos", "n", "w", "size", "vector", F.explode(F.array_distinct(F.array(at(-F.col("w")), at(F.lit(0)), at(F.col("w"))))).alias("bucket"))
    kind = dict(vectors.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        n, w, size, bucket = (int(frame[c].iloc[0]) for c in ("n", "w", "size", "bucket"))
        pos, x = frame["pos"].to_numpy(), np.array(frame["vector"].tolist(), float)
        sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        gaps = np.arange(max(bucket * size, w), min((bucket + 1) * size - 1, n - w) + 1)
        i = gaps - pos[0]  # rows lie without holes
        a, b = sums[i] - sums[i - w], sums[i + w] - sums[i]
        length = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
        gap = np.divide((a * b).sum(1), length, out=np.zeros(len(a)), where=length > 0)
        return pd.DataFrame({group: frame[group].iloc[0], "pos": gaps, "n": n, "w": w, "gap": np.round(gap, 9)})

    return spread.groupBy(group, "bucket").applyInPandas(run, f"{group} {kind[group]}, pos bigint, n bigint, w int, gap double")


def beside(rows: DataFrame, group: str, value: str, shift: int, name: str) -> DataFrame:
    """``rows`` with the ``value`` that stands ``shift`` places on, or NULL: a join on the place, not a sort of the group."""
    other = rows.select(group, (F.col("pos") - shift).alias("pos"), F.col(value).alias(name))
    return rows.join(other, [group, "pos"], "left")


def tile_depths(gaps: DataFrame, group: str = "conv_id") -> DataFrame:
    """How far each gap lies below the peaks on either side (climbing while not falling).

    A climb is numbered by the falls before it (behind it, to the right), by running sums in buckets.
    """
    rows = beside(beside(gaps, group, "gap", -1, "_p"), group, "gap", 1, "_q")
    rows = rows.withColumn("_back", -F.col("pos"))
    fall = lambda c: F.coalesce((F.col(c) < F.col("gap")).cast("int"), F.lit(0))
    rows = stash(running_sum(running_sum(rows, group, "pos", {"_l": fall("_p")}), group, "_back", {"_r": fall("_q")}), "depths")
    left = rows.groupBy(group, "_l").agg(F.min_by("gap", "pos").alias("left"))
    right = rows.groupBy(group, "_r").agg(F.max_by("gap", "pos").alias("right"))
    found = rows.join(left, [group, "_l"]).join(right, [group, "_r"])
    return found.select(*gaps.columns, F.round(F.col("left") + F.col("right") - 2 * F.col("gap"), 9).alias("depth"))


def tile_cuts(depths: DataFrame, group: str = "conv_id") -> DataFrame:
    """Gaps deeper than mean + half a deviation and no shallower than their neighbours."""
    cutoff = depths.groupBy(group).agg((F.avg("depth") + F.stddev_pop("depth") / 2).alias("_c"))
    rows = beside(beside(depths, group, "depth", -1, "_p"), group, "depth", 1, "_q").join(cutoff, group)
    peak = (F.col("depth") >= F.coalesce("_p", "depth")) & (F.col("depth") >= F.coalesce("_q", "depth"))
    return rows.where((F.col("depth") > F.col("_c") + 1e-9) & peak).select(*depths.columns)


def tile_segments(vectors: DataFrame, group: str = "conv_id") -> DataFrame:
    """``segment`` of each row: the number of cuts at or before it."""
    depths = stash(tile_depths(tile_gaps(vectors, group), group), "depths")
    cuts = tile_cuts(depths, group).select(group, "pos", F.lit(1).alias("cut"))
    rows = vectors.drop("vector").join(cuts, [group, "pos"], "left")
    return running_sum(rows, group, "pos", {"segment": F.coalesce("cut", F.lit(0))}).drop("cut")


def fixed_windows(rows: DataFrame, target: int, group: str = "conv_id") -> DataFrame:
    """``target`` blocks of consecutive rows per group, each of ceil(n / target)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    return rows.join(sizes, group).withColumn("block", F.floor(F.col("seq") / F.ceil(F.col("n") / target))).drop("n")


def strided_sample(rows: DataFrame, most: int = 14, group: str = "conv_id") -> DataFrame:
    """Every (n // most)-th row from the first, ``most`` of them."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / most)))
    at = rows.join(sizes, group)
    return at.where((F.col("seq") % F.col("step") == 0) & (F.col("seq") / F.col("step") < most)).drop("n", "step")


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str = "300 seconds") -> DataFrame:
    """Runs of events without a pause longer than ``gap``."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return events.groupBy(key, w.alias("s")).agg(F.count("*").alias("events")).select(key, F.col("s.start").cast("timestamp_ntz").alias("first_at"), "events")
