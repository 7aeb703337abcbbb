"""Filling fixed-capacity containers: best-fit decreasing over all items at once.

Sizes are whole tokens up to the capacity, so items of one size are alike and so
are open containers with the same room. Best-fit decreasing therefore runs on the
histogram of sizes (at most ``capacity`` rows, whatever the number of items): for
each size from the largest, a segment tree over rooms finds in logarithmic time
the tightest room that fits, and a whole run of equal containers is filled in one
step. The outcome is that of the item-by-item algorithm. The plan says which ranks
within a size go to which containers; a rank comes from a count per size and hash
bucket plus a row number inside the bucket, so a size that a third of all items
share is spread over many tasks.

Defined results: NULL and empty texts take no room and get no container; blank
ones count as the tokens they have; texts over the capacity are cut at word
starts into parts that are items of their own; equal texts are separate items; an
empty table gives no containers; further columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.tokens import VOCABULARY, cut_to_capacity
from recallspark.session import stash


class RoomTree:
    """Segment tree over rooms 0..capacity: which rooms have open containers."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << (capacity + 1).bit_length()
        self.full = [False] * (2 * self.width)

    def set(self, room: int, some: bool) -> None:
        i = room + self.width
        self.full[i] = some
        while i > 1:
            i //= 2
            self.full[i] = self.full[2 * i] or self.full[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room >= ``least`` that some container has."""
        i = least + self.width
        if self.full[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.full[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Placements (size, first rank, first container, items per container), and the number of containers.

    A placement covers the ranks of its size up to the next placement's first rank.
    """
    tree, open_bins = RoomTree(capacity), {}
    plan, bins = [], 0

    def keep(room: int, first: int, count: int) -> None:
        if count and room:
            open_bins.setdefault(room, deque()).append((first, count))
            tree.set(room, True)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first = capacity, bins
                count = -(-left // (capacity // size))
                bins += count
            else:
                first, count = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // size
            whole = min(count, left // each)
            if whole:
                plan.append((size, rank, first, each))
                keep(room - each * size, first, whole)
                left, rank = left - whole * each, rank + whole * each
            if whole < count:
                if 0 < left < each:
                    plan.append((size, rank, first + whole, each))
                    keep(room - left * size, first + whole, 1)
                    left, rank, whole = 0, rank + left, whole + 1
                keep(room, first + whole, count - whole)
    return plan, bins


def items_of(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """One row per text, or per part of a text over the capacity: its slice and tokens."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                if text:
                    out += [(doc_id, i + 1, *part) for i, part in enumerate(cut_to_capacity(text, capacity, path))]
            yield pd.DataFrame(out, columns=["doc_id", "part_no", "start_char", "end_char", "tokens"])

    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(
        measure, "doc_id bigint, part_no int, start_char int, end_char int, tokens int"
    )


def rank_within_size(items: DataFrame, rows: int, bucket_rows: int = 100_000) -> DataFrame:
    """``rank`` of each item among those of its size, from 0, without one task per size."""
    buckets = max(1, -(-rows // bucket_rows))
    keyed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(buckets)))
    counts = keyed.groupBy("tokens", "bucket").count()
    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tokens", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("tokens", "bucket").orderBy("doc_id", "part_no")
    numbered = keyed.withColumn("n", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["tokens", "bucket"]).withColumn("rank", F.col("offset") + F.col("n")).drop("bucket", "n", "offset")


def pack(docs: DataFrame, capacity: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """The container of every text (columns doc_id, text) or of each of its parts."""
    spark = docs.sparkSession
    items = stash(items_of(docs, capacity, path), "items")
    histogram = {r.tokens: r["count"] for r in items.groupBy("tokens").count().toLocalIterator()}  # at most `capacity` rows
    plan, _ = best_fit_decreasing(histogram, capacity)
    table = np.array(plan or [(0, 0, 0, 1)], dtype=np.int64)
    shared = spark.sparkContext.broadcast((table, table[:, 0] * -(1 << 40) + table[:, 1]))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, starts = shared.value
        for frame in frames:
            rank = frame["rank"].to_numpy()
            row = table[np.searchsorted(starts, frame["tokens"].to_numpy().astype(np.int64) * -(1 << 40) + rank, "right") - 1]
            yield frame.drop(columns=["rank"]).assign(container=row[:, 2] + (rank - row[:, 1]) // row[:, 3])

    ranked = rank_within_size(items, items.count()).select("doc_id", "part_no", "start_char", "end_char", "tokens", "rank")
    return ranked.mapInPandas(place, "doc_id bigint, part_no int, start_char int, end_char int, tokens int, container bigint")


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, the least possible number by volume, and the share of room used."""
    held = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return held.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / capacity).alias("least_by_volume"), F.max("t").alias("fullest"),
        F.round(F.try_divide(F.sum("t"), F.count("*") * capacity), 6).alias("fill"),
    )
