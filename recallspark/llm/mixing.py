"""Mixing sources to target shares by pivotal dependent rounding.

Each source gets a token quota (``quotas``); each of its records is expected
quota / tokens-of-the-source times. The whole part of that is certain; the
fraction is a probability, and all fractions are rounded together: two records
trade token mass, at random but without bias, until one of them is 0 or 1, and
the other goes on to the next partner. Every trade keeps the source's total, so in
the end only one record per source is rounded alone and the source misses its
quota by less than that record.

A record can hold more tokens than the rest could ever trade against. So records
above 1/``LARGE`` of their source's tokens (fewer than ``LARGE`` per source, by that
definition) are rounded first, in tiers of falling size; what a tier's last record
misses is made good by the rate of all smaller ones, without bias. The source then
misses its quota by less than one small record.

Scale: a partition settles all its records but one per source; these residuals
are combined by a reduction tree with a fixed fan-in, spread over the executors.
A source with a third of all records is thus never gathered anywhere.

Defined results: a record of no target source (NULL or unknown spelling) and one
without text is used 0 times; a source without records stays at share 0 and the
others share its part in proportion; a source too small for its share at
``max_repeats`` uses per record is used that often; repeated ids are separate
records; NULL shares and repeats count as 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.tokens import VOCABULARY, with_token_counts
from recallspark.session import stash

USES = "doc_id bigint, source string, tokens bigint, uses bigint, chance double"
MASK = (1 << 64) - 1
LARGE = 500


def canonical_source(c: Column) -> Column:
    """Lower case, outer space dropped, hyphens and inner space as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def quotas(targets: dict[str, tuple[float, int]], have: dict[str, int], least_total: float = 0.5, total: float | None = None) -> dict[str, float]:
    """Tokens each source shall contribute.

    ``targets``: share and max_repeats; ``have``: tokens on hand. Without ``total``
    the mixture is the largest in which every source with records can still reach
    its share, but not smaller than ``least_total`` of the tokens on hand: a source
    that would force less is used up to its repeats and falls short.
    """
    most = {s: have.get(s, 0) * max(r or 0, 0) for s, (_, r) in targets.items()}
    live = {s: share for s, (share, _) in targets.items() if (share or 0) > 0 and most[s] > 0}
    if not live:
        return {s: 0.0 for s in targets}
    if total is None:
        reach = min(most[s] / share for s, share in live.items()) * sum(live.values())
        total = max(reach, least_total * sum(have.get(s, 0) for s in live))
    given, open_ = {s: 0.0 for s in targets}, dict(live)
    while open_:
        level = (total - sum(given.values())) / sum(open_.values())
        short = [s for s, share in open_.items() if share * level >= most[s]]
        if not short:
            return given | {s: share * level for s, share in open_.items()}
        for s in short:
            given[s] = float(most[s])
            del open_[s]
    return given


def uniform(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that depends on the pair alone, so a rerun task decides alike."""
    x = (seed * 0x9E3779B97F4A7C15 + (a or 0) * 0xBF58476D1CE4E5B9 + (b or 0) * 0x94D049BB133111EB) & MASK
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * k) & MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def trade(a: list, b: list, seed: int) -> tuple[list | None, list]:
    """Move mass between two records [id, source, tokens, uses, chance]; one gets settled.

    Returns the record still open (None if both are settled) and the settled ones.
    """
    (wa, pa), (wb, pb) = (a[2], a[4]), (b[2], b[4])
    up, down = min(wa * (1 - pa), wb * pb), min(wa * pa, wb * (1 - pb))
    gain = up if uniform(seed, a[0], b[0]) * (up + down) < down else -down
    a[4], b[4] = pa + gain / wa, pb - gain / wb
    done, open_ = [], None
    for r in (a, b):
        if r[4] < 1e-9 or r[4] > 1 - 1e-9:
            r[3], r[4] = r[3] + (r[4] > 0.5), None
            done.append(r)
        else:
            open_ = r
    return open_, done


def settle(rows: Iterator[list], seed: int) -> Iterator[list]:
    """All records with their uses; at most one per source keeps a chance."""
    waiting: dict[str, list] = {}
    for row in rows:
        if row[4] is None:
            yield row
            continue
        other = waiting.pop(row[1], None)
        if other is None:
            waiting[row[1]] = row
            continue
        open_, done = trade(other, row, seed)
        yield from done
        if open_ is not None:
            waiting[row[1]] = open_
    yield from waiting.values()


def settle_large(rows: list[list], want: float, have: int, most: int, seed: int) -> tuple[list[list], float]:
    """Uses of the large records of a source, and the rate left for the others.

    Tiers are powers of two of the size; after each the rate is set anew, so that
    the quota stays met in expectation and, tier by tier, ever more exactly.
    """
    done, tiers = [], {}
    for r in rows:
        tiers.setdefault(r[2].bit_length(), []).append(r)
    for tier in sorted(tiers, reverse=True):
        rate = min(max(want / have, 0.0), most) if have else 0.0
        whole, part = int(rate + 1e-12), rate - int(rate + 1e-12)
        ordered = sorted(tiers[tier], key=lambda r: (-r[2], r[0] is None, r[0] or 0))
        for r in ordered:
            r[3], r[4] = whole, part if part > 1e-9 else None
        for r in settle(iter(ordered), seed):
            if r[4] is not None:
                r[3], r[4] = r[3] + (uniform(seed + 1, r[0], tier) < r[4]), None
            want, have = want - r[2] * r[3], have - r[2]
            done.append(r)
    return done, min(max(want / have, 0.0), most) if have > 0 else 0.0


def _records(frame: pd.DataFrame) -> Iterator[list]:
    for r in frame.itertuples(index=False):
        yield [None if pd.isna(r.doc_id) else int(r.doc_id), r.source, int(r.tokens), int(r.uses), None if pd.isna(r.chance) else float(r.chance)]


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "source", "tokens", "uses", "chance"])
    return frame.astype({"doc_id": "Int64", "tokens": "int64", "uses": "int64", "chance": "float64"})


def mix(docs: DataFrame, targets: DataFrame, least_total: float = 0.5, total: float | None = None, seed: int = 11, fan_in: int = 256, path: str = VOCABULARY) -> DataFrame:
    """The use count of each record (columns doc_id, text, source): doc_id, source, tokens, uses."""
    if targets.count() > 10_000:
        raise ValueError("targets are a short list of sources")
    aims = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").collect()}
    named = docs.select("doc_id", "text", canonical_source(F.col("source")).alias("source"))
    sized = stash(with_token_counts(named, "text", ["doc_id", "source"], path), "sized")
    have = {r.source: r.t for r in sized.where(F.col("source").isin(list(aims))).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    want = quotas(aims, have, least_total, total)
    bounds = {s: max(have[s] // LARGE, 1) for s in aims if have.get(s)}
    size_of = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in bounds.items() for x in p]), F.col("source")), F.lit(MASK >> 1)) if bounds else F.lit(MASK >> 1)
    rate, large = {}, []
    for s in bounds:  # fewer than LARGE records each
        rows = [[r.doc_id, r.source, r.tokens, 0, None] for r in sized.where((F.col("source") == s) & (F.col("tokens") > bounds[s])).collect()]
        done, rate[s] = settle_large(rows, want[s], have[s], aims[s][1], seed)
        large += done
    small = sized.where(F.coalesce(F.col("tokens") <= size_of, F.lit(True)))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for frame in frames:
                for r in frame.itertuples(index=False):
                    expected = rate.get(r.source, 0.0) if r.tokens else 0.0
                    whole = int(expected + 1e-12)
                    part = expected - whole
                    yield [None if pd.isna(r.doc_id) else int(r.doc_id), r.source, int(r.tokens), whole, part if part > 1e-9 else None]

        batch = []
        for row in settle(rows(), seed):
            batch.append(row)
            if len(batch) >= 10_000:
                yield _frame(batch)
                batch = []
        yield _frame(batch)

    level = stash(small.mapInPandas(first, USES), "mix")
    settled = level.where(F.col("chance").isNull())
    left = level.where(F.col("chance").isNotNull())
    most = max([0, *[r["count"] for r in left.groupBy("source").count().collect()]])
    depth = 0
    while most > 1:
        depth += 1
        groups = -(-most // fan_in)

        def combine(frame: pd.DataFrame, step=depth) -> pd.DataFrame:
            ordered = frame.sort_values(["doc_id", "tokens"])
            return _frame(list(settle(_records(ordered), seed + step)))

        keyed = left.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(depth)), F.lit(groups)))
        level = stash(keyed.groupBy("source", "g").applyInPandas(lambda frame: combine(frame.drop(columns=["g"])), USES), "mix")
        settled = settled.unionByName(level.where(F.col("chance").isNull()))
        left = level.where(F.col("chance").isNotNull())
        most = max([0, *[r["count"] for r in left.groupBy("source").count().collect()]])
    # One record per source is rounded alone.
    luck = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    last = left.withColumn("uses", F.col("uses") + (luck < F.col("chance")).cast("bigint"))
    held = docs.sparkSession.createDataFrame([tuple(r) for r in large], USES)
    return settled.unionByName(last).unionByName(held).select("doc_id", "source", "tokens", "uses")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: share aimed at and reached, tokens on hand and used, most uses."""
    used = mixed.groupBy("source").agg(
        F.sum("tokens").alias("tokens_have"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"), F.count("*").alias("records")
    )
    rows = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").na.fill(0, ["tokens_have", "tokens_used", "most_uses", "records"])
    whole = rows.agg(F.sum("tokens_used").alias("whole"))
    return rows.crossJoin(F.broadcast(whole)).select(  # one row
        "source", "target_share", "max_repeats", "records", "tokens_have", "tokens_used", "most_uses",
        F.round(F.coalesce(F.try_divide("tokens_used", "whole"), F.lit(0.0)), 6).alias("actual_share"),
    )
