"""History of changing entity attributes: insert-only satellites.

A hub key (for notes: conversation and ``subject::attribute``) has satellites,
tables to which rows are only ever appended, and only when the hash of their
attributes (the hash-diff) differs from that of the version before. An end is
never stored: it is the next version's start, computed by a view with ``lead``.
A period that ends without a successor is closed by an appended row whose
hash-diff is NULL (a tombstone), so that gaps stay gaps.

Scale: every step is keyed by the hub key. Notes are first reduced per id and per
key and day by partial aggregation, so the windows see at most one row (and one
tombstone) per key and calendar day, however many rows a hot key delivers.

Defined results: rows without an id, key or readable day make no version; a null
statement is a value of its own (the empty text); repeated rows change nothing;
ties of ``ingested_at`` within one id fall to the later day, then the larger
texts; an empty table gives an empty history; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.dates import parse_session_date
from recallspark.session import stash


def hash_diff(cols: Sequence[Column]) -> Column:
    """Hash of the attributes of one version; NULL differs from the empty text."""
    parts = [F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def change_rates(df: DataFrame, key: Sequence[str], start: str, attributes: Sequence[str]) -> DataFrame:
    """One row: for each attribute the share of rows that change it within their key."""
    w = Window.partitionBy(*key).orderBy(start)
    changed = df.select(
        F.row_number().over(w).alias("_n"),
        *[(~F.col(a).eqNullSafe(F.lag(a).over(w))).cast("int").alias(a) for a in attributes],
    ).where("_n > 1")
    return changed.agg(*[F.coalesce(F.avg(a), F.lit(0.0)).alias(a) for a in attributes])


def split_by_change_rate(
    df: DataFrame, key: Sequence[str], start: str, attributes: Sequence[str], threshold: float = 0.5
) -> tuple[list[str], list[str]]:
    """Slow and fast attributes, to be kept in satellites of their own."""
    rates = change_rates(df, key, start, attributes).first()
    slow = [a for a in attributes if rates[a] < threshold]
    return slow, [a for a in attributes if rates[a] >= threshold]


def append_satellite(
    existing: DataFrame | None,
    incoming: DataFrame,
    key: Sequence[str],
    start: str,
    attributes: Sequence[str],
    alive: Column | None = None,
) -> DataFrame:
    """The rows of ``incoming`` to append to the satellite ``existing``.

    A row is appended when its hash-diff differs from the row before it in its
    key, be that an incoming row or the satellite's. ``alive`` is false for
    tombstones, whose hash-diff is NULL. Incoming rows start after stored ones.
    """
    diff = hash_diff([F.col(a) for a in attributes])
    rows = incoming.withColumn("hash_diff", F.when(alive, diff) if alive is not None else diff).withColumn("_in", F.lit(True))
    if existing is not None:
        last = existing.groupBy(*key).agg(F.max_by(F.struct(start, "hash_diff"), start).alias("_l"))
        last = last.join(incoming.select(*key).distinct(), list(key), "left_semi")
        rows = rows.unionByName(
            last.select(*key, F.col(f"_l.{start}").alias(start), F.col("_l.hash_diff").alias("hash_diff"), F.lit(False).alias("_in")),
            allowMissingColumns=True,
        )
    w = Window.partitionBy(*key).orderBy(start)
    first = F.row_number().over(w) == 1
    changed = ~F.col("hash_diff").eqNullSafe(F.lag("hash_diff").over(w))
    keep = F.col("_in") & ((first & F.col("hash_diff").isNotNull()) | (~first & changed))
    return rows.withColumn("_keep", keep).where("_keep").drop("_keep", "_in")


def satellite_view(satellite: DataFrame, key: Sequence[str], start: str, end: str = "end") -> DataFrame:
    """Versions with the period they held; the end is exclusive, NULL while open."""
    w = Window.partitionBy(*key).orderBy(start)
    return satellite.withColumn(end, F.lead(start).over(w)).where(F.col("hash_diff").isNotNull())


def standing_notes(notes: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row per conversation, stateful key and day: the note that stands there."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    value = F.lower(F.regexp_replace(F.coalesce(F.col("statement"), F.lit("")), r"\s+", " "))
    value = F.regexp_replace(F.trim(value), r"[\s.]+$", "")
    slim = notes.where(F.col("note_id").isNotNull()).select(
        "note_id",
        F.struct(
            "ingested_at",
            parse_session_date(F.coalesce(blank("valid_from"), blank("event_time"), blank("recorded_time"))).alias("day"),
            "conv_id",
            F.lower(F.trim("attribute")).alias("attribute"),
            F.concat(F.lower(F.trim("subject")), F.lit("::"), F.lower(F.trim("attribute"))).alias("note_key"),
            value.alias("value"),
            parse_session_date(F.col("valid_until")).alias("until"),
            F.lower(F.trim("status")).alias("status"),
        ).alias("n"),
    )
    # Of each id the latest row, by partial aggregation instead of a window per id.
    latest = slim.groupBy("note_id").agg(F.max("n").alias("n")).select("note_id", "n.*")
    stateful = kinds.where("stateful").select(F.lower(F.trim("attribute")).alias("attribute")).distinct()
    dated = latest.where(F.col("day").isNotNull() & F.col("note_key").isNotNull()).join(stateful, "attribute", "left_semi")
    best = F.max(F.struct("ingested_at", "note_id", "value", "until", "status")).alias("n")
    return dated.groupBy("conv_id", "note_key", "day").agg(best).select("conv_id", "note_key", "day", "n.note_id", "n.value", "n.until", "n.status")


KEY = ["conv_id", "note_key"]
#: What a standing note says of its key.
ATTRIBUTES = ["value", "status", "until"]


def note_satellites(notes: DataFrame, kinds: DataFrame, threshold: float = 0.5) -> list[tuple[list[str], DataFrame]]:
    """(attributes, satellite) for the slow and the fast attributes by their measured change rates; an empty side has none.

    Each satellite appends by the hash-diff of its own attributes. A note's own
    ``valid_until`` that lies after its day and before the next standing day
    appends a tombstone to both.
    """
    w = Window.partitionBy(*KEY).orderBy("day")
    standing = stash(standing_notes(notes, kinds), "standing")
    rows = standing.withColumn("_next", F.lead("day").over(w))
    closes = (F.col("until") > F.col("day")) & (F.col("_next").isNull() | (F.col("until") < F.col("_next")))
    opened = F.struct(F.col("day").alias("start"), F.lit(True).alias("alive"))
    closed = F.struct(F.col("until").alias("start"), F.lit(False).alias("alive"))
    events = rows.select(
        *KEY, *ATTRIBUTES, "note_id",
        F.explode(F.when(closes, F.array(opened, closed)).otherwise(F.array(opened))).alias("e"),
    ).select(*KEY, "e.start", "e.alive", *ATTRIBUTES, "note_id")
    parts = split_by_change_rate(standing, KEY, "day", ATTRIBUTES, threshold)
    return [(own, append_satellite(None, events.select(*KEY, "start", "alive", "note_id", *own), KEY, "start", own, F.col("alive")).drop("alive")) for own in parts if own]


def note_history(notes: DataFrame, kinds: DataFrame) -> DataFrame:
    """Versions per conversation and key: value, period (``end`` exclusive, NULL = open).

    From the satellite that has the value; rows that only change its other attributes make no version here.
    """
    satellite = next(rows for own, rows in note_satellites(notes, kinds) if "value" in own)
    alive = F.col("alive")
    values = satellite.select(*KEY, "start", "value", "note_id", F.col("hash_diff").isNotNull().alias("alive"))
    values = append_satellite(None, values, KEY, "start", ["value"], alive)
    return satellite_view(values, KEY, "start").select(*KEY, "value", "note_id", "start", "end", "hash_diff")
