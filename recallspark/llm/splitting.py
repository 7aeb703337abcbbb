"""Splitting oversized episodes at natural boundaries by recursive bisection.

A text over ``limit`` tokens is cut at the strongest boundary near its midpoint,
each half again while it holds more than ``limit - overlap`` tokens; then every
piece but the first gets the last ``overlap`` tokens before it in front. Tokens
are runs of characters other than space, tab, line feed, carriage return and
U+00A0. The cores (pieces without overlap) are consecutive slices of the text:
joined, they are the text, character for character.

Boundaries, strongest first: end of an utterance, of a paragraph, of a line, of a
sentence, of a clause, of a token. "Near" is the middle half of the span; if it
has no sentence end or better, the search for one widens, but leaves at least
``overlap`` tokens on either side, before weaker boundaries count. So no piece is
a sliver and every overlap is whole.

Scale: a length test on the JVM drops short texts before Python sees them; only
oversized texts are shuffled, once, to keep the latest row of an id. Each text is
one task's work and needs memory in proportion to itself.

Defined results: NULL or blank ``raw_text`` means the utterances joined by one
space; no text at all is not oversized; a NULL utterance is skipped; utterances
missing from a given ``raw_text`` are appended as paragraphs before cutting, so
nothing is lost (whether the episode is oversized is judged without them); one
token, however long, is never cut; of a repeated id the latest row stands; rows
without an id are dropped; ``token_count`` and further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile("[^ \t\n\r ]+")
BOUNDARIES = ["token", "clause", "sentence", "line", "paragraph", "utterance"]
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset("e.g i.e approx no p pp st dr mr mrs ms prof vs etc ca z.b nr s ff bzw usw env p.ex n m mme sr sra dra pág núm aprox".split())

PIECES = (
    "conv_id string, episode_id string, piece_no int, n_pieces int, start_char int, end_char int, "
    "overlap_tokens int, tokens int, cut_at string, text string"
)


def full_text(raw: str | None, utterances) -> tuple[str, str]:
    """The text whose tokens count, and the text to cut (with utterances it lacks)."""
    said = [u for u in (utterances if utterances is not None else []) if isinstance(u, str) and u.strip(" \t\n\r ")]
    if raw is None or not raw.strip(" \t\n\r "):
        joined = " ".join(said)
        return joined, joined
    squeeze = lambda s: " ".join(TOKEN.findall(s))
    held = squeeze(raw)
    missing = [u for u in said if squeeze(u) not in held]
    return raw, raw + "".join("\n\n" + u for u in missing)


def strengths(text: str, starts: np.ndarray, ends: np.ndarray, utterances) -> np.ndarray:
    """Strength of the boundary before each token (that before the first is unused)."""
    n = len(starts)
    power = np.zeros(n, np.int8)
    for i in range(1, n):
        gap = text[ends[i - 1] : starts[i]]
        breaks = gap.count("\n")
        if breaks:
            power[i] = 4 if breaks > 1 else 3
            continue
        before = text[starts[i - 1] : ends[i - 1]]
        bare = before.rstrip("\"'”’»)]*_")
        last = bare[-1:]
        if last in ("!", "?", "…", "。"):
            power[i] = 2
        elif last == ".":
            word = bare.lstrip("\"'“‘«([*_").rstrip(".").lower()
            if word not in ABBREVIATIONS and len(word) != 1 and not text[starts[i]].islower():
                power[i] = 2
        elif last in (",", ";", ":"):
            power[i] = 1
    at = 0
    for u in utterances if utterances is not None else []:
        if not isinstance(u, str) or not (u := u.strip(" \t\n\r ")):
            continue
        found = text.find(u, at)
        if found < 0:
            continue
        for place in (found, found + len(u)):
            i = int(np.searchsorted(starts, place))
            if 0 < i < n and ends[i - 1] <= place:
                power[i] = 5
        at = found + len(u)
    return power


def bisect(power: np.ndarray, most: int, least: int = 1) -> list[int]:
    """Token numbers at which pieces begin, each piece holding at most ``most`` tokens.

    The search for a sentence end or better widens from the middle half to three
    quarters to all places that leave ``least`` tokens on either side; then weaker
    boundaries of the middle half count.
    """
    cuts, todo = [], [(0, len(power))]
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        if n <= most:
            cuts.append(lo)
            continue
        mid = (lo + hi) / 2
        for margin, needed in ((n // 4, 2), (max(n // 8, least), 2), (least, 2), (n // 4, 0)):
            a, b = lo + max(margin, 1), hi - max(margin, 1) + 1
            span = power[a:b]
            if len(span) and (best := span.max()) >= needed:
                where = a + np.flatnonzero(span == best)
                cut = int(where[np.argmin(np.abs(where - mid))])
                break
        todo += [(lo, cut), (cut, hi)]
    return sorted(cuts)


def split_text(raw: str | None, utterances, limit: int, overlap: int) -> list[tuple] | None:
    """Pieces as (start, end, overlap tokens, tokens, cut, text), or None if within the limit."""
    counted, text = full_text(raw, utterances)
    size = sum(1 for _ in TOKEN.finditer(counted))
    if size <= limit:
        return None
    spans = np.array([m.span() for m in TOKEN.finditer(text)])
    starts, ends = spans[:, 0], spans[:, 1]
    power = strengths(text, starts, ends, utterances)
    cuts = [*bisect(power, limit - overlap, max(overlap, 1)), len(starts)]
    pieces = []
    for lo, hi in zip(cuts, cuts[1:]):
        back = min(overlap, lo)
        start = int(starts[lo]) if lo else 0
        end = int(starts[hi]) if hi < len(starts) else len(text)
        cut = BOUNDARIES[power[hi]] if hi < len(starts) else "end"
        begin = int(starts[lo - back]) if back else start
        pieces.append((start, end, back, hi - lo + back, cut, text[begin:end]))
    return pieces


def split_episodes(episodes: DataFrame, limit: int = 800, overlap: int = 50) -> DataFrame:
    """Pieces of every episode longer than ``limit`` tokens (see the module)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    raw, said = F.col("raw_text"), F.col("episode_utterances")
    blank = F.coalesce(F.length(F.translate(raw, " \t\n\r ", "")), F.lit(0)) == 0
    length = F.when(blank, F.length(F.array_join(said, " "))).otherwise(F.length(raw))
    # limit + 1 tokens need at least 2 * limit + 1 characters.
    long = episodes.where(F.col("episode_id").isNotNull() & (length > 2 * limit))
    latest = long.groupBy("episode_id").agg(F.max(F.struct("ingested_at", "conv_id", raw.alias("raw_text"), said.alias("episode_utterances"))).alias("e"))
    rows = latest.select("episode_id", "e.conv_id", "e.raw_text", "e.episode_utterances")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                pieces = split_text(r.raw_text, r.episode_utterances, limit, overlap)
                for i, p in enumerate(pieces or []):
                    out.append((r.conv_id, r.episode_id, i + 1, len(pieces), *p))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInPandas(split, PIECES)
