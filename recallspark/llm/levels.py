"""Reading level of each document, from 1 to 5.

Two operators. ``familiar_word_scores`` is the familiar-word formula: share of
words outside the list of those in at least ``least`` of all documents of their
language, plus average sentence length. Those two numbers follow subject
and source more than difficulty here (README has the figures), so levels are given
by ``reading_levels``: every sentence is scored by word lists graded by level,
which are the document frequencies of words in the sentences of rated documents,
and the level with most of the text's words wins. The formula, calibrated on the
same ratings, decides texts of which the graded lists know less than a third.

Fitting takes the ratings of at most ``max_rated`` documents (chosen by the hash
of the id) and three rounds: sentences first inherit their document's ratings,
then share them according to the lists so far, since a document holds sentences of
other levels too. Each round is a distributed pass; only the lists, bounded by the
rated texts, come to the driver. Document frequencies and scoring cover all texts.

Cleaning and tokenising run on the JVM, once (``bodies``); Python sees lower-case
words and looks them up for a whole batch at a time.

Layout does not count: markup, speaker labels, log lines, headings and bracketed
references are dropped first; runs without punctuation are read in windows of 25
words; case is ignored.

Defined results: NULL texts and those with fewer than 40 runs of non-space
characters get no level; a text without a word is level 1; a tie falls to the lower level; unrated tables give level 3
for want of anything better; NULL levels are ignored; repeated ids are scored
each; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.pairs import FUNCTION_WORDS
from recallspark.session import stash

LEVELS = 5
SMOOTH, ROOM = 0.5, 2000
LEAST_RUNS = 40
WINDOW = 25

NOISE = re.compile(
    r"^\s*(?:\d{4}-\d\d-\d\d[ T]\d\d:\d\d.*|[A-Z]{3,6} \d{3}\b.*|(?:SELECT|INSERT|UPDATE|DELETE)\b.*;|\{.*\}|\[Image:.*\]|=+ ?.*=+|(?:D\d+:\d+[;,]?\s*)+|#{1,6} .*|https?://\S+|[-=_*]{3,})\s*$"
)
LABEL = re.compile(r"^\s*(?:[-*>•]\s+)?(?:Speaker \w+ says:|\[\w+\]|[A-ZÀ-Ý]\w{1,15}:(?=\s))\s*")
MARKUP = re.compile(r"<[^<>]{1,40}>|\*\*|`+|^\s*[-*>•]\s+")
ASIDE = re.compile(r"\((?:[^()]{0,25}\d[^()]{0,12}|(?:etc\.? ?)+|[^()]{0,12}\.[^()]{0,12})\)")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
BREAK = re.compile(r"[.!?…。]+[\"')\]»”]*\s+|\n+")
_TELLING = {w: [la for la in FUNCTION_WORDS if w in FUNCTION_WORDS[la].split()] for la in FUNCTION_WORDS for w in FUNCTION_WORDS[la].split()}


def clean(text: str) -> str:
    """The text without what is layout or was pasted in."""
    kept = []
    for line in text.split("\n"):
        if not NOISE.match(line):
            kept.append(ASIDE.sub(" ", LABEL.sub("", MARKUP.sub(" ", line))))
    return "\n".join(kept)


def sentences(text: str) -> list[list[str]]:
    """Lower-case words by sentence, long runs in windows."""
    out = []
    for part in BREAK.split(clean(text)):
        if found := [w.lower().replace("’", "'") for w in WORD.findall(part)]:
            out += windows(found)
    return out


#: The patterns above in Java's spelling for a whole text: Unicode classes, each line by itself.
_JAVA = "(?Udm)"
_PASSES = [(_JAVA + p.replace(r"\s", r"[^\S\n]").replace("[^()]", r"[^()\n]").replace("[^<>]", r"[^<>\n]"), to) for p, to in ((NOISE.pattern, ""), (MARKUP.pattern, " "), (LABEL.pattern, ""), (ASIDE.pattern, " "))]


def bodies(docs: DataFrame) -> DataFrame:
    """``docs`` with ``body`` for ``text``: lower-case words, one line a sentence; ``parts_of`` gives what ``sentences`` does."""
    body = F.col("text")
    for pattern, to in _PASSES:
        body = F.regexp_replace(body, pattern, to)
    body = F.regexp_replace(F.replace(F.lower(body), F.lit("’"), F.lit("'")), "(?Ud)" + BREAK.pattern, "\n")
    body = F.regexp_replace(body, r"[^\p{L}'\n-]+", " ")
    body = F.regexp_replace(body, r"['-](?:(?<!\p{L}['-])|(?!\p{L}))", " ")
    return docs.select(*[c for c in docs.columns if c != "text"], body.alias("body"))


def windows(found: list[str]) -> list[list[str]]:
    """A sentence in windows of ``WINDOW`` words; a rest under five joins the window before."""
    if len(found) <= WINDOW:
        return [found]
    many = max(1, (len(found) + WINDOW - 5) // WINDOW)
    return [found[i * WINDOW : (i + 1) * WINDOW if i < many - 1 else None] for i in range(many)]


def parts_of(body: str) -> list[list[str]]:
    return [piece for line in body.split("\n") if (found := line.split()) for piece in windows(found)]


def language_of(parts: list[list[str]]) -> str:
    scores = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w, n in Counter(w for part in parts for w in part).items():
        for la in _TELLING.get(w, ()):
            scores[la] += n / len(_TELLING[w])
    return max(scores, key=scores.get)


_WEIGHTS = {w: np.array([(la in own) / len(own) for la in FUNCTION_WORDS]) for w, own in _TELLING.items()}
_NAMES = list(FUNCTION_WORDS)


def languages(found) -> list[str]:
    """``language_of`` for each body."""
    out = []
    for body in found:
        told = Counter(w for w in body.split() if w in _WEIGHTS)
        out.append(_NAMES[int(np.argmax(np.round(sum(n * _WEIGHTS[w] for w, n in told.items()), 9)))] if told else _NAMES[0])
    return out


def enough(text: DataFrame) -> DataFrame:
    """Rows whose text has at least ``LEAST_RUNS`` runs, tested on the JVM; the test stops at the last of them."""
    runs = rf"^[ \t\n\r]*+(?:[^ \t\n\r]++[ \t\n\r]++){{{LEAST_RUNS - 1}}}[^ \t\n\r]"
    return text.where(F.col("text").rlike(runs))


# The formula -----------------------------------------------------------------


def document_frequencies(texts: DataFrame) -> DataFrame:
    """lang, word, docs: in how many ``bodies`` of its language a word occurs; the empty word counts texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = defaultdict(Counter)
            for body, la in zip(frame["body"], languages(frame["body"])):
                found[la].update({"", *body.split()})
            yield pd.DataFrame([(la, w, n) for la, c in found.items() for w, n in c.items()], columns=["lang", "word", "docs"])

    counted = texts.select("body").mapInPandas(run, "lang string, word string, docs bigint")
    return counted.groupBy("lang", "word").agg(F.sum("docs").alias("docs"))


def familiar_words(texts: DataFrame, least: float = 0.02, most: int = 5000) -> dict[str, set[str]]:
    """Per language the words that at least ``least`` of its texts contain, ``most`` at most."""
    counts = stash(document_frequencies(texts), "frequencies")
    of = counts.where(F.col("word") == "").select("lang", F.col("docs").alias("all"))
    w = Window.partitionBy("lang").orderBy(F.desc("docs"), "word")
    listed = counts.join(of, "lang").where((F.col("word") != "") & (F.col("docs") >= F.col("all") * least))
    top = listed.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    out: dict[str, set[str]] = {}
    for r in top.select("lang", "word").toLocalIterator():  # at most 1 / least words a text, `most` a language
        out.setdefault(r.lang, set()).add(r.word)
    return out


def formula_parts(parts: list[list[str]], lists: dict[str, set[str]]) -> tuple[float, float, float]:
    """Unfamiliar share, average sentence length, and the score they make."""
    total = sum(map(len, parts))
    if not total:
        return 0.0, 0.0, 0.0
    known = lists.get(language_of(parts), set())
    share = sum(w not in known for part in parts for w in part) / total
    length = total / len(parts)
    # The weights of the familiar-word formula.
    return share, length, 0.1579 * 100 * share + 0.0496 * length + (3.6365 if share > 0.05 else 0.0)


def familiar_word_scores(docs: DataFrame, least: float = 0.02) -> DataFrame:
    """doc_id, unfamiliar_share, sentence_length, score by the familiar-word formula."""
    texts = stash(bodies(enough(docs).select("doc_id", "text")), "bodies")
    shared = docs.sparkSession.sparkContext.broadcast(familiar_words(texts, least))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [formula_parts(parts_of(t), shared.value) for t in frame["body"]]
            yield frame[["doc_id"]].assign(**{c: [r[i] for r in rows] for i, c in enumerate(("unfamiliar_share", "sentence_length", "score"))})

    return texts.mapInPandas(run, "doc_id bigint, unfamiliar_share double, sentence_length double, score double")


# Graded lists ----------------------------------------------------------------


class Lists:
    """Log-probabilities of words by language and level."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.of: dict[str, tuple[dict[str, int], np.ndarray]] = {}
        names = [f"l{k}" for k in range(1, LEVELS + 1)]
        for la, part in rows.groupby("lang"):
            counts = part[names].to_numpy(float)
            mass = part[[f"t{k}" for k in range(1, LEVELS + 1)]].iloc[0].to_numpy(float)
            self.of[la] = ({w: i for i, w in enumerate(part["word"])}, np.log(counts + SMOOTH) - np.log(mass + SMOOTH * ROOM))

    def score(self, la: str, part: list[str]) -> tuple[np.ndarray, int]:
        """Log-likelihood of a sentence at each level, and how many of its words are listed."""
        index, table = self.of.get(la, ({}, None))
        at = [i for w in set(part) if (i := index.get(w)) is not None]
        return (table[at].sum(0) if at else np.zeros(LEVELS)), sum(w in index for w in part)

    def levels(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each body the share of its words at each level (bodies x levels), and the share that the lists know."""
        held, known = np.zeros((len(found), LEVELS)), np.zeros(len(found))
        by: dict[str, list[int]] = {}
        for i, la in enumerate(languages(found)):
            by.setdefault(la, []).append(i)
        for la, rows in by.items():
            index, table = self.of.get(la, ({}, np.zeros((0, LEVELS))))
            table = np.vstack([table, np.zeros((1, LEVELS))])
            get, none = index.get, len(table) - 1
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                parts = [parts_of(found[i]) for i in some]
                lines = [line for part in parts for line in part]
                if not lines:
                    continue
                of = np.repeat(np.arange(len(some)), [len(part) for part in parts])
                size = np.array([len(x) for x in lines])
                word = np.fromiter((get(w, none) for x in lines for w in x), np.int64, size.sum())
                line = np.repeat(np.arange(len(lines)), size)
                once = np.unique(line * len(table) + word)
                log = np.zeros((len(lines), LEVELS))
                starts = np.searchsorted(once, np.arange(len(lines)) * len(table))
                log[:] = np.add.reduceat(table[once % len(table)], starts, axis=0)
                e = np.exp(log - log.max(1, keepdims=True))
                share = e / e.sum(1, keepdims=True) * size[:, None]
                total = np.maximum(np.bincount(of, size, len(some)), 1)
                for k in range(LEVELS):
                    held[some, k] = np.bincount(of, share[:, k], len(some)) / total
                known[some] = np.bincount(of[line], word != none, len(some)) / total
        return held, known


def share_out(log: np.ndarray) -> np.ndarray:
    e = np.exp(log - log.max())
    return e / e.sum()


def prior_of(votes: np.ndarray) -> np.ndarray:
    """Levels a rated document's sentences may have: its ratings, their neighbours, the rest."""
    votes = votes / votes.sum()
    near = np.convolve(votes, [1, 0, 1], "same")
    p = 0.08 + 0.52 * votes + 0.08 * near
    return p / p.sum()


def rated_texts(docs: DataFrame, labels: DataFrame, max_rated: int) -> DataFrame:
    """doc_id, body, v1..v5 (votes) of at most about ``max_rated`` rated documents."""
    votes = labels.where(F.col("level").between(1, LEVELS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.sum((F.col("level") == k).cast("int")).cast("double").alias(f"v{k}") for k in range(1, LEVELS + 1)]
    )
    votes = stash(votes, "votes")
    many = votes.count()
    if many > max_rated:
        votes = votes.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * max_rated / many))
    return docs.select("doc_id", "body").join(votes, "doc_id")


def fit_lists(rated: DataFrame, rounds: int = 3) -> Lists:
    """Graded lists from rated texts (stashed frame)."""
    spark = rated.sparkSession
    lists = None
    names = [f"v{k}" for k in range(1, LEVELS + 1)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(lists)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                counts: dict[tuple[str, str], np.ndarray] = {}
                for text, votes in zip(frame["body"], frame[names].to_numpy(float)):
                    parts = parts_of(text)
                    la = language_of(parts)
                    prior = np.log(prior_of(votes))
                    for part in parts:
                        weight = votes / votes.sum() if shared.value is None else share_out(shared.value.score(la, part)[0] + prior)
                        for w in set(part):
                            key = (la, w)
                            counts[key] = counts[key] + weight if key in counts else weight
                yield pd.DataFrame([(la, w, *c) for (la, w), c in counts.items()], columns=["lang", "word", *[f"l{k}" for k in range(1, LEVELS + 1)]])

        counted = rated.mapInPandas(run, "lang string, word string, " + ", ".join(f"l{k} double" for k in range(1, LEVELS + 1)))
        summed = counted.groupBy("lang", "word").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(1, LEVELS + 1)])
        rows = summed.toPandas().sort_values(["lang", "word"])  # bounded by the rated texts
        for k in range(1, LEVELS + 1):
            rows[f"t{k}"] = rows.groupby("lang")[f"l{k}"].transform("sum")
        lists = Lists(rows)
    return lists


def calibrate(rated: DataFrame, lists: dict[str, set[str]]) -> np.ndarray:
    """Level = a + b * share + c * length by ridge regression on the ratings; ``lists`` are the familiar words."""
    shared = rated.sparkSession.sparkContext.broadcast(lists)
    names = [f"v{k}" for k in range(1, LEVELS + 1)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([[1.0, *formula_parts(parts_of(t), shared.value)[:2]] for t in frame["body"]]).reshape(-1, 3)
            v = frame[names].to_numpy(float)
            y = v @ np.arange(1, LEVELS + 1) / v.sum(1)
            sums = [*(x.T @ x).ravel(), *(x.T @ y)]
            yield pd.DataFrame([sums], columns=[f"s{i}" for i in range(12)])

    moments = rated.mapInPandas(run, ", ".join(f"s{i} double" for i in range(12)))
    sums = moments.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(12)]).first()
    a = np.array(sums[:9]).reshape(3, 3) + np.diag([1e-9, 1e-2, 1e-2])
    return np.linalg.solve(a, np.array(sums[9:])) if sums[0] else np.array([3.0, 0.0, 0.0])


def reading_levels(docs: DataFrame, labels: DataFrame, max_rated: int = 8000, least: float = 0.02) -> DataFrame:
    """doc_id, source, level, share (of the words at that level), known (share of words listed)."""
    spark = docs.sparkSession
    texts = stash(bodies(enough(docs).select("doc_id", "source", "text")), "bodies")
    rated = stash(rated_texts(texts, labels, max_rated), "rated")
    familiar = familiar_words(texts, least)
    model = (fit_lists(rated), familiar, calibrate(rated, familiar))
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists, familiar, weights = shared.value
        for frame in frames:
            found = frame["body"].tolist()
            held, known = lists.levels(found)
            level = held.argmax(1) + 1
            for i in np.flatnonzero(known < 1 / 3):
                estimate = float(np.dot(weights, [1.0, *formula_parts(parts, familiar)[:2]])) if (parts := parts_of(found[i])) else 1.0
                level[i] = min(max(math.floor(estimate + 0.5), 1), LEVELS)
            yield frame[["doc_id", "source"]].assign(level=level, share=held[np.arange(len(held)), level - 1], known=known)

    return texts.mapInPandas(run, "doc_id bigint, source string, level int, share double, known double")
