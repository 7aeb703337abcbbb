"""String expressions: tokens, stems, overlaps, speakers, answers (JVM-side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script; Java's own word class is ASCII only.
TOKEN = r"([\p{L}\p{N}_]+)"

#: Suffixes in the order they are tried.
SUFFIXES = ["ing", "tion", "ations", "ation", "ness", "ment", "able", "ible", "ly", "ed", "er", "est", "es", "s"]

#: Capitalised words that name nobody.
STOP_CAPITALS = (
    "The This That There These Those It He She They We You I A An And But Or If When What Where How Why Who "
    "Speaker Date Image Yes No Hey Hi Hello Oh Wow Yeah Thanks Sorry Well So My Your His Her Their Our Its Not Just "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "January February March April May June July August September October November December"
).split()

#: Names of the question categories.
CATEGORIES = {1: "multi_hop", 2: "temporal", 3: "open_domain", 4: "single_hop", 5: "adversarial"}

#: How an episode's text names its date and speaker, and what counts as a name.
ATTRIBUTION = r"(?m)^\s*(?:DATE:[^|\n]*\|\s*)?(?:[A-Z][\w'-]*(?:\s+[A-Z][\w'-]*)?\s+says:\s*)"


SPEAKER = r"Speaker\s+([A-Z][A-Za-z\-']+)\s+says"
CAPITALISED = r"\b([A-Z][a-z]{2,})\b"


def bound(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of both columns, each evaluated once a row, also where ``f`` uses them in lambdas."""
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: f(s["a"], s["b"]))[0]


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters, duplicates kept; NULL gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def normalise(text: Column) -> Column:
    """Lower case without anything but word characters and space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""))


def token_count(text: Column) -> Column:
    """Runs of non-space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def stem(word: Column) -> Column:
    """The word without the first listed suffix that leaves three letters."""
    low = F.lower(word)
    out = low
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        out = F.when(low.endswith(suffix) & (F.length(low) >= n + 3), F.substring(low, F.lit(1), F.length(low) - n)).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays, 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def fuzzy_overlap(query: Column, doc: Column) -> Column:
    """Share of distinct query tokens whose stem the document has, or has within one edit if short."""

    def share(wanted: Column, stems: Column) -> Column:
        def hit(s: Column) -> Column:
            near = F.exists(stems, lambda d: (F.length(d) <= 6) & (F.levenshtein(s, d) <= 1))
            return F.array_contains(stems, s) | ((F.length(s) <= 6) & near)

        return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, hit)) / F.size(wanted)).otherwise(F.lit(0.0))

    return bound(F.transform(F.array_distinct(query), stem), F.array_distinct(F.transform(doc, stem)), share)


def speakers_of(text: Column) -> Column:
    """Names in ``Speaker X says``."""
    return F.regexp_extract_all(text, F.lit(SPEAKER), F.lit(1))


def capitalised(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(1))


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?:])\s+|\n")


def first_sentence(text: Column, most: int = 200) -> Column:
    return F.substring(F.element_at(F.split(text, r"(?<=[.!?])\s+"), 1), 1, most)


def strip_attribution(text: Column) -> Column:
    """Without ``DATE: ... | Name says:`` at line starts."""
    return F.regexp_replace(text, ATTRIBUTION, "")


def strip_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", ""))


def answer_text(text: Column) -> Column:
    """The bare answer: JSON field ``answer`` if there is one, label and quotes dropped."""
    bare = strip_fence(text)
    is_json = F.trim(bare).startswith("{")
    field = F.when(is_json & F.is_valid_json(bare) if hasattr(F, "is_valid_json") else is_json, F.get_json_object(bare, "$.answer"))
    plain = F.regexp_replace(F.coalesce(field, bare), r"(?i)^\s*answer\s*:\s*", "")
    return F.trim(F.regexp_replace(F.trim(plain), r"^[\"']|[\"']$", ""))


def final_line(text: Column) -> Column:
    """What follows the last ``answer:``, else the last line that is not blank."""
    label = F.regexp_extract(text, r"(?is).*\banswer\s*:[ \t]*([^\n]*)", 1)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.trim(F.when(label != "", label).otherwise(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))))


def abstained(text: Column) -> Column:
    return F.upper(F.trim(F.coalesce(text, F.lit("")))).startswith("NOT_FOUND")


def normalise_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation and English articles dropped, space squeezed."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"[\s\u00a0\u2000-\u200a\u202f\u3000]+", " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalise_answer(text), " "), lambda x: x != "")


def overlap_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    return F.aggregate(
        F.array_distinct(a), F.lit(0),
        lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))),
    )


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalise_answer(prediction) == normalise_answer(gold)).cast("double")


def token_f1(prediction: Column, gold: Column) -> Column:
    def score(a: Column, b: Column) -> Column:
        n = overlap_count(a, b)
        return (
            F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
            .when((F.size(a) == 0) | (F.size(b) == 0) | (n == 0), 0.0)
            .otherwise(2.0 * n / (F.size(a) + F.size(b)))
        )

    return bound(answer_tokens(prediction), answer_tokens(gold), score)


def bleu1(prediction: Column, gold: Column) -> Column:
    def score(a: Column, b: Column) -> Column:
        n = overlap_count(a, b)
        precision = F.when(n == 0, 0.1 / F.size(a)).otherwise(n / F.size(a))
        brevity = F.when(F.size(a) >= F.size(b), 1.0).otherwise(F.exp(1 - F.size(b) / F.size(a)))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(brevity * precision)

    return bound(answer_tokens(prediction), answer_tokens(gold), score)


def category_label(category: Column) -> Column:
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), category)
    return F.coalesce(named, F.concat(F.lit("cat_"), F.coalesce(category.cast("string"), F.lit("None"))))


def approximate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def judge_key(version: str, tag: str, question: Column, gold: Column, prediction: Column) -> Column:
    parts = [F.lit(version), F.lit(tag), *[F.coalesce(c, F.lit("")) for c in (question, gold, prediction)]]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def caption_fused(text: Column, caption: Column) -> Column:
    """Text with ``[Image: caption]`` behind, if there is a caption."""
    return F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.coalesce(text, F.lit("")), F.lit(" [Image: "), caption, F.lit("]"))).otherwise(text)


def concise(caption: Column, words: int = 20) -> Column:
    parts = F.split(F.trim(caption), r"\s+")
    return F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("..."))).otherwise(F.array_join(parts, " "))
