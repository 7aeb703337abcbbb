"""Broken question-answer pairs: ordered rules, each naming its defect.

Order: empty, copy, refusal, language, truncated. The operator emits every defect
that triggers; a report that wants one takes the first. Truncation comes from
``endings`` (near-copies, closing words), the others look at one side alone.

Defined results: NULL is empty; a NULL question makes no copy and no language
defect; quotations are left out of the language test; an answer without at least
two telling words or letters of another script has no language defect; repeated
ids count once, rows without an id are dropped, further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.answers import has_letters, unwrap, words
from recallspark.llm.endings import find_cut, repeats, sides_of
from recallspark.session import stash

ORDER = ["empty", "copy", "refusal", "language", "truncated"]

#: Contents that stand for no answer.
PLACEHOLDERS = frozenset("null none nil nan n/a na tbd todo answer answer: undefined empty blank placeholder".split())
#: One-word refusals.
REFUSING_WORDS = frozenset("not_found unanswerable not_answerable notfound no_answer".split())

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the and was to of at with for is had who because it that after before times has since my she if we not in on a",
    "fr": "le la les des est et du une un dans pour avec parce que au pas il fois était de en à a avant on nous mon mais très sur qui",
    "de": "der die das und ist war hat nicht mit ein eine einen zu weil nach den dem im auf mal ich wir sich von vor aber sehr als",
    "es": "el la los las y fue una para por porque del al su está había de en a veces un muy pero mi nos ya con antes qué cuando todo",
    "it": "il lo gli della di è ha per che con una nel dopo perché aveva del alla la le a in era stato molto",
    "pt": "os da em foi com uma um para porque não na depois das dos mais de a antes muito tinha que",
    "nl": "het een en van was met voor niet omdat naar zijn had op aan na de dat te toen de in die zich dan veel",
}
#: Letters that tell a language (half a word's weight).
TELLING_LETTERS = {"fr": "èêçœûî", "de": "äöüß", "es": "ñóíú¿", "it": "òù", "pt": "ãõ"}
_LANGUAGES = list(FUNCTION_WORDS)
_TELLING = {w: [la for la in _LANGUAGES if w in FUNCTION_WORDS[la].split()] for la in _LANGUAGES for w in FUNCTION_WORDS[la].split()}
#: Question words, which decide a question's language first.
QUESTION_WORDS = {
    "en": "who what when where why how which whose", "fr": "qui où quand pourquoi comment combien que qu'est-ce quel quelle quels quelles",
    "de": "wer was wann wo wohin warum wie wem wen welche welcher welches", "es": "quién qué cuándo dónde adónde por cómo cuántas cuántos cuál quiénes",
}
_QUOTED = re.compile(r"[\"“«„‹][^\"”»“›]*[\"”»“›]|(?<!\w)['‘][^'’]{3,}['’](?!\w)")

_HEDGE = (
    r"(?:(?:unfortunately|sorry|i'?m (?:very )?sorry|i am (?:very )?sorry|i apologi[sz]e|as far as i can tell|regrettably|"
    r"leider|es tut mir leid|tut mir leid|désolée?|je suis désolée?|malheureusement|lo siento|lamentablemente|desafortunadamente|por desgracia|lo lamento)"
    r"(?:\s*[,.:;]?\s*(?:but|aber|mais|pero)?(?:\s+hier)?)?\s*)*"
)
_CORES = [
    r"i (?:cannot|can'?t|can not|could not|couldn'?t|do not|don'?t|am not|won'?t|will not|would rather not|would prefer not|must decline|prefer not|am unable|decline)\b",
    r"i'?m (?:not (?:able|allowed|permitted|sure)|unable)\b",
    r"(?:that|this|it) (?:is|was) (?:not|n't) (?:something|possible|clear|mentioned|stated|known)\b|that'?s not something",
    r"(?:this|the|that) question (?:cannot|can'?t|can not) be answered",
    r"(?:the|these|this|your) (?:conversation|conversations|excerpts?|memory|memories|episodes?|notes?|context|text|dialogue|passages?)\b[^.,;]{0,40}?\b(?:never|not|no|nothing|don'?t|doesn'?t)\b",
    r"there (?:is|was|are) (?:nothing|no (?:information|mention|answer|evidence|record))\b",
    r"no (?:answer|information|mention|evidence|record)s?\b[^.,;]{0,30}?\b(?:found|available|given|exists?|provided)",
    r"(?:dazu |hier |das |ich |es |darauf |darüber |diese frage )*(?:darf|kann|könnte|möchte|will|muss|weiß|habe|finde|reichen|liegen|lässt|lassen|gibt|geht|enthalten|steht)\b[^.,;]{0,80}?\b(?:nicht|nichts|keine?|keinen|passen|nirgends)\b",
    r"(?:die|das|der) (?:auszüge?|gespräch|unterhaltung|frage|episoden|notizen|text|kontext)\b[^.,;]{0,80}?\b(?:nicht|nichts|keine?|keinen|nirgends|nie)\b",
    r"(?:meine|die) informationen? reich\w* [^.,;]{0,20}nicht",
    r"je (?:n'|ne |préfère ne |refuse de |suis (?:dans l'incapacité|incapable))",
    r"il (?:m'est|n'est pas|est) impossible|il n'y a (?:rien|aucune?|pas)|(?:rien|aucune? (?:information|réponse|mention))\b[^.,;]{0,40}\b(?:ne|n')",
    r"(?:la|les|le|ces?|cette) (?:conversation|extraits?|épisodes?|notes?|mémoire|contexte|question)\b[^.,;]{0,30}?\b(?:n'|ne )",
    r"cela n'est pas|ce n'est pas (?:précisé|mentionné)",
    r"(?:yo )?no (?:puedo|podría|estoy|dispongo|tengo|sé|hay|encuentro|me es|se (?:puede|menciona|indica)|consta)\b|me (?:es|resulta) imposible|prefiero no\b|me niego\b",
    r"(?:la|los|las|el|esta) (?:conversación|fragmentos?|extractos?|episodios?|notas?|memoria|contexto|pregunta)\b[^.,;]{0,20}?\bno\b",
]
REFUSAL = re.compile("^" + _HEDGE + "(?:" + "|".join(_CORES) + ")", re.I)
#: A clause that answers after all.
BUT = re.compile(r"[,;]\s*(?:but|however|yet|aber|doch|mais|pero)\s+(?!hier\b)(?P<rest>\S.*)", re.I | re.S)
POLITE = re.compile(r"please|could you|can you|merci|pourriez|bitte|könnten|könntest|por favor|¿?podr[ií]as?|puede|reformul|précis|context|rephrase|kontext|contexto", re.I)


def is_empty(content: str) -> bool:
    bare = content.strip().strip(".:-–—*_`'\"()[]{}<>|/\\ ").lower()
    return not has_letters(content) or bare in PLACEHOLDERS


def is_refusal(content: str) -> bool:
    """Whether the text declines and says nothing beside it."""
    text = content.strip().replace("’", "'")
    word = re.match(r"^[\w-]+", text)
    if word and word.group(0).lower().replace("-", "_") in REFUSING_WORDS:
        return True
    m = REFUSAL.match(text)
    if not m:
        return False
    sentences = re.split(r"(?<=[.!?])\s+", text)
    if b := BUT.search(sentences[0], m.end()):
        if not REFUSAL.match(b.group("rest")):
            return False
    rest = [s for s in sentences[1:] if has_letters(s)]
    return all(POLITE.search(s) or REFUSAL.match(s) for s in rest)


class _Weights(dict):
    """Weight of a lower-case word for each language, as (number of the language, weight)."""

    def __missing__(self, low: str) -> tuple[tuple[int, float], ...]:
        if len(self) > 200_000:
            self.clear()
        found: dict[int, float] = {}
        for part in {low, *re.split(r"['’]", low)[-1:]}:
            for la in _TELLING.get(part, ()):
                n = _LANGUAGES.index(la)
                found[n] = found.get(n, 0) + 1 / len(_TELLING[part])
        for la, letters in TELLING_LETTERS.items():
            if any(c in letters for c in low):
                n = _LANGUAGES.index(la)
                found[n] = found.get(n, 0) + 0.5
        weights = self[low] = tuple(found.items())
        return weights


_WEIGHTS = _Weights()


def language_scores(text: str) -> dict[str, float]:
    """Weight of telling words and letters by language; what languages share counts less."""
    scores = [0.0] * len(_LANGUAGES)
    for w in words(text):
        for n, x in _WEIGHTS[w.lower()]:
            scores[n] += x
    return dict(zip(_LANGUAGES, scores))


def foreign_script(text: str) -> float:
    """Share of letters that are not Latin."""
    if text.isascii():
        return 0.0
    letters = [c for c in text if c.isalpha()]
    return sum(ord(c) > 0x24F and not unicodedata.name(c, "").startswith("LATIN") for c in letters) / len(letters) if letters else 0.0


@lru_cache(4096)
def question_language(question: str) -> str | None:
    lead = [w.lower() for w in words(question) if w[0].isalnum()]
    for w in lead:
        for la, listed in QUESTION_WORDS.items():
            if w in listed.split() and not (w == "was" and language_scores(question)["en"] > language_scores(question)["de"]):
                return la
    scores = language_scores(question)
    top = max(scores.values())
    return next((la for la in _LANGUAGES if scores[la] == top), None) if top else None


def is_foreign(question: str | None, content: str) -> bool:
    """Whether the text is in another language than the question."""
    if not question:
        return False
    if foreign_script(content) > 0.5 and foreign_script(question) < 0.5 and sum(c.isalpha() for c in content) >= 4:
        return True
    own = question_language(question)
    if own is None:
        return False
    scores = language_scores(_QUOTED.sub(" ", content))
    other = max(v for la, v in scores.items() if la != own)
    return other >= 1 and other >= scores[own] + 0.8 and other >= 1.5 * scores[own]


def own_defects(question: str | None, text: str | None) -> list[str]:
    """The defects visible in one side alone, in order."""
    content = unwrap(text).text
    if is_empty(content):
        return ["empty"]
    plain = [w.lower() for w in words(content) if w[0].isalnum()]
    asked = sorted(w.lower() for w in words(question or "") if w[0].isalnum())
    found = []
    if plain and asked and repeats(plain, asked):
        found.append("copy")
    if is_refusal(content):
        found.append("refusal")
    if is_foreign(question, content):
        found.append("language")
    return found


def find_defects(records: DataFrame) -> DataFrame:
    """pq_id, side, defects (array, in order) of every side with a defect."""
    return defects_of(find_cut(stash(sides_of(records, own_defects), "sides")))


def defects_of(cut: DataFrame) -> DataFrame:
    """As ``find_defects``, from judged sides that were prepared with ``own_defects``."""
    late = F.when(F.col("cut") & ~F.array_contains("found", "empty"), F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>"))
    return cut.select("pq_id", "side", F.concat("found", late).alias("defects")).where(F.size("defects") > 0)
