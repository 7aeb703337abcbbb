"""What an answer says without what was put around it."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

#: Marks left where a text was cut: they end nothing by themselves.
CUT_MARKS = re.compile(r"(?:\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|<\||&#?\w{0,6}|\\\w{0,5}|�+))+\s*$")
LABEL = re.compile(r"^\s*(?:final\s+)?(?:answer|antwort|réponse|reponse|respuesta|prediction|output|a)\s*[:：]\s*", re.I)
FENCE = re.compile(r"^\s*```[\w-]*[ \t]*\n?|\n?\s*```\s*$")
FIELD = re.compile(r'^\s*\{?\s*"?(?:answer|prediction|text|response)"?\s*:\s*"?', re.I)
AFTER_FIELD = re.compile(r'"\s*,\s*"\w*"?\s*(?::\s*(?:"[^"]*"?|[\d.]*|null|true|false)?)?\s*\}?\s*$')
TAG = re.compile(r"^\s*<(\w+)>\s*|\s*</\w+>\s*$|\s*</?\w*$")
PAIRS = {"(": ")", "[": "]", "{": "}", '"': '"', "“": "”", "«": "»", "'": "'", "‘": "’", "*": "*", "_": "_", "`": "`"}
INVISIBLE = {"Cf", "Cc", "Co", "Cn", "Zs", "Zl", "Zp"}

WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[^\W_]+['’]|[.,;:!?…。！？]+", re.UNICODE)
STOP = re.compile(r"^[.!?…。！？]+$")


@dataclass
class Content:
    """The bare text; whether a wrapper was left open; whether a cut mark followed."""

    text: str
    unclosed: bool
    marked: bool


def visible(text: str | None) -> str:
    """The text without invisible characters at its ends."""
    if not text:
        return ""
    lo, hi = 0, len(text)
    while lo < hi and unicodedata.category(text[lo]) in INVISIBLE:
        lo += 1
    while hi > lo and unicodedata.category(text[hi - 1]) in INVISIBLE:
        hi -= 1
    return text[lo:hi]


def unwrap(text: str | None) -> Content:
    """Strip fences, JSON shells, tags, labels, quoting and cut marks, in any nesting."""
    s, unclosed, marked = visible(text), False, False
    for _ in range(8):
        before = s
        if m := CUT_MARKS.search(s):
            if m.start():
                s, marked = s[: m.start()], True
            else:
                s = ""
        if s.lstrip().startswith("```") or s.rstrip().endswith("```"):
            opened = s.lstrip().startswith("```")
            closed = len(s.strip()) > 3 and s.rstrip().endswith("```")
            unclosed |= opened and not closed
            s = FENCE.sub("", FENCE.sub("", s))
        head = FIELD.match(s)
        if head and '"' in head.group(0):
            rest = s[head.end() :]
            if m := AFTER_FIELD.search(rest):
                complete = rest[m.start() :].rstrip().endswith("}")
                rest = rest[: m.start()]
                unclosed |= not complete
            elif m := re.search(r'"?\s*\}\s*$', rest):
                rest = rest[: m.start()]
            elif rest.rstrip().endswith('"'):
                rest, unclosed = rest.rstrip()[:-1], True
            else:
                unclosed = True
            s = rest.replace('\\"', '"')
        elif re.fullmatch(r"[\s{}\[\]\"']*", s):
            s = ""
        s = re.sub(r"^\s*>\s*", "", s)
        if m := re.match(r"^\s*<(\w+)>\s*", s):
            closing = f"</{m.group(1)}>"
            unclosed |= closing not in s
            s = s[m.end() :].replace(closing, "")
        s = LABEL.sub("", s)
        s = visible(s)
        if len(s) > 1 and s[0] in PAIRS:
            close = PAIRS[s[0]]
            end = s.rstrip()
            if end.endswith(close) and end.count(s[0]) <= (2 if s[0] == close else end.count(close)) or (s.startswith("**") and end.endswith("**")):
                s = end[1:-1]
            elif s[0] in "({[\"“«`" and close not in s[1:]:
                unclosed |= s[0] in "({[\"“«"
                s = s[1:]
        s = visible(s)
        if s == before:
            break
    return Content(s, unclosed, marked)


@lru_cache(4096)
def words(text: str) -> tuple[str, ...]:
    """Words and runs of punctuation, in order; rules ask for the same text several times."""
    return tuple(WORD.findall(text))


def is_stop(token: str) -> bool:
    return bool(STOP.match(token))


def has_letters(text: str) -> bool:
    return any(c.isalnum() for c in text)
