"""JSON inside free text: the first balanced object, and what a cut one still holds."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def balanced_object(text: str | None) -> str | None:
    """The first ``{...}`` with balanced braces outside strings that parses."""
    if not text:
        return None
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if escaped:
                escaped = False
            elif quoted:
                escaped, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    found = text[start : i + 1]
                    try:
                        json.loads(found)
                        return found
                    except ValueError:
                        break
        start = text.find("{", start + 1)
    return None


def salvage_object(text: str | None) -> str | None:
    """As ``balanced_object``; a cut object is closed behind its last complete element."""
    whole = balanced_object(text)
    if whole or not text or "{" not in text:
        return whole
    body = text[text.index("{") :]
    ends = [m.end() for m in re.finditer(r'[\]}"\d]|true|false|null', body)]
    for end in reversed(ends):
        part, closers, quoted, escaped = body[:end], [], False, False
        for c in part:
            if escaped:
                escaped = False
            elif quoted:
                escaped, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                closers.append("}" if c == "{" else "]")
            elif c in "}]" and closers:
                closers.pop()
        if quoted:
            continue
        try:
            return json.dumps(json.loads(part + "".join(reversed(closers))), ensure_ascii=False)
        except ValueError:
            continue
    return None


def items_of(found: Column, name: str, schema: str) -> Column:
    """The objects of the array ``name`` of a JSON object, each read by itself, so one that does not fit costs none of the others.

    Items that are no objects are left out; a field of another type than its own is NULL.
    """
    texts = F.from_json(found, f"{name} array<string>")[name]
    objects = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.trim(x).startswith("{"))
    return F.transform(objects, lambda x: F.from_json(x, schema))


_VALUE, _GAP = json.JSONDecoder(strict=False).raw_decode, re.compile(r"[ \t\n\r]*")


def _texts(text: str) -> dict[str, str | None] | list[str | None]:
    """A JSON object's or array's values as text, as ``from_json`` gives them for strings: numbers as written, objects without spaces."""
    gap = lambda i: _GAP.match(text, i).end()
    at, named = gap(0), {}
    close, at = {"{": "}", "[": "]"}[text[at]], gap(at + 1)
    while text[at] != close:
        key = len(named)
        if close == "}":
            key, at = scanstring(text, at + 1, False)
            at = gap(gap(at) + 1)
        value, end = _VALUE(text, at)
        nested = json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict | list) else text[at:end]
        named[key] = value if value is None or isinstance(value, str) else nested
        at = gap(end)
        at = gap(at + 1) if text[at] == "," else at
    return named if close == "}" else list(named.values())


def items_in(found: str | None, name: str, fields: list[str]) -> list[dict[str, str | None]]:
    """``items_of`` outside Spark: the objects of the array ``name``, with ``fields`` as text or None."""
    items = []
    try:
        whole = (_texts(found) if found else {}).get(name) or ""
        texts = _texts(whole) if whole.startswith("[") else []
    except (ValueError, LookupError):
        return []
    for text in texts:
        if (text or "").strip(" ").startswith("{"):
            try:
                held = _texts(text.strip(" "))
            except (ValueError, LookupError):
                held = {}
            items.append({f: held.get(f) for f in fields})
    return items


@F.pandas_udf(StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    return text.map(balanced_object)


@F.pandas_udf(StringType())
def salvaged_json(text: pd.Series) -> pd.Series:
    return text.map(salvage_object)
