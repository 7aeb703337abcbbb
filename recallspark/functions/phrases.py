"""Relative dates in text: annotated in place from the day they were said.

Each family is a pattern and a function from match, anchor and the writer of days to
the note put in brackets behind it; phrases, their order and the wording of the notes
are fixed values. Families run in order over the growing text, so the yesterday
inside "the day before yesterday" is annotated as well; ``nested=False`` gives the
outer note alone.
"""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, StringType, StructField, StructType

WORD_NUMBERS = {w: i for i, w in enumerate("two three four five six seven eight nine ten".split(), 2)}
WEEKDAYS = [d.lower() for d in calendar.day_name]
COUNT = r"(\d{1,4}|" + "|".join(WORD_NUMBERS) + ")"


def shown(d: date) -> str:
    return f"{d.day} {calendar.month_name[d.month]} {d.year}"


def month_shifted(d: date, back: int) -> str | None:
    index = d.year * 12 + d.month - 1 - back
    return f"{calendar.month_name[index % 12 + 1]} {index // 12}" if index >= 12 else None


def elapsed(d: date, now: date) -> str:
    """How far the day lies from the current date, in words."""
    n = (now - d).days
    if not n:
        return "the current date"
    return f"{abs(n)} {'day' if abs(n) == 1 else 'days'} {'before' if n > 0 else 'after'} the current date"


def _number(word: str) -> int:
    return WORD_NUMBERS.get(word.lower()) or int(word) if word.isdigit() or word.lower() in WORD_NUMBERS else 0


def _days(n: int):
    def note(m: re.Match, anchor: date, day) -> str | None:
        try:
            return day(anchor - timedelta(days=n))
        except OverflowError:
            return None

    return note


def _ago(unit: int):
    def note(m: re.Match, anchor: date, day) -> str | None:
        return _days(_number(m.group(1)) * unit)(m, anchor, day) if _number(m.group(1)) else None

    return note


def _weekday(m: re.Match, anchor: date, day) -> str:
    back = (anchor.weekday() - WEEKDAYS.index(m.group(1).lower())) % 7 or 7
    return f"the {m.group(1)} before {shown(anchor)}, i.e. {day(anchor - timedelta(days=back))}"


#: The phrases, in the order in which they are annotated, and what is written behind them.
FAMILIES = [
    (r"\bthe day before yesterday\b", _days(2)), (r"\byesterday\b", _days(1)), (r"\btoday\b", _days(0)), (r"\btomorrow\b", _days(-1)),
    (rf"\b{COUNT}\s+days?\s+ago\b", _ago(1)), (rf"\b{COUNT}\s+weeks?\s+ago\b", _ago(7)),
    (r"\blast week\b", lambda m, a, day: f"the week before {shown(a)}"), (r"\bthis week\b", lambda m, a, day: f"the week of {shown(a)}"),
    (rf"\blast\s+({'|'.join(WEEKDAYS)})\b", _weekday),
    (r"\blast month\b", lambda m, a, day: month_shifted(a, 1)), (r"\bthis month\b", lambda m, a, day: month_shifted(a, 0)), (r"\bnext month\b", lambda m, a, day: month_shifted(a, -1)),
    (rf"\b{COUNT}\s+months?\s+ago\b", lambda m, a, day: month_shifted(a, _number(m.group(1))) if _number(m.group(1)) else None),
    (r"\blast year\b", lambda m, a, day: str(a.year - 1)), (r"\bthis year\b", lambda m, a, day: str(a.year)), (r"\bnext year\b", lambda m, a, day: str(a.year + 1)),
    (rf"\b{COUNT}\s+years?\s+ago\b", lambda m, a, day: str(a.year - _number(m.group(1))) if 0 < _number(m.group(1)) < a.year else None),
]
#: A text without any of these has nothing to annotate: asked on the JVM before Python sees it.
HINT_QUESTION = r"(?i)\b(?:yesterday|ago|last|past|this)\b"
HINT = r"(?i)\b(?:yesterday|today|tomorrow|ago|last|this|next)\b"
_COMPILED = [(re.compile(p, re.I), f) for p, f in FAMILIES]


def annotate(text: str | None, anchor: date | None, nested: bool = True, now: date | None = None) -> str | None:
    """The text with the resolved date behind every relative one; NULLs pass through.

    With ``now``, days also say how far they lie from it.
    """
    if not text or anchor is None or pd.isna(anchor):
        return text
    day = shown if now is None else lambda d: f"{shown(d)}, {elapsed(d, now)}"
    for i, (pattern, note) in enumerate(_COMPILED):

        def put(m: re.Match, note=note, i=i) -> str:
            if not nested and i == 1 and m.string[: m.start()].lower().endswith("the day before "):
                return m.group(0)
            said = note(m, anchor, day)
            return f"{m.group(0)} ({said})" if said else m.group(0)

        text = pattern.sub(put, text)
    return text


#: Numbers as questions write them.
QUESTION_NUMBERS = {"a": 1, "an": 1, "one": 1, "a couple of": 2} | {w: i for i, w in enumerate("two three four five six seven eight nine ten eleven twelve".split(), 2)}
_ANY = r"(\d{1,4}|a couple of|an|a|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
_UNIT = r"(day|week|month|year)"


def _same_day(d: date, months: int) -> date:
    """The day so many months before, or the last of its month."""
    index = d.year * 12 + d.month - 1 - months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1]))


def question_time(text: str | None, now: date | None) -> tuple[str | None, list[tuple[date, date]]]:
    """The question with its times resolved, and the day ranges of those that name a point.

    Points (N units ago, last Monday, yesterday, last week, weekend, month) give a window;
    ranges ("the past two weeks", "this month") and years are annotated only. Windows
    are reported, never applied unless asked for (``dates.in_windows``). A time before
    the calendar's first year stays unresolved.
    """
    if not text or now is None or pd.isna(now):
        return text, []
    windows: list[tuple[date, date]] = []
    back = lambda n: now - timedelta(days=n)
    number = lambda w: int(w) if w.isdigit() else QUESTION_NUMBERS.get(w.lower(), 0)

    def around(d: date, slack: int) -> None:
        span(d - timedelta(days=slack), d + timedelta(days=slack))

    def span(lo: date, hi: date) -> None:
        if (lo, hi) not in windows:
            windows.append((lo, hi))

    def start(n: int, unit: str) -> date:
        return back(n) if unit == "day" else back(7 * n) if unit == "week" else _same_day(now, n if unit == "month" else 12 * n)

    def ago(m: re.Match) -> str | None:
        n, unit = number(m.group(1)), m.group(2).lower()
        if n < 1:
            return None
        d = start(n, unit)
        if unit == "year":
            return f"around {calendar.month_name[d.month]} {d.year}"
        around(d, {"day": 1, "week": 3, "month": 15}[unit])
        return shown(d) if unit == "day" else f"around {shown(d)}"

    def weekday(m: re.Match) -> str:
        d = back((now.weekday() - WEEKDAYS.index(m.group(1).lower())) % 7 or 7)
        around(d, 1)
        return shown(d)

    def yesterday(m: re.Match) -> str:
        around(back(1), 1)
        return shown(back(1))

    def week(m: re.Match) -> str:
        monday = back(now.weekday() + 7)
        span(monday, monday + timedelta(days=6))
        return f"{shown(monday)} to {shown(monday + timedelta(days=6))}"

    def weekend(m: re.Match) -> str:
        since = (now.weekday() - 5) % 7  # on a weekend it is the one before
        saturday = back(since + 7 if since <= 1 else since)
        span(saturday, saturday + timedelta(days=1))
        return f"{shown(saturday)} to {shown(saturday + timedelta(days=1))}"

    def month(m: re.Match) -> str:
        last = now.replace(day=1) - timedelta(days=1)
        span(last.replace(day=1), last)
        return f"{calendar.month_name[last.month]} {last.year}"

    def since(m: re.Match) -> str | None:
        n = number(m.group(1)) if m.group(1) else 1
        return f"since {shown(start(n, m.group(2).lower()))}" if n > 0 else None

    def this(m: re.Match) -> str:
        unit = m.group(1).lower()
        return f"since {shown(back(now.weekday()) if unit == 'week' else now.replace(day=1) if unit == 'month' else now.replace(month=1, day=1))}"

    # The phrases in the order in which they are resolved.
    for pattern, note in (
        (rf"\b{_ANY}\s+{_UNIT}s?\s+ago\b", ago), (rf"\blast\s+({'|'.join(WEEKDAYS)})\b", weekday), (r"\byesterday\b", yesterday),
        (r"(?<!the )\blast week\b", week), (r"(?<!the )\blast weekend\b", weekend), (r"(?<!the )\blast month\b", month), (r"(?<!the )\blast year\b", lambda m: str(now.year - 1)),
        (rf"\bpast\s+(?:{_ANY}\s+)?{_UNIT}s?\b", since), (rf"\bthe\s+last\s+(?:{_ANY}\s+)?{_UNIT}s?\b", since), (rf"(?<!the )\blast\s+{_ANY}\s+{_UNIT}s\b", since),
        (r"\bthis\s+(week|month|year)\b", this),
    ):

        def put(m: re.Match, note=note) -> str:
            try:
                said = note(m)
            except (OverflowError, ValueError):
                said = None
            return f"{m.group(0)} ({said})" if said else m.group(0)

        text = re.sub(pattern, put, text, flags=re.I)
    return text, windows


def question_windows(text: str | None, now: date | None) -> list[tuple[date, date]]:
    """The day ranges a question speaks of."""
    return question_time(text, now)[1]


RESOLVED = StructType([StructField("text", StringType()), StructField("windows", ArrayType(StructType([StructField("lo", DateType()), StructField("hi", DateType())])))])


@F.pandas_udf(RESOLVED)
def resolve_question(text: pd.Series, now: pd.Series) -> pd.DataFrame:
    found = [question_time(t, n) for t, n in zip(text, now)]
    return pd.DataFrame({"text": [f[0] for f in found], "windows": [[{"lo": lo, "hi": hi} for lo, hi in f[1]] for f in found]})


@F.pandas_udf(StringType())
def annotate_dates_until(text: pd.Series, anchor: pd.Series, now: pd.Series) -> pd.Series:
    return pd.Series([annotate(t, a, now=None if pd.isna(n) else n) for t, a, n in zip(text, anchor, now)], index=text.index)


@F.pandas_udf(StringType())
def annotate_dates(text: pd.Series, anchor: pd.Series) -> pd.Series:
    return pd.Series([annotate(t, a) for t, a in zip(text, anchor)], index=text.index)
