"""Date expressions: session stamps, month arithmetic, weekdays (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month numbers by their first three letters.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def month_number(name: Column) -> Column:
    """1..12 from a month name or abbreviation, else NULL."""
    key = F.substring(F.lower(name), 1, 3)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), key)


def try_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL where the parts name no day of the calendar."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def parse_session_date(text: Column) -> Column:
    """DATE of a stamp: an ISO prefix, else ``d Month[,] yyyy`` anywhere in it.

    Null, blank and unreadable stamps, and impossible days, give NULL.
    """
    iso = F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1)
    words = r"(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})"
    day, month, year = (F.regexp_extract(text, words, i) for i in (1, 2, 3))
    spoken = try_date(year.try_cast("int"), month_number(month), day.try_cast("int"))
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).otherwise(F.when(day != "", spoken))


def iso_day(text: Column) -> Column:
    """The stamp's day as yyyy-MM-dd; a stamp that cannot be read stays as it is."""
    return F.coalesce(F.date_format(parse_session_date(text), "yyyy-MM-dd"), text)


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO stamp (UTC if it names no zone), else NULL."""
    iso = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(text.rlike(iso), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def in_windows(day: Column, windows: Column) -> Column:
    """Whether the day lies in any of the windows (array of struct lo, hi); true where there is none. Off unless asked for."""
    return (F.size(windows) <= 0) | F.exists(windows, lambda w: (day >= w["lo"]) & (day <= w["hi"]))


def format_day(date: Column) -> Column:
    """``7 May 2023``, without zero padding."""
    return F.date_format(date, "d MMMM yyyy")


def months_back(date: Column, k: int) -> Column:
    """The same day k months earlier, clamped to the end of the month."""
    return F.add_months(date, -k)


def first_of_month_back(date: Column, k: int) -> Column:
    return F.trunc(F.add_months(date, -k), "MM").cast("date")


def last_weekday(date: Column, target: int) -> Column:
    """The last ``target`` weekday (Monday 0) strictly before ``date``."""
    back = F.pmod(F.weekday(date) - F.lit(target), F.lit(7))
    return F.date_sub(date, F.when(back == 0, 7).otherwise(back).cast("int"))


def elapsed_phrase(date: Column, now: Column) -> Column:
    """``n day(s) before/after the current date``."""
    n = F.datediff(now, date)
    unit = F.when(F.abs(n) == 1, "day").otherwise("days")
    side = F.when(n > 0, "before").otherwise("after")
    return F.when(n == 0, "the current date").otherwise(
        F.concat_ws(" ", F.abs(n).cast("string"), unit, side, F.lit("the current date"))
    )
