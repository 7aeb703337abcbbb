"""Scalar functions against plain Python on small inputs."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from recallspark.functions import dates as D
from recallspark.functions import jsonx, phrases
from recallspark.functions import text as T


def one(spark, value, column, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first().r


def test_tokens_are_unicode(spark):
    for text in ("été d'un ½ x_1", "", None, "ÀB  cd"):
        got = one(spark, text, T.tokens(F.col("x")))
        assert got == re.findall(r"\w+", (text or "").lower())


def test_stem_keeps_list_order(spark):
    words = {"walking": "walk", "boxes": "box", "is": "is", "kindness": "kind", "vacation": "vaca"}
    for w, s in words.items():
        assert one(spark, w, T.stem(F.col("x"))) == s


@pytest.mark.parametrize("p,g,f1", [("the cat", "a cat", 1.0), ("", "", 1.0), (None, "x", 0.0), ("a b c d", "d", 0.5), ("x", "y", 0.0)])
def test_token_f1(spark, p, g, f1):
    r = spark.createDataFrame([(p, g)], "p string, g string").select(T.token_f1(F.col("p"), F.col("g")).alias("r")).first().r
    assert r == pytest.approx({"a b c d": 2 / 4}.get(p, f1))


def test_dates(spark):
    cases = {"1:56 pm on 8 May, 2023": date(2023, 5, 8), "2023-01-02T03:04:05": date(2023, 1, 2), "30 February 2023": None, "": None, None: None, "3 Sept 2021": date(2021, 9, 3)}
    for text, day in cases.items():
        assert one(spark, text, D.parse_session_date(F.col("x"))) == day
    assert one(spark, date(2024, 3, 31), D.months_back(F.col("x"), 1), "x date") == date(2024, 2, 29)
    assert one(spark, date(2024, 1, 1), D.last_weekday(F.col("x"), 0), "x date") == date(2023, 12, 25)


def test_phrases():
    day = date(2023, 5, 10)
    assert phrases.annotate("I came yesterday", day) == "I came yesterday (9 May 2023)"
    assert phrases.annotate("the day before yesterday", day).count("(") == 2
    assert phrases.annotate("the day before yesterday", day, nested=False).count("(") == 1
    assert "April 2023" in phrases.annotate("last month", day) and "1 May 2023" in phrases.annotate("last Monday", date(2023, 5, 8))
    assert phrases.annotate(None, day) is None and phrases.annotate("two weeks ago", day).endswith("(26 April 2023)")
    assert phrases.question_windows("what happened last month", day) == [(date(2023, 4, 1), date(2023, 4, 30))]


def test_json():
    assert jsonx.balanced_object('x {"a": "}"} y') == '{"a": "}"}'
    assert jsonx.balanced_object("{bad} {\"a\": 1}") == '{"a": 1}'
    assert jsonx.salvage_object('{"a": [1, 2, {"b": "cu') is not None
    assert jsonx.balanced_object(None) is None and jsonx.salvage_object("none") is None


def test_final_line_and_answer(spark):
    assert one(spark, "so\nanswer: a\nAnswer: b c\n", T.final_line(F.col("x"))) == "b c"
    assert one(spark, "one\ntwo\n \n", T.final_line(F.col("x"))) == "two"
    assert one(spark, "```json\n{\"answer\": \"yes\"}\n```", T.answer_text(F.col("x"))) == "yes"
