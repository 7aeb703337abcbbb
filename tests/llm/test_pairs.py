"""Cut texts, defects and reading levels."""

from datetime import datetime

import pytest

from recallspark.llm.answers import unwrap
from recallspark.llm.endings import find_cut, goes_on, sides_of
from recallspark.llm.levels import clean, familiar_word_scores, reading_levels, sentences
from recallspark.llm.pairs import find_defects, is_empty, is_foreign, is_refusal, own_defects
from recallspark.session import stash

SHELLS = [
    ('{"answer": "yes."}', "yes.", False, False), ('```json\n{"answer": "half', "half", True, False), ("ANSWER: yes", "yes", False, False), ("(a b)", "a b", False, False),
    ("so it wen [...]", "so it wen", False, True), ("so it wen…", "so it wen", False, True), ("", "", False, False), (None, "", False, False), ("​", "", False, False),
    ("<answer></answer>", "", False, False), ('{"answer": ""}', "", False, False), ("**bold**", "bold", False, False), ("...", "", False, False),
]


@pytest.mark.parametrize("text,bare,unclosed,marked", SHELLS)
def test_unwrap(text, bare, unclosed, marked):
    c = unwrap(text)
    assert (c.text, c.unclosed, c.marked) == (bare, unclosed, marked)


@pytest.mark.parametrize("text", ["NOT_FOUND", "Unfortunately, I cannot answer this. Please give more context.", "Leider kann ich dazu keine Auskunft geben.", "Je ne peux pas répondre à cette question.", "No puedo responder a esta pregunta."])
def test_refusals(text):
    assert is_refusal(text)


@pytest.mark.parametrize("text", ["Ann declined the offer.", "I'm not entirely sure, but Ann gave it to Bo.", "The excerpts do not mention a year, but Ann moved it.", "Bo refused to answer the phone.", "Ann said sorry to Bo."])
def test_sound_answers_like_refusals(text):
    assert not is_refusal(text)


def test_other_rules():
    assert is_empty("null") and is_empty("-") and not is_empty("7")
    assert own_defects("Who helped Ann?", "Helped Ann who?") == ["copy"] and own_defects("Who helped Ann?", "Who helped Ann? Bo helped Ann.") == []
    assert is_foreign("Who helped Ann before the fair?", "Перед отъездом помогла соседка.") and not is_foreign("Qui a aidé Ann ?", "le 8 mai 2023")
    assert not is_foreign("Who sang it?", 'Ann called the song "Der kleine Garten am See und das Haus" and sang it.')
    assert own_defects(None, None) == ["empty"] and own_defects(None, "yes") == []


RECORDS = "pq_id bigint, run_name string, sample string, question string, gold string, prediction string, ingested_at timestamp, side string, words string"


def records(spark, rows):
    return spark.createDataFrame([(i, "r", "s", q, g, p, datetime(2024, 1, 1), "x", "y") for i, q, g, p in rows], RECORDS)


def test_cut_records(spark):
    whole = [(i, "Where did they go?", "to the old harbour", f"They went to the old harbour with friend{i}. After the rain they sat down and talked about the garden. We laughed.") for i in range(30)]
    odd = [
        (100, "Where did they go?", "to the old harbour", "They went to the old harbour with friend1. After the rain they sat do"),
        (101, "Where did they go?", "to the old harbour", "They went to the old harbour with friend2. After the rain they sat down and talked about the"),
        (102, "Where did they go?", "to the old harbour", "to the old harbour"), (103, "Where did they go?", "x", None), (104, None, None, "   "),
        (105, "Where did they go?", "to the old harbour", "Where did they go"), (106, "Where did they go?", "to the old harbour", "After the rain,"), (None, "q", "g", "After the"),
    ]
    rows = records(spark, whole + odd + odd[:2])
    cut = {(r.pq_id, r.side) for r in find_cut(stash(sides_of(rows))).where("cut").collect()}
    assert cut == {(100, "prediction"), (101, "prediction"), (106, "prediction")}
    found = {(r.pq_id, r.side): list(r.defects) for r in find_defects(rows).collect()}
    assert found[(100, "prediction")] == ["truncated"] and found[(103, "prediction")] == ["empty"] and found[(105, "prediction")] == ["copy"]
    assert (102, "prediction") not in found and not any(k[0] < 100 for k in found)
    assert find_defects(records(spark, [])).count() == 0


def test_alignment():
    b = "we all went down to the old harbour with some friends and sat there until it rained".split()
    assert goes_on(b[:15], b) and not goes_on(b, b) and not goes_on(["a"], b)


DOCS = "doc_id bigint, text string, source string, level int, share string"
EASY, HARD = "The cat is red. I like the dog. We ran to the park. ", "Such hermeneutic ambiguity attenuates the phenomenological regularities of counterfactual attribution. "


def test_levels(spark):
    docs = [(i, (EASY if i % 2 else HARD) * (6 if i % 2 else 9), "s", 9, "x") for i in range(60)]
    docs += [(100, None, "s", 1, "x"), (101, "few words", "s", 1, "x"), (102, "7 " * 50, None, 1, "x"), (103, EASY * 300 + HARD, "s", 1, "x"), (104, HARD.upper() * 9, "s", 1, "x")]
    labels = [(i, "r", 1 if i % 2 else 5) for i in range(40)] + [(0, "q", None), (None, "q", 3)]
    d = spark.createDataFrame(docs, DOCS)
    lab = lambda rows: spark.createDataFrame(rows, "doc_id bigint, rater string, level int")
    got = {r.doc_id: r.level for r in reading_levels(d, lab(labels)).collect()}
    assert all(got[i] == (1 if i % 2 else 5) for i in range(60))
    assert 100 not in got and 101 not in got and got[103] == 1 and got[104] == 5 and 1 <= got[102] <= 5
    none = {r.level for r in reading_levels(d, lab([])).collect()}
    assert none == {1, 3}  # 1 for the text without a word
    scores = {r.doc_id: r for r in familiar_word_scores(d).collect()}
    assert scores[0].sentence_length > scores[1].sentence_length
    assert reading_levels(d.where("1 = 0"), lab(labels)).count() == 0


def test_layout_is_dropped():
    text = "Speaker Ann says: Hello there.\n2023-05-08 13:56:02 INFO indexed\n- item **one**\n## Heading Words\n[Image: a cat]\n(No. 7) End."
    assert "INFO" not in clean(text) and "Heading" not in clean(text) and sentences(text)[0] == ["hello", "there"]
