"""Whole jobs of the training-data operators: what a cut would lose."""

from datetime import datetime

from recallspark.llm.endings import continued_copies, sides_of
from recallspark.llm.levels import reading_levels


def test_familiar_words_come_from_unrated_texts_too(spark):
    rare = lambda n: "x" + "".join("abcdefghij"[int(c)] for c in f"{n:06d}")
    easy = "the cat was at home. " * 12
    docs = [(i, easy) for i in range(60)] + [(60 + i, " ".join(f"the was {rare(40 * i + 3 * j)} {rare(40 * i + 3 * j + 1)} {rare(40 * i + 3 * j + 2)}." for j in range(12))) for i in range(60)]
    docs += [(200 + i, "Katze und Milch ist Hund. " * 12) for i in range(3)]
    rows = spark.createDataFrame([(i, "s", t) for i, t in docs], "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([(i, 1 if i < 60 else 5) for i in range(120)], "doc_id bigint, level int")
    got = {r.doc_id: (r.level, r.known) for r in reading_levels(rows, labels).where("doc_id >= 200").collect()}
    assert got == {200 + i: (1, 0.0) for i in range(3)}


def test_a_longer_text_in_the_bucket_does_not_hide_the_copy_that_goes_on(spark):
    base = [f"w{i // 26}{chr(97 + i % 26)}x" for i in range(60)]
    texts = [" ".join(base[:50]), " ".join(base[:54]) + ".", " ".join(base[:50] + [f"z{i}y" for i in range(30)]) + "."]
    at = datetime(2024, 1, 1)
    rows = [(i, at, "r", "c", "Which words?", "Yes.", t) for i, t in enumerate(texts)]
    records = spark.createDataFrame(rows, "pq_id bigint, ingested_at timestamp, run_name string, sample string, question string, gold string, prediction string")
    # all three share the bands of the first one's prefix
    assert [(r.pq_id, r.side) for r in continued_copies(sides_of(records)).collect()] == [(0, "prediction")]
