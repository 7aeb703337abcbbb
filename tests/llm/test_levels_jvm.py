"""The JVM's cleaning against the patterns in Python."""

from recallspark.llm.levels import bodies, parts_of, sentences

TEXTS = [
    "Speaker Ann says: Hello there. 'Quoted' words, rock--n-roll!\n\n2023-05-08 13:56:02 INFO indexed\n- item **one** <b>x</b>\n## Heading Words\n[Image: a cat]\n(No. 7) End.",
    "Bob: yes\n\n* \nÉté d'un soir… (p. 12, 1999) — fin\n> cited\n{\"a\": 1}\n====\nD1:2; D3:4\nSELECT x FROM y;\nERR 404 gone\n",
    " ".join(f"word{'abc'[i % 3]}" for i in range(53)), " ".join(["long"] * 54), "one two", "", "123 456", "-\nfoo -bar- it's O’Neil's\nhttps://a.b/c d\nhttps://a.b/c",
    "line one (12\n13) [tag] text\r\nnext line", "A: b\nAb: c\nÄrger: laut! \"So.\" Er ging.",
]


def test_bodies_are_the_sentences(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: parts_of(r.body) for r in bodies(rows).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == sentences(text), text


def test_bodies_of_the_small_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: parts_of(r.body) for r in bodies(rows).collect()}
    assert [i for i in texts if got[i] != sentences(texts[i])] == []
