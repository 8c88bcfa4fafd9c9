"""Words, n-grams and marks counted in runs of texts equal those counted one by one, without a row for each."""

import random

from pyspark.sql import functions as F

from penstroke.operators import reference, vocabulary


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _docs(spark):
    draw, parts = random.Random(3), ["a", "b", "é", "中", " ", " ", "\n", ".", "7", "𝒜", "word "]
    texts = ["", None, "ab", "abc", "  ", *("".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(200))]
    return spark.createDataFrame([(i // 2 if i > 150 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_grams_are_counted_without_a_row_for_each(spark):
    docs = _docs(spark)
    for n in (2, 3, 5):
        plain = vocabulary.char_grams(docs, n)
        expected = {(r.gram, r.type): r["count"] for r in plain.groupBy("gram", "type").count().collect()}
        found = vocabulary.frequent_grams(docs, n, 1_000_000)
        assert {(r.gram, r.type): r.c for r in found.collect()} == expected
        assert "Generate" not in _plan(found)
        top = vocabulary.frequent_grams(docs, n, 30)
        named = plain.select("doc_id", F.concat_ws(":", "type", "gram").alias("term"))
        wanted = {(r.doc_id, r.term): r.value for r in vocabulary.rates(named, top.select(F.concat_ws(":", "type", "gram").alias("term"))).collect()}
        assert {(r.doc_id, r.term): r.value for r in vocabulary.gram_rates(docs, top, n).collect()} == wanted


def test_words_with_a_colon_are_measured(spark):
    docs = spark.createDataFrame([(1, "a:b a:b c"), (2, "c c b")], "doc_id long, text string")
    fitted = reference.fit(docs, "x", {"word": 3})
    held = {(r.doc_id, r.dim): r.value for r in reference.profile(docs, fitted).collect()}
    assert held[1, "word:a:b"] == 2 / 3 and held[2, "word:a:b"] == 0 and held[2, "word:b"] == 1 / 3


def test_most_frequent_words_are_counted_without_documents(spark):
    docs = _docs(spark)
    found = [(r.term, r.n) for r in vocabulary.most_frequent(docs, 20).collect()]
    assert found == [(r.term, r.n) for r in vocabulary.frequent_words(docs, 20).collect()]
