"""Long texts and many pairs are worked off in proportion to their size, with the same results."""

import random

import pytest
from pyspark.sql import functions as F

from penstroke.functions import ingest
from penstroke.operators import distance, features, reference, vocabulary


def test_tail_of_a_long_book(spark):
    lines = [f"line {i}" for i in range(30_000)]
    texts = ["\n".join(lines), "\n".join([*lines, "# About the author.", "Lives."]), "\n".join(["Also by him", *lines])]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", ingest.cut_tail(F.col("text")).alias("t"), ingest.has_tail(F.col("text")).alias("m")).orderBy("i").collect()
    assert [r.t for r in got] == [texts[0], texts[0], texts[2]] and [r.m for r in got] == [False, True, False]


def test_type_runs_of_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(40_000)) + " w1" * 40_000
    got = features.mtld(spark.createDataFrame([(1, text), (2, None), (3, "a a")], "doc_id long, text string")).collect()
    held = {r.doc_id: r.value for r in got}
    assert held[1] > 0 and held[2] is None and held[3] == 2.0


def test_rates_of_authors_are_those_of_their_texts_together(spark):
    docs = spark.createDataFrame([("x", "a b a"), ("x", "c"), ("y", "b"), ("z", "")], "doc_id string, text string")
    words = spark.createDataFrame([("a",), ("b",)], "term string")
    got = {(r.doc_id, r.term): r.value for r in vocabulary.word_rates(docs, words, many=True).collect()}
    assert got == {("x", "a"): 0.5, ("x", "b"): 0.25, ("y", "a"): 0.0, ("y", "b"): 1.0} == {(r.doc_id, r.term): r.value for r in vocabulary.word_rates(docs, words).collect()}


def test_a_family_that_is_measured_whole_is_fitted_in_one_pass(spark, monkeypatch):
    calls = []
    family = reference.measured("index", lambda docs: calls.append(1) or docs.select("doc_id", F.lit("x:length").alias("dim"), F.length("text").cast("double").alias("value")))
    monkeypatch.setitem(reference.FAMILIES, "lengths", family)
    fitted = reference.fit(spark.createDataFrame([(1, "ab"), (2, "abcd")], "doc_id long, text string"), "x", {"lengths": 5})
    assert len(calls) == 1 and [(d["dim"], d["n"], d["mean"]) for d in fitted.dims] == [("x:length", 2, 3.0)]


@pytest.mark.parametrize("metric", distance.METRICS)
def test_distances_in_blocks_are_those_of_pairs(spark, metric):
    draw, width = random.Random(4), 6
    rows = [(i, k, draw.random() + 0.1) for i in range(20) for k in range(width) if draw.random() < 0.8]
    long_ = spark.createDataFrame([(i, f"d{k}", v) for i, k, v in rows], "id long, dim string, z double")
    packed = spark.createDataFrame(rows, "id long, k long, z double").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "z"))).alias("z"))
    order = spark.createDataFrame([(f"d{k}", k) for k in range(width)], "dim string, idx long")
    expected = {(r.a, r.b): r.distance for r in distance.distances(distance.pairs(long_.where("id < 5"), long_, "z"), metric, order).collect()}
    for block in (7, 1 << 20):
        found = distance.between(packed.where("id < 5"), packed, width, metric, block)
        got = {(r.a, r.b): r.distance for r in found.collect()}
        assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)


def test_syllables_of_a_word_are_those_of_the_expression(spark):
    from penstroke.functions.text import syllables

    words = ["the", "table", "a", "rhythm", "7", "été", "made", "re", "don't", "ae_ie", "queue", "中文", "b.c"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", syllables(F.col("w")).alias("n")).collect()
    assert {r.w: features._syllables(r.w) for r in rows} == {r.w: r.n for r in rows}
    docs = spark.createDataFrame([(1, "the table made. a b. c d. e f."), (2, None)], "doc_id long, text string")
    assert "Generate" not in features.word_lengths(docs)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1]
    assert {r.doc_id for r in features.readability(docs).collect()} == {1}
