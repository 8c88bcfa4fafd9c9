"""Surprisal of a corpus by its own model, without a row for each unit, equals the joined one."""

import random

import pytest

from penstroke.operators import surprisal


@pytest.fixture(scope="module")
def docs(spark):
    draw, words = random.Random(2), ["a", "b", "été", "b.c", "don't", "x", "7", "的", "-", "\n", "word"]
    texts = [None, "", "one", "one two", *(" ".join(draw.choice(words) for _ in range(draw.randrange(90))) for _ in range(60))]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def _equal(found, expected, keys):
    a, b = ({tuple(r[k] for k in keys): r.asDict() for r in x.collect()} for x in (found, expected))
    assert a.keys() == b.keys()
    for k, row in a.items():
        assert all(v == pytest.approx(b[k][c], abs=1e-9) if isinstance(v, float) else v == b[k][c] for c, v in row.items()), (row, b[k])


def test_words(docs):
    units = surprisal.word_units(docs)
    scored = surprisal.score(units, surprisal.fit(units))
    found = surprisal.word_series(docs, 2.0)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    _equal(found, surprisal.series(scored, 2.0, "surp:word"), ("doc_id", "dim"))
    _equal(surprisal.word_peaks(docs, 3), surprisal.peaks(scored, 3), ("doc_id", "rank"))
    assert surprisal.word_threshold(docs).first()[0] == pytest.approx(surprisal.low_threshold(scored).first()[0], abs=1e-9)


def test_characters_broadcast_or_joined(docs):
    units = surprisal.char_units(docs)
    expected = surprisal.series(surprisal.score(units, surprisal.fit(units)), 2.0)
    for most in (1 << 20, 5):
        _equal(surprisal.char_series(docs, 2.0, most=most), expected, ("doc_id", "dim"))


def test_sentences_are_split_as_their_tokens_stand(spark):
    docs = spark.createDataFrame([(1, "a b c d, e f. a b c d, a b. b a d c: a b. c d a b, f e. a b, c."), (2, "a b c d, e."), (3, "a.")], "doc_id long, text string")
    found = {(r.doc_id, r.dim): r.value for r in surprisal.sentence_punches(docs).collect()}
    assert found.keys() == {(i, d) for i in (1, 2) for d in ("surp:punch_ratio_mean", "surp:punch_spike_rate")}
    assert found[2, "surp:punch_ratio_mean"] is None and found[1, "surp:punch_ratio_mean"] > 0 and 0 <= found[1, "surp:punch_spike_rate"] <= 1
