"""Every language of the column has a model and a band of its own, however many there are, and a band lies wherever its documents do."""

import random
import string

import pytest

from penstroke.llm import quality


def prose(letters, n, rng):
    words = ["".join(rng.choices(letters, weights=range(len(letters), 0, -1), k=rng.randint(2, 8))) for _ in range(200)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("size", [64 << 20, 2000])
def test_languages_beyond_the_broadcast_ones_are_judged_alike(spark, monkeypatch, size):
    rng, rows = random.Random(11), []
    for k in range(12):
        letters = rng.sample(string.ascii_lowercase, 12)
        rows += [(len(rows) + j, prose(letters, rng.choice([10, 60, 120]), rng), f"l{k}", {"k": k}) for j in range(3 + k)]
        rows.append((len(rows), " ".join(f"{rng.choice('#@~')}{j}qx" for j in range(60)), f"l{k}", None))
    rows += [(len(rows), None, "l3", None), (len(rows) + 1, "", "mute", None), (len(rows) + 2, None, None, None), (len(rows) + 3, prose("abc", 70, rng), "und", None), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, more map<string, int>")

    def judged(most):
        return sorted((r.doc_id, r.text or "", r.n_words, r.n_repeat_words, r.base_failed, r.kept, round(r.perplexity or 0, 6), str(r.more)) for r in quality.judge(docs, most).collect())

    whole = judged(128)
    monkeypatch.setattr(quality, "SLICE", size, raising=False)
    assert len(whole) == len(rows) and {x[5] for x in whole} == {True, False}
    for most in (0, 3):
        assert judged(most) == whole, most


def test_a_band_far_from_the_text_of_its_language(spark):
    rng = random.Random(12)
    rows = [(k, " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(2000)), "en") for k in range(12)]
    rows.append((12, "the same line of words again " * 100_000, "en"))
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == set(range(12))
