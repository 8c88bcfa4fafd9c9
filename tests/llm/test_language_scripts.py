"""Languages of many scripts, values of lang that are junk, and models of bounded size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from penstroke.llm import language

RANGES = {"el": (0x3B1, 0x3C9), "ru": (0x430, 0x44F), "ko": (0xAC00, 0xAC80), "hi": (0x905, 0x939), "th": (0xE01, 0xE2E), "zh": (0x4E00, 0x4F00), "got": (0x10330, 0x1034A)}
#: Languages that share a script, told apart by the letters they put together.
SHARED = {"uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "bg": "абвгдежзийклмнопрстуфхцчшщъьюя", "pl": "aąbcćdeęfghijklłmnńoóprsśtuwyzźż", "cs": "aábcčdďeéěfghiíjklmnňoóprřsštťuúůvyýzž", "tr": "abcçdefgğhıijklmnoöprsştuüvyz"}


def corpus(rows=60):
    rng, out = random.Random(8), []
    letters = {k: [chr(p) for p in range(*r)] for k, r in RANGES.items()} | {k: list(v) for k, v in SHARED.items()}
    for lang, alphabet in letters.items():
        syllables = [rng.choice(alphabet) + rng.choice(alphabet) for _ in range(60)]
        for _ in range(rows):
            # The same lengths everywhere, so that lengths tell nothing.
            out.append((len(out), " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(25)), lang))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string").repartition(4).cache()


def accuracy(rows, model):
    found = language.predict(rows.where("doc_id % 4 = 0"), *model).collect()
    by = {}
    for r in found:
        by.setdefault(r.lang, []).append(r.lang_pred == r.lang)
    return {k: sum(v) / len(v) for k, v in by.items()}


def test_each_script_and_those_that_share_one(rows):
    found = accuracy(rows, language.fit(rows.where("doc_id % 4 != 0")))
    assert len(found) == len(RANGES) + len(SHARED) and min(found.values()) > 0.9, found


def test_junk_values_of_lang(spark, rows):
    junk = spark.createDataFrame([(10_000 + k, f"x{k} y{k}", f"junk-{k:05}") for k in range(600)], rows.schema)
    names, models = language.fit(rows.where("doc_id % 4 != 0").unionByName(junk), languages=20)
    assert len(names) == 20 and {*RANGES, *SHARED} <= {*names}
    assert min(accuracy(rows, (names, models)).values()) > 0.9
    small = language.fit(rows.where("doc_id % 4 != 0"), entries=50)
    assert all(len(m.three[0]) <= 50 for m in small[1])


def test_counts_in_pieces_and_ties(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 10)
    docs = spark.createDataFrame([(1, "aba aba", "b"), (2, "aba", "a"), (3, "İx ﬀ 𐌰𐌱", "a"), (4, None, "a"), (5, "x", None)], "doc_id long, text string, lang string").repartition(1)
    got = {(r.lang, r.code): r.n for r in language.count_trigrams(docs).collect()}
    code = lambda s: sum(ord(c) * (c != " ") << language.BITS * (2 - k) for k, c in enumerate(s))
    assert got["b", code("aba")] == 2 and got["a", code("aba")] == 1 and got["b", code(" ab")] == 2 and got["a", code(" 𐌰𐌱")] == 1 and got["a", -1] == 2 and got["b", -1] == 1
    assert language.fit(docs, languages=1)[0] == ["a"]


def test_marks_are_no_letters_but_belong_to_words(spark):
    code, row, word, lettered = language.trigrams(pa.array(["कि", "́́", "12", ""], pa.large_string()))
    assert lettered.tolist() == [True, False, False, False] and len(set(word[row == 0].tolist())) == 1 and (row == 1).sum() == 2


def test_probabilities_add_up():
    grams = language.Grams(*language._counted(np.array([(97 << 42) | (98 << 21) | c for c in (97, 97, 98)]), np.ones(3, np.int64)))
    every = np.exp(grams.log_probabilities(np.array([(97 << 42) | (98 << 21) | c for c in (97, 98)]))).sum()
    unseen = np.exp(grams.log_probabilities(np.array([(97 << 42) | (98 << 21) | 99])))[0]
    assert abs(every + unseen * (language.ALPHABET - 2) - 1) < 1e-5
