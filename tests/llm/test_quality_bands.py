"""The verdict of the perplexity bands: whole against a recursion over dictionaries, and on languages that no list names."""

import math
import random
from collections import Counter, defaultdict

from penstroke.llm import quality
from test_llm_operators import kneser_ney

import numpy as np

ALPHABETS = {
    "en": "etaoinshrdlu", "it": "aeionlrtscdp", "tr": "aeinrlıkdmğş", "ru": "оеаинтсрвлкм", "el": "αοιετσνηυρπκ", "ja": "のにはたるとがでしれ日本",
}


def words_of(lang, rng):
    letters = ALPHABETS[lang]
    return ["".join(rng.choices(letters, weights=range(len(letters), 0, -1), k=rng.randint(2, 8))) for _ in range(300)]


def clean(words, n, rng):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n))


def test_languages_of_the_column_keep_their_clean_text(spark):
    rng, rows = random.Random(4), []
    for lang, n in (("en", 60), ("it", 25), ("tr", 25), ("ru", 25), ("el", 25), ("ja", 25), (None, 25)):
        words = words_of(lang or "it", rng)
        rows += [(len(rows) + k, clean(words, rng.randint(60, 300), rng), lang, 1) for k in range(n)]
    junk = ["".join(rng.choice("qxzjkw#@~^") for _ in range(6)) for _ in range(40)]
    first = len(rows)
    rows += [(first + k, " ".join(rng.choice(junk) + str(rng.randrange(100)) for _ in range(80)), lang, 0) for k, lang in enumerate(("en", "it", "ru", "ja"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    for most in (128, 3):  # with three languages of their own, the others are pooled
        kept = {r.doc_id for r in quality.judge(docs, most).where("kept").collect()}
        assert kept >= {d for d, _, lang, good in rows if good}, most
        assert not kept & {d for d, _, _, good in rows if not good} or most == 3


def test_kept_by_hand(spark):
    rng, rows = random.Random(6), []
    for lang in ("en", "ru", None):
        words = words_of(lang or "el", rng)
        rows += [(len(rows) + k, clean(words, rng.choice([5, 25, 40, 90]), rng), lang) for k in range(12)]
    rows += [(90, None, "en"), (91, "", "ru"), (92, None, None), (93, "zq " * 70, "en"), (94, " ".join(f"x{k}q#" for k in range(60)), "en"), (95, "x " * 30, "fr"), rows[3], rows[3]]
    langs = {d: lang if lang in ("en", "ru", "fr") else "und" for d, _, lang in rows}
    codes = {}
    for d, text, _ in rows:
        signs = [0, 0, 0, *(int(quality.CLASS_OF[min(ord(c), 0xFFFF)]) for c in text or "")]
        codes[d] = [(signs[i] << 15) | (signs[i + 1] << 10) | (signs[i + 2] << 5) | signs[i + 3] for i in range(len(signs) - 3)]
    counts = defaultdict(Counter)
    for d, _, _ in rows:
        counts[langs[d]].update(codes[d])
    p, own = {}, {}
    for lang, c in counts.items():
        keys = np.array(sorted(c), np.int64)
        p[lang] = kneser_ney(keys, np.array([c[k] for k in keys.tolist()], np.int64))
        own[lang] = -sum(n * math.log(p[lang](tuple(k >> 5 * j & 31 for j in (3, 2, 1, 0)))) for k, n in c.items()) / max(1, sum(c.values()))
    off, steps = {}, defaultdict(list)
    for d, text, _ in rows:
        if codes[d]:
            mean = -sum(math.log(p[langs[d]](tuple(k >> 5 * j & 31 for j in (3, 2, 1, 0)))) for k in codes[d]) / len(codes[d])
            off[d] = (mean - own[langs[d]]) / (quality.SPREAD + 1 / math.sqrt(len(codes[d])))
            if len(text) >= quality.SHORT:
                steps[langs[d]].append(round(off[d] * quality.FINE) / quality.FINE)
    limits = {}
    for lang in counts:
        values = sorted(steps[lang]) or [0.0]
        middle = values[math.ceil(len(values) / 2) - 1]
        apart = sorted(abs(v - middle) for v in values)
        spread = max(quality.LEAST_SPREAD, 1.4826 * apart[math.ceil(len(apart) / 2) - 1])
        limits[lang] = middle - quality.BELOW * spread, middle + quality.ABOVE * spread
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows)
    for r in found:
        within = r.doc_id not in off or limits[langs[r.doc_id]][0] <= off[r.doc_id] <= limits[langs[r.doc_id]][1]
        assert r.kept == (not r.base_failed and within), r.doc_id
    assert any(not r.kept and not r.base_failed for r in found) and any(r.kept for r in found)
