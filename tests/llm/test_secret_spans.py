"""Whole spans against a plain scan, also in long texts, and what the models find of strings they have not seen."""

import random
import re
import time

import pytest
from penstroke.llm import secrets

WORDS = [w for w in "internationalization counterrevolutionaries value number thing record stone garden mississippi understanding misunderstanding reorganization characteristically acknowledgement".split()]


@pytest.fixture(scope="module")
def ratio():
    return secrets.train(secrets.random_strings()) - secrets.train(secrets.identifiers(WORDS))


def plain(text, ratio):
    base = secrets.base_spans(text)
    found = list(base)
    for m in secrets.RUN.finditer(text):
        if re.fullmatch("[a-z]+", m[0]) or any(a < m.end() and m.start() < b for a, b, _ in base):
            continue
        c = secrets._codes(m[0])
        score = sum(ratio[x] for x in zip(c[:-2].tolist(), c[1:-1].tolist(), c[2:].tolist(), strict=True))
        if score >= secrets.TOTAL and score >= secrets.EACH * len(m[0]):
            found.append((m.start(), m.end(), "random"))
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_spans_equal_a_plain_scan(spark, ratio):
    rng, texts = random.Random(3), []
    strings = secrets.random_strings(60, seed=5)
    part = lambda: rng.choice([rng.choice(strings), rng.choice(WORDS), f"secret={rng.choice(strings)}", "AKIA" + "B7" * 9, "0123456789abcdef" * 2, "_".join(rng.sample(WORDS, 3)), "é" * 3])
    texts = [rng.choice(["", " ", "\n"]).join(part() for _ in range(rng.randrange(12))) for _ in range(150)] + [" ".join(part() for _ in range(4000)), None, "", "x"]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1])]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), ratio)
    got = sorted(((r.doc_id, [(s.start, s.end, s.kind) for s in r.secrets]) for r in found.collect()), key=str)
    assert got == sorted(((d, plain(t or "", ratio)) for d, t in rows), key=str)
    assert sum(k == "random" for _, spans in got for _, _, k in spans) > 100


def test_time_follows_the_number_of_spans(ratio):
    took = []
    for n in (4_000, 16_000):
        text = "secret=abcdef12 " * n + "understandingmisunderstanding " * n
        began = time.time()
        assert len(secrets.spans_of(text, ratio)) == n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0]


@pytest.mark.parametrize("alphabet", range(len(secrets.ALPHABETS)))
def test_random_strings_of_each_alphabet(ratio, alphabet):
    rng = random.Random(alphabet)
    found = sum(bool(secrets.spans_of("".join(rng.choice(secrets.ALPHABETS[alphabet]) for _ in range(24)), ratio)) for _ in range(300))
    assert found >= 270
    assert sum(any(k == "random" for _, _, k in secrets.spans_of(x, ratio)) for x in secrets.identifiers(WORDS, 500, seed=alphabet)) <= 10
