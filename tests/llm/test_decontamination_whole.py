"""What documents hold of a benchmark, against an exhaustive alignment of every segment."""

import random

import numpy as np
import pyarrow as pa
import pytest
from penstroke.llm import decontaminate


def fold(text):
    return "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in text)


def edits_within(pattern, text):
    p, row = np.array([ord(c) for c in pattern]), np.zeros(len(text) + 1, int)
    t, lane = np.array([ord(c) for c in text] or [0])[: len(text)], np.arange(len(text) + 1)
    for k, c in enumerate(p, 1):
        new = np.concatenate(([k], np.minimum(row[:-1] + (t != c), row[1:] + 1)))
        row = np.minimum.accumulate(new - lane) + lane
    return int(row.min())


def by_hand(docs, bench):
    out = set()
    for item, text in bench:
        chars = fold(text or "")
        m = len(chars)
        if m < decontaminate.Q:
            continue
        size = min(m, decontaminate.SEGMENT)
        starts = sorted({*range(0, m - size + 1, decontaminate.SEGMENT // 2), m - size})
        for doc, body in docs:
            held = fold(body or "")
            if m < decontaminate.WHOLE_WORDS:
                word = lambda at, held=held: 0 <= at < len(held) and (held[at].isascii() and held[at].isalnum() or not held[at].isascii())
                at = held.find(chars)
                while at >= 0:
                    if not (word(at - 1) and word(at)) and not (word(at + m - 1) and word(at + m)):
                        out.add((doc, item))
                    at = held.find(chars, at + 1)
            elif any(edits_within(chars[s : s + size], held) <= min(int(size * decontaminate.ERRORS), (size - decontaminate.Q) // decontaminate.Q) for s in starts):
                out.add((doc, item))
    return out


def test_all_matches(spark):
    rng = random.Random(11)
    scripts = ("abcdefghij ", "абвгдежзик ", "的一是不了人我在有他 ", "abc ")
    text = lambda n, signs: "".join(rng.choice(signs) for _ in range(n)).strip() or "x"
    bench = [(k, text(rng.choice([9, 14, 20, 31, 33, 50, 70, 130, 200]), scripts[k % 4])) for k in range(24)] + [(3, text(40, scripts[0])), (90, None), (91, "tiny"), (92, "")]
    docs = []
    for k in range(60):
        item = rng.choice([t for _, t in bench if t])
        chars = list(item)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "z"]])
        docs.append((k, text(rng.randrange(1, 60), rng.choice(scripts)) + rng.choice([" ", "", "\n", "."]) + "".join(chars).upper() + rng.choice([" ", "", ". "]) + text(rng.randrange(1, 60), rng.choice(scripts))))
    docs += [(100, None), (101, ""), (5, docs[6][1]), (5, docs[5][1]), (102, text(3000, scripts[3]))]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    expected = by_hand(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and len(expected) > 20


def test_frequent_q_grams_take_bounded_memory():
    """A long text of one character against many ruled items: counted by runs, in groups."""
    import resource
    import time

    items = [(k, f"Question {k}: " + "-" * 100 + f" answer {k}") for k in range(300)] + [(1000, "-" * 128)]
    index = decontaminate.segment_index(items)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    began = time.time()
    found = decontaminate.find(pa.array(["-" * 200_000, "x " * 200 + items[7][1] + " y" * 200], pa.large_string()), index)
    assert {(r, i) for r, i, *_ in found} == {(0, 1000), (1, 7)} | {(1, i) for r, i, *_ in found if r == 1}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000 and time.time() - began < 100


@pytest.mark.parametrize(("counted", "run"), [(1, 1), (50, 3), (400, 512)])
def test_groups_and_pieces_change_nothing(monkeypatch, counted, run):
    rng = random.Random(6)
    items = [(k, "".join(rng.choice("ab- ") * rng.randrange(1, 9) for _ in range(rng.randrange(5, 60)))) for k in range(12)]
    texts = []
    for k in range(12):
        text = list(rng.choice(items)[1])
        for _ in range(k // 3):
            text[rng.randrange(len(text))] = rng.choice("ab-")
        texts.append("-" * rng.randrange(40) + "".join(text) + "ab" * rng.randrange(20))
    index = decontaminate.segment_index(items)
    want = sorted(decontaminate.find(pa.array(texts, pa.large_string()), index))
    monkeypatch.setattr(decontaminate, "COUNTED", counted)
    monkeypatch.setattr(decontaminate, "RUN", run)
    assert sorted(decontaminate.find(pa.array(texts, pa.large_string()), index)) == want and want
