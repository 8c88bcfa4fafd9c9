"""Sentence spans against brute force, on odd rows and passages that begin and end within sentences."""

import random
import re
import time

import pyarrow as pa
from penstroke.llm import sentence_spans

EDGES = " \t\n\v\f\r"


def by_hand(rows, run=sentence_spans.RUN, shortest=sentence_spans.SHORTEST):
    """(kept text, pieces, removed) of rows (doc_id, text)."""
    place, found = {}, []
    for k, (doc, text) in enumerate(rows):
        parts = re.findall(sentence_spans.PIECE, text or "")
        trimmed, here = [p.strip(EDGES) for p in parts], []
        for i in range(len(parts)):
            j = i + run
            while j < len(parts) and len(" ".join(trimmed[i:j])) < shortest:
                j += 1
            if j > len(parts) or len(" ".join(trimmed[i:j])) < shortest:
                if i:
                    continue
                j = len(parts)
            here.append((i, j, tuple(trimmed[i:j])))
        doc = -(2**63) if doc is None else doc
        found.append((parts, here, doc))
        for i, _, r in here:
            place[r] = min(place.get(r, 2**63), doc)
    out = []
    for parts, here, doc in found:
        seen, gone = set(), set()
        for i, j, r in here:
            if place[r] < doc or r in seen:
                gone |= set(range(i, j))
            seen.add(r)
        out.append(("".join(p for x, p in enumerate(parts) if x not in gone), len(parts), len(gone)))
    return out


def test_rows_by_hand(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdegilmnorst") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", ",", ".", ".\n", "? "]) for _ in range(n))
    passage = text(60)
    rows = [(k, " ".join((text(rng.randrange(40)), passage[rng.randrange(60) : len(passage) - rng.randrange(60)], text(rng.randrange(40))))) for k in range(30)]
    rows += [(50, "Yes."), (51, "Yes."), (52, " Yes.\n"), (53, None), (54, ""), (55, "\n \n"), (56, "UN,!! EN.!! " * 60), (None, passage), (7, passage), (7, passage), (60, "é" * 400), (61, "é" * 400)]
    docs = spark.createDataFrame([(d, t, "a", 1, 2) for d, t in rows], "doc_id long, text string, __doc string, __runs int, n_removed int").coalesce(1)
    found = sentence_spans.dedupe(docs)
    assert found.columns == ["doc_id", "text", "n_sentences", "n_removed"]
    got = sorted(((r.doc_id, r.text or "", r.n_sentences, r.n_removed) for r in found.collect()), key=str)
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, by_hand(rows), strict=True)), key=str)
    assert {d: n for d, _, _, n in got}[51] == 1


def test_passages_go_nearly_whole(spark):
    """Repeated passages of over 50 words lose nearly nine words in ten on average at least, wherever they begin and end."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() + ("." if rng.random() < 0.08 else "") for _ in range(n))
    passages = [text(60) for _ in range(60)]
    rows = [(k, f"{text(30)} {passages[k % 60]} {text(30)}") for k in range(120)] + [(200 + k, text(80)) for k in range(60)]
    found = {r.doc_id: r.text for r in sentence_spans.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [len(found[60 + k].split()) - 60 for k in range(60)]
    assert sum(left) < 7 * 60 and sum(x <= 15 for x in left) >= 54
    assert all(found[k] == t for k, t in rows if k < 60 or k >= 200)


def test_time_follows_the_length():
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        sentence_spans.runs_of(pa.array([f"Same line {n}. " * n], pa.large_string()))
        took.append(time.time() - began)
    assert took[1] < 12 * max(took[0], 0.05)
