"""Large groups of near copies that are not all similar to each other, against brute force."""

import random

import numpy as np
import pytest
from penstroke.llm import jaccard
from test_jaccard_bands import components


def group(n, edits, seed=3, words=70):
    """Copies of one text with up to `edits` words replaced, taken out or put in; copies of some of those; and texts that share its first half only."""
    rng, out = random.Random(seed), []
    base = [f"w{k}" for k in range(words)]
    for k in range(n):
        copy = list(rng.choice(out).split(" ") if out and rng.random() < 0.3 else base)
        for _ in range(rng.randrange(edits)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = [f"x{k}y{rng.randrange(9)}"] * rng.randrange(2)
        out.append(" ".join(copy))
    return out + [" ".join(base[: words // 2] + [f"z{k}q{j}" for j in range(words // 2)]) for k in range(n // 4)]


@pytest.mark.parametrize(("small", "rate"), [(3, 0.0004), (6, 2.0)])
def test_groups_of_near_copies(spark, monkeypatch, small, rate):
    monkeypatch.setattr(jaccard, "RATE", rate)  # above 1: no shingle counts as frequent
    monkeypatch.setattr(jaccard, "TOGETHER", 16)
    texts = group(80, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in jaccard.similar(docs, small, 4).collect()} == components(texts)


def test_differing_elements_of_similar_sets_meet():
    """Whatever the edits, an open set and one similar to it share a key of roles that meet."""
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(4000):
        n = int(rng.integers(8, 60))
        centre = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        x = np.unique(np.concatenate((rng.choice(centre, int(rng.integers(n // 2, n + 1)), replace=False), rng.integers(0, 2**63, int(rng.integers(0, n // 2))).astype(np.uint64))))
        keep = rng.random(len(x)) < rng.choice([0.85, 0.95, 1])
        y = np.unique(np.concatenate((x[keep], rng.choice(centre, int(rng.integers(0, 4))), rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64))))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or np.array_equal(y, centre) or np.array_equal(x, centre):
            continue
        hot = np.sort(rng.choice(centre, n // 2, replace=False))
        (kx, _), (ky, _) = (jaccard.delta_keys(centre, s, 7, hot) for s in (x, y))
        if (kx["role"] & 4).any() and (ky["role"] & 4).any():
            continue  # both are close to the centre
        met += 1
        _, i, j = np.intersect1d(kx["key"], ky["key"], return_indices=True)
        both = np.concatenate((kx, ky))
        assert jaccard.can_share(*(both[c].astype(np.int64) for c in ("d", "n", "rank")), both["role"], i, len(kx) + j).any()
    assert met > 100


def test_null_and_conflicting_ids(spark):
    a, b = " ".join(f"w{k}" for k in range(20)), " ".join(f"v{k}" for k in range(30))
    rows = [(None, a), (1, a), (2, b), (2, a), (3, b), (None, None), (4, a), (4, a)]
    found = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # Document 2 is taken by its first text by order, which is b.
    assert sorted(map(tuple, found), key=str) == sorted([(None, 16, None), (None, 0, None), (1, 16, 1), (2, 26, 2), (3, 26, 2), (4, 16, 1)], key=str)
