"""Near copies on both sides of each edge of the size bands."""

import itertools
import random

import corpus_pipeline
import numpy as np
from penstroke.llm import jaccard


def near_copies():
    """Texts with a copy of further words, or of changed and further words; sets of 52 to 63 against 64 to 78 shingles."""
    rng, out = random.Random(9), []
    for a in range(52, 64):
        for b in range(64, 5 * a // 4 + 1):
            words = [f"w{len(out)}x{rng.randrange(10**6)}" for _ in range(b + 4)]
            out += [" ".join(words[: a + 4]), " ".join(words)]
            out.append(" ".join([*words[:-1], "changed"]))
    return out


def components(texts):
    words = [t.split(" ") for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {(k, len(s), root(k)) for k, s in enumerate(sets)}


def test_copies_across_the_edge_at_64(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = components(texts)
    assert {tuple(r) for r in jaccard.similar(docs).collect()} == expected
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {c for _, _, c in expected}


def test_every_size_shares_a_band_with_sets_a_quarter_larger():
    size = np.arange(1, 5000)
    near, far = jaccard.level(size), jaccard.level(size * 5 // 4)
    for a in size[size * 5 // 4 < 5000]:
        assert set(near[a - 1 : a * 5 // 4]) <= {near[a - 1], far[a - 1]}
    # A set of each size emits the keys of both bands: a set of the other band that holds the same elements meets it.
    rng = np.random.default_rng(1)
    for a in (51, 52, 63, 64, 85, 86, 106, 107, 170, 171):
        b = a * 5 // 4
        whole = np.sort(rng.integers(0, 2**63, b).astype(np.uint64))
        part = np.sort(rng.choice(whole, a, replace=False))
        _, keys = jaccard.part_keys(np.concatenate((part, whole)), np.array([0, a, a + b]), np.zeros(0, np.uint64))
        assert len(np.unique(keys)) < len(keys), a
