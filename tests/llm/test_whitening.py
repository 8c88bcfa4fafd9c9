"""Whitening against integers of any size: sums, deviations, residuals of the components, and the covariance of the result."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from penstroke.llm import limbs, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, other int"


def integer(c):
    return min(max(math.floor(64 * c), -(2**60)), 2**60) + 1000000


def whole(row):
    return row is not None and all(c is not None and math.isfinite(c) for c in row)


def check(spark, vectors, dtype="float", tolerance=1e-9):
    frame = spark.createDataFrame([(k, v, "clash", 7) for k, v in enumerate(vectors)], SCHEMA.replace("float", dtype)).repartition(3)
    rows = whitening.integers(frame)
    out = whitening.whiten(rows, whitening.fit(rows)).collect()
    x = {k: tuple(map(integer, v)) for k, v in enumerate(vectors) if whole(v)}
    fit_list = sorted(set(x.values()))
    n, d = len(fit_list), len(fit_list[0])
    width = min(16, d)
    sums = [sum(v[j] for v in fit_list) for j in range(d)]
    v = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in fit_list) for j in range(d)] for i in range(d)]
    trace = sum(v[j][j] for j in range(d))
    assert sorted((r.vec_id, r.component) for r in out) == sorted((k, c) for k in x for c in range(1, width + 1))
    assert {r.other for r in out} == {7} and {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1
    by_row, shares = defaultdict(dict), {}
    for r in out:
        assert int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        by_row[x[r.vec_id]][r.component], shares[r.component] = r.whitened, r.explained
    assert all(a is None or b is None or a >= b for a, b in zip([shares[c] for c in range(1, width)], [shares[c] for c in range(2, width + 1)], strict=True))
    used = [c for c in shares if by_row[fit_list[0]][c] is not None]
    assert all(shares[c] == 0 or trace == 0 for c in shares if c not in used)
    if not used:
        assert out[0].identity_error is None
        return shares
    # The whitened fit list has the identity as covariance, and V times it over e gives it back: so it lies along eigenvectors.
    z = np.array([[by_row[r][c] for c in used] for r in fit_list])
    assert np.abs(z.T @ z / n - np.eye(len(used))).max() < tolerance and out[0].identity_error < tolerance
    for column, c in enumerate(used):
        e = Fraction(shares[c]) * trace / n**3
        # Loadings X'z / n are sqrt(e) times the component.
        loads = [sum(Fraction(float(z[k, column])) * (n * fit_list[k][j] - sums[j]) for k in range(n)) / n**2 for j in range(d)]
        assert abs(float(sum(q * q for q in loads) / e) - 1) < tolerance + 1e-15 * math.sqrt(float(Fraction(trace, n**3) / e))
        for i in range(d):
            there = sum(Fraction(v[i][j], n**3) * loads[j] for j in range(d)) - e * loads[i]
            assert abs(float(there)) <= tolerance * float(e) ** 1.5 + 1e-13 * float(Fraction(trace, n**3)) ** 1.5
    return shares


def test_like_embeddings(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(60, 20)) @ rng.normal(size=(20, 20)) / 6).astype(np.float32).tolist()
    odd = [None, [float("nan")] * 20, [float("inf"), *[0.0] * 19], [None, *[0.0] * 19], vectors[0], vectors[0]]
    assert all(s > 0 for s in check(spark, vectors + odd).values())


def test_far_apart_scales(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(40, 6)) * np.array([1e12, 1e9, 1e4, 30, 1, 0.1])
    check(spark, (vectors @ np.linalg.qr(rng.normal(size=(6, 6)))[0] * np.array([1, 1, 1, 1, 1, 1])).tolist(), "double", 1e-6)
    check(spark, vectors.tolist(), "double")


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]] * 3, [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]], [[0.5]], [[1.0], [2.0]], [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]]])
def test_without_variance_and_with_ties(spark, vectors):
    check(spark, vectors)


def test_extremes(spark):
    check(spark, [[1e300, 1.0], [-1e300, 2.0], [5.0, 3.0], [5.0, 1e-300]], "double", 1e-6)


def test_nothing_left_and_other_lengths(spark):
    for vectors in ([], [None], [[]]):
        frame = spark.createDataFrame([(k, v, "", 0) for k, v in enumerate(vectors)], SCHEMA)
        rows = whitening.integers(frame)
        assert whitening.fit(rows) is None and whitening.whiten(rows, None).count() == 0
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [3.0, 1.0]), (None, [0.0, 5.0])], "vec_id long, embedding array<float>")
    rows = whitening.integers(frame)
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in whitening.whiten(rows, whitening.fit(rows)).collect()) == [-1, -1, 0, 0, 2, 2]


def test_products_are_exact():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(2**61), 2**61, (9000, 3)), rng.integers(-(2**61), 2**61, (9000, 2))
    assert (limbs.exact_product(a, b) == a.astype(object).T @ b.astype(object)).all()


def test_pairs_of_a_sweep():
    for n in (1, 2, 5, 8):
        rounds = limbs.rounds_of(n)
        assert sorted((i, j) for p, q in rounds for i, j in zip(p.tolist(), q.tolist(), strict=True)) == [(i, j) for i in range(n) for j in range(i + 1, n)]
        assert all(len({*p, *q}) == 2 * len(p) for p, q in rounds)


def test_sums_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCKS", 2)
    monkeypatch.setattr(whitening, "ENTRIES", 40)
    rng = np.random.default_rng(4)
    check(spark, rng.normal(size=(50, 4)).tolist())
