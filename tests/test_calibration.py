"""Density tables against the densities and shares they are made of."""

import math
import random

import pytest

from penstroke.operators import calibrate


def parts(seed, n, shift):
    rng = random.Random(seed)
    return [abs(rng.gauss(shift, 0.3)) for _ in range(n)]


@pytest.fixture(scope="module")
def bins():
    return {(50, True): parts(1, 60, 1), (50, False): parts(2, 80, 2), (200, True): parts(3, 40, 0.7), (200, False): parts(4, 40, 2.2), (400, True): parts(5, 10, 1), (400, False): parts(6, 60, 2), (800, True): parts(7, 60, 1)}


def test_tables_assess_as_densities_do(spark, bins):
    samples = spark.createDataFrame([(t, same, d) for (t, same), ds in bins.items() for d in ds], "tokens int, same boolean, distance double")
    cells = calibrate.tables(samples)
    assert {r.tokens for r in cells.select("tokens").distinct().collect()} == {50, 200} and cells.count() == 2 * calibrate.GRID
    arrays = spark.createDataFrame([(t, sorted(bins[t, True]), sorted(bins[t, False])) for t in (50, 200)], "tokens int, same array<double>, different array<double>")
    asked = [(k, k + 1, 0.02 + 0.05 * k, 20 + 7 * k, 30 + 5 * k) for k in range(60)] + [(900, 901, 99.0, 100, 100), (902, 903, -5.0, 100, 100), (904, 905, bins[50, True][3], 50, 50)]
    frame = spark.createDataFrame(asked, "a long, b long, distance double, tokens_a int, tokens_b int")
    exact = {r.a: r for r in calibrate.assess(frame, arrays).collect()}
    got = {r.a: r for r in calibrate.assess_by_tables(frame, cells).collect()}
    assert set(got) == set(exact)
    for a, r in got.items():
        assert math.isclose(r.p_same, exact[a].p_same, abs_tol=1e-12) and math.isclose(r.p_unrelated, exact[a].p_unrelated, abs_tol=1e-12) and r.extrapolated == exact[a].extrapolated
        if 0.3 < r.distance < 2.5:
            assert math.isclose(math.log(r.likelihood_ratio), math.log(exact[a].likelihood_ratio), abs_tol=0.05)
    assert got[900].p_same == 0 and got[900].likelihood_ratio == 1e3 and got[902].p_unrelated == 0


def test_equal_distances_have_no_density(spark):
    samples = spark.createDataFrame([(10, same, d) for same, d in ((True, 1.0), (False, 2.0)) for _ in range(40)], "tokens int, same boolean, distance double")
    asked = spark.createDataFrame([(1, 2, 1.5, 10, 10)], "a long, b long, distance double, tokens_a int, tokens_b int")
    row = calibrate.assess_by_tables(asked, calibrate.tables(samples)).first()
    assert (row.p_same, row.p_unrelated, row.likelihood_ratio) == (0, 0, 1e3)


def test_thinning_keeps_ends(spark):
    samples = spark.createDataFrame([(10, True, float(k)) for k in range(1000)] + [(10, False, 5.0)], "tokens int, same boolean, distance double")
    kept = sorted(r.distance for r in calibrate.thinned(samples, 11).where("same").collect())
    assert kept[0] == 0 and kept[-1] == 999 and len(kept) == 11
