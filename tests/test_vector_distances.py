"""Distances of query vectors against brute force."""

import numpy as np
import pyarrow.parquet as pq
from penstroke.operators import distance
from penstroke.plans import core

SF = "/root/testdata/sf0.001"


def test_every_50th_vector_against_all(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    vectors = {k: np.array(v, float) for k, v in zip(rows["vec_id"], rows["embedding"], strict=True)}
    asked = [k for k in vectors if k % 50 == 0]
    assert len(asked) > 5
    found = {(r.a, r.b): (r.l1, r.dot) for r in core.QUERIES["vector_distances_every_50th"](spark, SF).collect()}
    assert set(found) == {(a, b) for a in asked for b in vectors}
    for (a, b), got in found.items():
        np.testing.assert_allclose(got, (np.abs(vectors[a] - vectors[b]).sum(), vectors[a] @ vectors[b]), atol=1e-4)


def test_blocks_and_odd_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0, None, 4.0]), (100, None), (7, []), (8, [1.0, 1.0, 1.0])], "id long, v array<double>")
    expected = {(0, 0, 0.0, 5.0), (0, 50, 8.0, 3.0), (0, 7, 3.0, 0.0), (0, 8, 2.0, 3.0), (50, 0, 8.0, 3.0), (50, 50, 0.0, 25.0), (50, 7, 7.0, 0.0), (50, 8, 6.0, 7.0)}
    for block in (1, 10):
        assert {tuple(r) for r in distance.dense_pairs(rows.where("id % 50 = 0"), rows, block).collect()} == expected
