"""Characters and tokens of whole batches equal those of the regular expressions."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from penstroke.functions.text import token_array
from penstroke.text import batches


def test_tokens_are_those_of_the_pattern(spark):
    draw, parts = random.Random(5), ["a", "é", "中", "7", "٣", "_", "'", "’", ".", ",", ";", ":", "·", " ", "\n", "-", "𝒜", "ab", "12", "", "\t"]
    texts = ["", "a.b2c", "1,000a 2", "x'7y", "don't 3.14.15 a.b:c _._ 1;2,3;", *("".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(3000))]
    points, begins = batches.code_points(pa.array(texts))
    starts, stops, counts = batches.tokens_of(points, begins)
    words = batches.words_of(points, starts, stops).to_pylist()
    expected = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(token_array(F.col("text")).alias("w")).collect()]
    assert words == [w for ws in expected for w in ws] and counts.tolist() == [len(ws) for ws in expected]


def test_runs_of_white_space_are_one_space():
    texts = ["", " a\n\n b", "x", "\t", "c \x0b d\r\n", "\n"]
    points, begins = batches.spaced(*batches.code_points(pa.array(texts)))
    assert points.tobytes().decode("utf-32-le") == "\n\n a b\nx\n \nc d \n \n"
    assert [points[a : b - 1].tobytes().decode("utf-32-le") for a, b in zip(begins, begins[1:])] == ["", " a b", "x", " ", "c d ", " "]
