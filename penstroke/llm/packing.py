"""Operator 8, packing: length buckets that minimise padding.

Texts are cut to pieces of at most MAX_TOKENS words, so lengths have a bounded histogram, counted over
all pieces. Dynamic programming over it finds the bucket boundaries with the least padding. In a bucket,
pieces form batches of at most BUDGET padded tokens. To keep any number of pieces of one length apart,
a bucket is dealt by hash over groups of about GROUP pieces, each packed by itself; only its last batch
may be short of pieces.

Degenerate rows: null and empty texts, and those without a word, have no piece; repeated rows are packed
each; a group is dealt in the order of doc_id, piece and length, and rows equal in all three in any; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstroke.llm.common import table

MAX_TOKENS, BUCKETS, BUDGET, GROUP = 2048, 16, 65_536, 1024


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, piece, n_tokens): words of the text, cut to pieces."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    counted = docs.select("doc_id", words.alias("words"))
    last = F.ceil(F.col("words") / max_tokens) - 1
    return counted.select("doc_id", "words", F.explode(F.when(F.col("words") > 0, F.sequence(F.lit(0).cast("long"), last))).alias("piece")).select(
        "doc_id", "piece", F.least(F.lit(max_tokens).cast("long"), F.col("words") - F.col("piece") * max_tokens).alias("n_tokens")
    )


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding. histogram: length to count.

    Padding of one bucket over lengths i+1 to j is length[j] * pieces - tokens; the tokens add up to the same in
    all partitions, so the least sum of length[j] * pieces is sought."""
    lengths = np.array(sorted(histogram), np.float64)
    if not len(lengths):
        return []
    count = np.concatenate(([0], np.cumsum([histogram[int(x)] for x in lengths]))).astype(np.float64)
    n = len(lengths)
    cost = np.full(n + 1, np.inf)
    cost[0], came = 0, []
    for _ in range(min(buckets, n)):
        now, origin = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            every = cost[:j] + lengths[j - 1] * (count[j] - count[:j])
            origin[j] = every.argmin()
            now[j] = every[origin[j]]
        cost = now
        came.append(origin)
    out, j = [], n
    for origin in reversed(came):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = origin[j]
    return out[::-1]


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, n_tokens, bucket, batch_group, batch, padding): bucket is the padded length."""
    if budget < max_tokens:
        raise ValueError("a batch must hold a longest piece")
    cut = pieces(docs, max_tokens)
    histogram = {row.n_tokens: row["count"] for row in cut.groupBy("n_tokens").count().collect()}  # max_tokens rows at most
    bounds = boundaries(histogram, buckets)
    sizes = {b: sum(n for length, n in histogram.items() if a < length <= b) for a, b in zip([0, *bounds], bounds, strict=False)}
    bucket, ways = F.lit(max_tokens).cast("long"), F.lit(1)
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
        ways = F.when(F.col("bucket") == b, F.lit(-(-sizes[b] // group))).otherwise(ways)
    placed = cut.withColumn("bucket", bucket).withColumn("batch_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(8)), ways).cast("long"))
    order = Window.partitionBy("bucket", "batch_group").orderBy("doc_id", "piece", "n_tokens")
    room = F.floor(F.lit(budget) / F.col("bucket"))
    return placed.withColumn("batch", F.floor((F.row_number().over(order) - 1) / room)).withColumn("padding", F.col("bucket") - F.col("n_tokens"))


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
