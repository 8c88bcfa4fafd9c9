"""Connected components of link tables, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstroke.llm.common import settle


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in links (a, b): component is the least node reachable.

    Large-star and small-star steps alternate until nothing changes; a node's least neighbour is an
    aggregate joined back, so a node with many links is dealt over tasks."""
    now = settle(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.select(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if state == before or not state.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
        before = state
        ways = _both_ways(now)
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.col("m").alias("b"))
        now = settle(small.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct())
