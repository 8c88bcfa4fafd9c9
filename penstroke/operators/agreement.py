"""Measures of judgements: agreement of two labellings, detection at a fixed rate of false alarms, wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kappa(items: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, kappa): Cohen's kappa of two label columns over the rows that have both; NaN where chance agreement is whole."""
    counts = items.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    share = counts.groupBy("a").agg(F.sum("c").alias("ca")).join(counts.groupBy(F.col("b").alias("a")).agg(F.sum("c").alias("cb")), "a").agg(F.sum(F.col("ca") * F.col("cb")).alias("chance"))
    n = F.col("n").cast("double")
    observed, expected = F.col("same") / n, F.coalesce(F.col("chance"), F.lit(0)) / (n * n)
    return total.crossJoin(share).where("n > 0").select("n", observed.alias("observed"), F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(F.lit(float("nan"))).alias("kappa"))


def detection(scores: DataFrame, rate: float) -> DataFrame:
    """(threshold, tpr) of scores (score, positive): the share of positives at or above the negatives' 1 - rate quantile."""
    cut = scores.where("NOT positive").agg(F.percentile("score", F.lit(1 - rate)).alias("threshold"))
    return scores.where("positive").crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("tpr"))


def win_rate(judged: DataFrame) -> DataFrame:
    """(pairs, decided, wins, win_rate) of judgements (result: win, loss or anything else, which is undecided)."""
    decided = F.count_if(F.col("result").isin("win", "loss"))
    counted = judged.agg(F.count("*").alias("pairs"), decided.alias("decided"), F.count_if(F.col("result") == "win").alias("wins"))
    return counted.withColumn("win_rate", F.when(F.col("decided") > 0, F.col("wins") / F.col("decided")))
