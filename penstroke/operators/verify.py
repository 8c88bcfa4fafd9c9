"""Is a text by an author? Contests against impostors over random halves of the dimensions, with room to abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P1, P2 = 0.35, 0.65


def _draw(name: str, seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{name}"), *columns))


def impostor_scores(query: DataFrame, candidates: DataFrame, iterations: int = 100, seed: int = 1, share: float = 0.5) -> DataFrame:
    """(score): share of iterations in which a target is strictly nearer to the query than every impostor drawn.

    query (dim, x); candidates (id, target boolean, dim, y). Each iteration draws the share of dimensions and of impostors whose
    hashes come first, so any engine draws the same."""
    rounds = query.sparkSession.range(iterations).withColumnRenamed("id", "it")
    dims, others = query.select("dim").distinct(), candidates.where("NOT target").select("id").distinct()
    k, m = max(1, int(dims.count() * share)), max(1, int(others.count() * share))
    first = lambda table, column, n, name: (  # noqa: E731  rounds times dimensions or impostors: both bounded by the reference
        rounds.join(table).withColumn("r", F.row_number().over(Window.partitionBy("it").orderBy(_draw(name, seed, "it", column), column))).where(F.col("r") <= n).select("it", column)
    )
    drawn_dims, drawn = F.broadcast(first(dims, "dim", k, "dim")), first(others, "id", m, "id")
    difference = query.join(candidates, "dim").select("id", "target", "dim", F.abs(F.col("x") - F.col("y")).alias("d"))
    distance = difference.join(drawn_dims, "dim").groupBy("it", "id", "target").agg(F.avg("d").alias("d"))
    allowed = distance.join(drawn.withColumn("drawn", F.lit(True)), ["it", "id"], "left").where("target OR drawn")
    best = allowed.groupBy("it").agg(F.min(F.when(F.col("target"), F.col("d"))).alias("t"), F.min(F.when(~F.col("target"), F.col("d"))).alias("o"))
    return best.agg(F.avg((F.col("t") < F.col("o")).cast("double")).alias("score"))


def verdict(score: Column, p1: float = P1, p2: float = P2) -> Column:
    return F.when(score < p1, "disfavoured").when(score > p2, "favoured").otherwise("abstain")


def optimize_thresholds(labelled: DataFrame, steps: int = 40) -> DataFrame:
    """(p1, p2, c_at_1) with the best c@1 over a grid, ties to the widest zone of abstention; labelled (score, same)."""
    grid = labelled.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("p"))
    zones = grid.withColumnRenamed("p", "p1").join(grid.withColumnRenamed("p", "p2")).where("p1 <= p2")  # a fixed grid
    answer = verdict_column(F.col("score"), F.col("p1"), F.col("p2"))
    correct = ((answer == "favoured") & F.col("same")) | ((answer == "disfavoured") & ~F.col("same"))
    # Labelled scores first fall into their distinct values, so that the grid meets those and not the rows.
    distinct = labelled.groupBy("score", "same").agg(F.count("*").alias("w"))
    scored = distinct.join(F.broadcast(zones)).groupBy("p1", "p2").agg(F.sum("w").alias("n"), F.sum(F.when(correct, F.col("w")).otherwise(0)).alias("c"), F.sum(F.when(answer == "abstain", F.col("w")).otherwise(0)).alias("u"))
    value = (F.col("c") + F.col("u") * F.col("c") / F.col("n")) / F.col("n")
    return scored.select("p1", "p2", value.alias("c_at_1")).orderBy(F.desc(F.round(value, 9)), F.desc(F.col("p2") - F.col("p1")), "p1").limit(1)


def verdict_column(score: Column, p1: Column, p2: Column) -> Column:
    return F.when(score < p1, "disfavoured").when(score > p2, "favoured").otherwise("abstain")
