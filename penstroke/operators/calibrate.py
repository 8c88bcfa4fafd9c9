"""What a distance is worth at a length: distributions of distances between texts of one author and of different authors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.functions.text import occurrences, token_array
from penstroke.operators.distance import distances


def windows(docs: DataFrame, size: int, per_author: int, seed: int) -> DataFrame:
    """(doc_id, author, w, n): a run of `size` tokens at a seeded place of documents that have them, of at most `per_author`
    documents of each author in seeded order. per_author bounds the sample."""
    long_ = docs.select("doc_id", "author", token_array(F.col("text")).alias("ws")).where(F.size("ws") >= size)
    order = Window.partitionBy("author").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), "doc_id")
    drawn = long_.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_author)
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + 1), "doc_id")), 1, 8), 16, 10).cast("long"), F.size("ws") - size + 1)
    return drawn.select("doc_id", "author", F.slice("ws", (start + 1).cast("int"), size).alias("ws"))


def profiles(samples: DataFrame, vocabulary: list[str], stats: DataFrame) -> DataFrame:
    """(id, author, dim, z) of samples (doc_id, author, ws) over vocabulary words, against stats (dim, mean, scale)."""
    n = F.size("ws")
    rates = F.array(*(F.struct(F.lit(v).alias("dim"), (occurrences("ws", v) / n).alias("value")) for v in vocabulary))
    each = samples.select(F.col("doc_id").alias("id"), "author", F.explode(rates).alias("r")).select("id", "author", "r.*")
    return each.join(F.broadcast(stats.select("dim", "mean", "scale")), "dim").select("id", "author", "dim", ((F.col("value") - F.col("mean")) / F.col("scale")).alias("z"))


def pair_distances(vectors: DataFrame, metric: str = "burrows") -> DataFrame:
    """(a, b, same, distance) of each two sampled texts; the sample is bounded, so are its pairs."""
    a = vectors.select(F.col("id").alias("a"), F.col("author").alias("aa"), "dim", F.col("z").alias("x"))
    b = vectors.select(F.col("id").alias("b"), F.col("author").alias("ab"), "dim", F.col("z").alias("y"))
    paired = a.join(b, "dim").where("a < b")
    found = distances(paired, metric)
    authors = vectors.select("id", "author").distinct()
    named = found.join(authors.withColumnRenamed("id", "a").withColumnRenamed("author", "aa"), "a").join(authors.withColumnRenamed("id", "b").withColumnRenamed("author", "ab"), "b")
    return named.select("a", "b", (F.col("aa") == F.col("ab")).alias("same"), "distance")


def subsample(pairs: DataFrame, keep: int) -> DataFrame:
    """(same, sample): at most `keep` evenly spaced order statistics of each side."""
    numbered = pairs.withColumn("r", F.row_number().over(Window.partitionBy("same").orderBy("distance")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("same")))
    step = F.greatest(F.lit(1.0), (F.col("n") - 1) / (keep - 1))
    chosen = numbered.where(F.round(F.round(F.col("r") / step) * step) == F.col("r"))
    return chosen.groupBy("same").agg(F.array_sort(F.collect_list("distance")).alias("sample"))


#: Least sample of either side of a bin.
LEAST_SAMPLE = 30


def enough(bins: DataFrame, least: int = LEAST_SAMPLE) -> DataFrame:
    """The bins (tokens, same, different) with enough samples on both sides."""
    return bins.where((F.coalesce(F.size("same"), F.lit(0)) >= least) & (F.coalesce(F.size("different"), F.lit(0)) >= least))


def ecdf(sample: Column, at: Column) -> Column:
    """Share of the sample at or below a value."""
    return F.when(F.size(sample) > 0, F.size(F.filter(sample, lambda x: x <= at)) / F.size(sample))


def _mean(sample: Column) -> Column:
    return F.aggregate(sample, F.lit(0.0), lambda a, x: a + x) / F.size(sample)


def quantile(ordered: Column, q: float) -> Column:
    """Interpolated between order statistics."""
    at = F.lit(q) * (F.size(ordered) - 1)
    low = F.floor(at).cast("int")
    return F.get(ordered, low) + (at - low) * (F.get(ordered, F.least(low + 1, F.size(ordered) - 1)) - F.get(ordered, low))


def density(ordered: Column, at: Column) -> Column:
    """Gaussian kernel density, bandwidth 0.9 min(sd, iqr / 1.34) n^-0.2; 0 of fewer than two values."""
    n, mean = F.size(ordered), _mean(ordered)
    sd = F.sqrt(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.greatest(n - 1, F.lit(1)))
    iqr = quantile(ordered, 0.75) - quantile(ordered, 0.25)
    h = 0.9 * F.when(iqr > 0, F.least(sd, iqr / 1.34)).otherwise(sd) * F.pow(n.cast("double"), F.lit(-0.2))
    total = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + F.exp(-0.5 * F.pow((at - x) / h, 2)))
    return F.when(n < 2, 0.0).when(h <= 1e-300, F.when(F.abs(at - F.get(ordered, F.lit(0))) < 1e-15, 1e300).otherwise(0.0)).otherwise(total / (n * h * math.sqrt(2 * math.pi)))


def assess(distances_: DataFrame, bins: DataFrame) -> DataFrame:
    """distances_ (a, b, distance, tokens_a, tokens_b) with p_unrelated, p_same, likelihood_ratio and extrapolated; bins (tokens,
    same, different: ordered arrays). Values of the two bins around the geometric mean length are blended on its logarithm."""
    held = bins.agg(F.array_sort(F.collect_list(F.struct("tokens", "same", "different"))).alias("bins"))  # one row of a few bins
    d = F.col("distance")
    ratio = lambda s: F.when(density(s["different"], d) <= 1e-300, 1e3).otherwise(F.greatest(F.lit(1e-3), F.least(F.lit(1e3), density(s["same"], d) / density(s["different"], d))))
    tokens = F.sqrt(F.greatest("tokens_a", F.lit(1)).cast("double") * F.greatest("tokens_b", F.lit(1)))
    both = distances_.join(F.broadcast(held)).withColumn("at_tokens", tokens)
    lower = F.filter("bins", lambda s: s["tokens"] <= F.col("at_tokens"))
    upper = F.filter("bins", lambda s: s["tokens"] >= F.col("at_tokens"))
    lo = F.coalesce(F.get(lower, F.size(lower) - 1), F.get(F.col("bins"), F.lit(0)))
    hi = F.coalesce(F.get(upper, F.lit(0)), F.get(F.col("bins"), F.size("bins") - 1))
    placed = both.withColumn("lo", lo).withColumn("hi", hi).withColumn("extrapolated", (F.size(lower) == 0) | (F.size(upper) == 0))
    span = F.ln(F.col("hi.tokens").cast("double")) - F.ln(F.col("lo.tokens").cast("double"))
    share = F.when(span > 0, (F.ln("at_tokens") - F.ln(F.col("lo.tokens").cast("double"))) / span).otherwise(0.0)
    blend = lambda f: f(F.col("lo")) * (1 - share) + f(F.col("hi")) * share
    return placed.select(
        "a", "b", "distance", "at_tokens", "extrapolated", blend(lambda s: ecdf(s["different"], d)).alias("p_unrelated"), blend(lambda s: 1 - ecdf(s["same"], d)).alias("p_same"), blend(ratio).alias("likelihood_ratio")
    )


#: Nodes of a bin's density table, less one, and how many bandwidths it reaches beyond the samples.
GRID, BEYOND = 256, 3.0


def thinned(pairs: DataFrame, keep: int = 2000) -> DataFrame:
    """(tokens, same, distance): at most `keep` evenly spaced order statistics of each bin and side."""
    side = Window.partitionBy("tokens", "same")
    numbered = pairs.withColumn("r", F.row_number().over(side.orderBy("distance")) - 1).withColumn("n", F.count("*").over(side))
    step = F.greatest(F.lit(1.0), (F.col("n") - 1) / (keep - 1))
    return numbered.where(F.round(F.round(F.col("r") / step) * step) == F.col("r")).select("tokens", "same", "distance")


def tables(samples: DataFrame, least: int = LEAST_SAMPLE, grid: int = GRID) -> DataFrame:
    """(tokens, low, width, cell, then for each side n, below, inside, left, right) of samples (tokens, same, distance): a bin's distances cut to cells, the
    sample in and below each, and its kernel density at both ends. Bins with less than `least` on a side are left out. Built once; an
    assessment looks up one cell."""
    q = F.percentile("distance", F.array(F.lit(0.25), F.lit(0.75)))
    sides = samples.groupBy("tokens", "same").agg(F.count("*").alias("n"), F.stddev_samp("distance").alias("sd"), q.alias("q"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    iqr = F.col("q")[1] - F.col("q")[0]
    h = 0.9 * F.when(iqr > 0, F.least("sd", iqr / 1.34)).otherwise(F.col("sd")) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    sides = sides.withColumn("h", h)
    bins = sides.groupBy("tokens").agg(F.count("*").alias("k"), F.min("n").alias("fewest"), (F.min("low") - BEYOND * F.max("h")).alias("low"), (F.max("high") + BEYOND * F.max("h")).alias("high"))
    bins = bins.where((F.col("k") == 2) & (F.col("fewest") >= least) & (F.col("high") > F.col("low"))).select("tokens", "low", ((F.col("high") - F.col("low")) / grid).alias("width"))
    placed = samples.join(bins, "tokens").join(sides.select("tokens", "same", "n", "h"), ["tokens", "same"])
    nodes = placed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(grid)))).withColumn("at", F.col("low") + F.col("cell") * F.col("width"))
    bump = F.when(F.col("h") > 0, F.exp(-0.5 * F.pow((F.col("at") - F.col("distance")) / F.col("h"), 2)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).otherwise(0.0)
    inside = (F.col("distance") >= F.col("at")) & (F.col("distance") < F.col("at") + F.col("width"))
    summed = nodes.groupBy("tokens", "low", "width", "cell", "same").agg(
        F.first("n").alias("n"), F.sum(bump).alias("density"), F.count_if(F.col("distance") < F.col("at")).alias("below"), F.collect_list(F.when(inside, F.col("distance"))).alias("inside"))
    after = F.lead("density").over(Window.partitionBy("tokens", "same").orderBy("cell"))
    ended = summed.withColumn("right", after).where(F.col("cell") < grid)
    pick = lambda c, same: F.first(F.when(F.col("same") == same, F.col(c)), ignorenulls=True)
    columns = {"n": "n", "below": "below", "inside": "inside", "left": "density", "right": "right"}
    return ended.groupBy("tokens", "low", "width", "cell").agg(*(pick(c, same).alias(f"{k}_{side}") for side, same in (("same", True), ("different", False)) for k, c in columns.items()))


def assess_by_tables(distances_: DataFrame, cells: DataFrame) -> DataFrame:
    """As `assess`, by `tables`: shares of the sample are exact, densities are interpolated in a cell and 0 beyond the table."""
    listed = cells.select("tokens", "low", "width").distinct().agg(F.array_sort(F.collect_list(F.struct("tokens", "low", "width"))).alias("bins"))  # one row of a few bins
    tokens = F.sqrt(F.greatest("tokens_a", F.lit(1)).cast("double") * F.greatest("tokens_b", F.lit(1)))
    both = distances_.join(F.broadcast(listed)).withColumn("at_tokens", tokens)
    lower, upper = (F.filter("bins", lambda s: s["tokens"] <= F.col("at_tokens")), F.filter("bins", lambda s: s["tokens"] >= F.col("at_tokens")))
    lo = F.coalesce(F.get(lower, F.size(lower) - 1), F.get(F.col("bins"), F.lit(0)))
    hi = F.coalesce(F.get(upper, F.lit(0)), F.get(F.col("bins"), F.size("bins") - 1))
    placed = both.select("a", "b", "distance", "at_tokens", lo.alias("lo"), hi.alias("hi"), ((F.size(lower) == 0) | (F.size(upper) == 0)).alias("extrapolated"))
    for side in ("lo", "hi"):
        cell = F.floor((F.col("distance") - F.col(f"{side}.low")) / F.col(f"{side}.width"))
        found = F.struct("n_same", "below_same", "inside_same", "left_same", "right_same", "n_different", "below_different", "inside_different", "left_different", "right_different").alias(f"{side}_found")
        one = cells.select(F.col("tokens").alias(f"{side}_tokens"), F.col("cell").alias(f"{side}_cell"), found)  # bins * GRID rows
        keyed = placed.withColumn(f"{side}_tokens", F.col(f"{side}.tokens")).withColumn(f"{side}_at", cell).withColumn(f"{side}_cell", F.greatest(F.lit(0), F.least(cell, F.lit(GRID - 1))).cast("int"))
        placed = keyed.join(one, [f"{side}_tokens", f"{side}_cell"])
    d = F.col("distance")

    def measured(side: str) -> dict[str, Column]:
        x = F.col(f"{side}_found")
        beyond = F.col(f"{side}_at") != F.col(f"{side}_cell")
        share = (d - F.col(f"{side}.low")) / F.col(f"{side}.width") - F.col(f"{side}_cell")
        at = lambda k: F.when(beyond, 0.0).otherwise(x[f"left_{k}"] + (x[f"right_{k}"] - x[f"left_{k}"]) * share)
        below = lambda k: (x[f"below_{k}"] + F.size(F.filter(x[f"inside_{k}"], lambda v: v <= d))) / x[f"n_{k}"]
        ratio = F.when(at("different") <= 1e-300, 1e3).otherwise(F.greatest(F.lit(1e-3), F.least(F.lit(1e3), at("same") / at("different"))))
        return {"p_unrelated": below("different"), "p_same": 1 - below("same"), "likelihood_ratio": ratio}

    span = F.ln(F.col("hi.tokens").cast("double")) - F.ln(F.col("lo.tokens").cast("double"))
    share = F.when(span > 0, (F.ln("at_tokens") - F.ln(F.col("lo.tokens").cast("double"))) / span).otherwise(0.0)
    one, two = measured("lo"), measured("hi")
    return placed.select("a", "b", "distance", "at_tokens", "extrapolated", *((one[k] * (1 - share) + two[k] * share).alias(k) for k in one))
