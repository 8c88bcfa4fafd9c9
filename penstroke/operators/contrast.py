"""Terms that set two corpora apart: log-odds under an informative Dirichlet prior."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penstroke.operators.vocabulary import term_frequencies


def log_odds(a: DataFrame, b: DataFrame, min_count: int = 5, mass: float | None = None, background: DataFrame | None = None, private: bool = False) -> DataFrame:
    """(term, n_a, n_b, df, delta, variance, z); a and b are (doc_id, term).

    The prior spreads `mass` (the smaller total unless given) over terms by their frequency in both sides and the background,
    each counted half more. Totals count all terms, also those left out for being below min_count or, of private corpora,
    in fewer than five documents."""
    left, right = (term_frequencies(x).select("term", F.col("n").alias(f"n_{s}"), F.col("df").alias(f"df_{s}")) for x, s in ((a, "a"), (b, "b")))
    joined = left.join(right, "term", "full_outer").fillna(0)
    prior = F.col("n_a") + F.col("n_b")
    if background is not None:
        joined = joined.join(background.select("term", F.col("n").alias("n_bg")), "term", "left").fillna(0)
        prior = F.col("n_bg")
    joined = joined.withColumn("prior", prior + 0.5)
    totals = joined.agg(F.sum("n_a").alias("ta"), F.sum("n_b").alias("tb"), F.sum("prior").alias("tp"))
    both = joined.join(F.broadcast(totals))  # one row
    size = F.lit(mass) if mass is not None else F.least("ta", "tb").cast("double")
    alpha = size * F.col("prior") / F.col("tp")
    ya, yb = F.col("n_a") + F.col("alpha"), F.col("n_b") + F.col("alpha")
    odds = lambda y, total: F.ln(y / (total + F.col("size") - y))
    scored = both.withColumn("size", size).withColumn("alpha", alpha).withColumn("delta", odds(ya, F.col("ta")) - odds(yb, F.col("tb"))).withColumn("variance", 1 / ya + 1 / yb)
    kept = scored.where(F.col("n_a") + F.col("n_b") >= min_count)
    if private:
        kept = kept.where("df_a + df_b >= 5")
    return kept.select("term", "n_a", "n_b", (F.col("df_a") + F.col("df_b")).alias("df"), "delta", "variance", (F.col("delta") / F.sqrt("variance")).alias("z"))


def ranked(models: dict[str, DataFrame], k: int) -> DataFrame:
    """The k strongest terms of each universe, interleaved: ranks of different universes are never pooled by score."""
    parts = [m.orderBy(F.desc(F.abs("z")), "term").limit(k).withColumn("universe", F.lit(name)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("z")), "term"))) for name, m in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("rank", "universe")


def to_vocabulary(model: DataFrame, least: float) -> DataFrame:
    """Terms whose |z| reaches `least`, as a vocabulary for rates."""
    return model.where(F.abs("z") >= least).select("term", "z")


def terms_of_side(odds: DataFrame, n: int, a: bool = True) -> DataFrame:
    """The n terms most typical of side A (or B), with their rank; ties by term."""
    order = [F.desc("z") if a else F.asc("z"), F.asc("term")]
    return odds.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # n rows
