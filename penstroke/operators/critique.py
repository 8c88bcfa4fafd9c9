"""What in a draft lies outside a reference's bands, how far, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.functions.text import occurrences, token_array

SEVERITIES = ("low", "medium", "high")
LEAST_DEVIATION = 0.05


def _severity(z: Column, deviation: Column) -> Column:
    by_z = F.when(F.abs(z) >= 3, 2).when(F.abs(z) >= 2, 1).otherwise(0)
    return F.greatest(by_z, F.when(deviation >= 1, 2).when(deviation >= 0.35, 1).otherwise(0))


def findings(values: DataFrame, stats: DataFrame, floor: float = W.NOISE_FLOORS["per_1k"], most: int = 10, least: str = "low") -> DataFrame:
    """(doc_id, rank, id, severity, direction, observed, low, high, z, deviation, message): dimensions of a document outside the band
    from the 5th to the 95th percentile (of a constant dimension, outside the constant), the gravest first, at most `most` a document."""
    joined = values.where("value IS NOT NULL").join(F.broadcast(stats), "dim")
    low, high = F.when(F.col("degenerate"), F.col("min")).otherwise(F.col("p05")), F.when(F.col("degenerate"), F.col("max")).otherwise(F.col("p95"))
    return _outside(joined.withColumn("low", low).withColumn("high", high), floor, most, least)


def contrast_findings(values: DataFrame, toward: DataFrame, pulls: DataFrame, stats: DataFrame, floor: float = W.NOISE_FLOORS["per_1k"], most: int = 10, least: str = "low") -> DataFrame:
    """As `findings`, for a move from one corpus toward another: of the dimensions that pull a document (pulls: doc_id, dim, pull over 0) to the
    side it is to leave, those outside half a deviation (a quarter of the floor at least) around the other side's value (toward: dim, value)."""
    half = F.greatest(F.col("sd") * 0.5, F.lit(floor * 0.25))
    aims = stats.join(toward.select("dim", F.col("value").alias("aim")), "dim").withColumn("low", F.col("aim") - half).withColumn("high", F.col("aim") + half)
    pulled = values.where("value IS NOT NULL").join(pulls.where("pull > 0").select("doc_id", "dim"), ["doc_id", "dim"], "left_semi")
    return _outside(pulled.join(F.broadcast(aims), "dim"), floor, most, least)


def _outside(banded: DataFrame, floor: float, most: int, least: str) -> DataFrame:
    """Findings of values outside their band (low, high)."""
    placed = banded.withColumn("direction", F.when(F.col("value") > F.col("high"), "reduce").when(F.col("value") < F.col("low"), "increase")).where("direction IS NOT NULL")
    edge = F.when(F.col("direction") == "reduce", F.col("high")).otherwise(F.col("low"))
    z = F.when(F.col("scale") > 0, (F.col("value") - F.col("mean")) / F.col("scale")).otherwise(0.0)
    scored = placed.withColumn("edge", edge).withColumn("z", z).withColumn("deviation", F.abs(F.col("value") - edge) / (F.abs(edge) + floor)).where(F.col("deviation") >= LEAST_DEVIATION)
    graded = scored.withColumn("level", _severity(F.col("z"), F.col("deviation"))).where(F.col("level") >= SEVERITIES.index(least))
    change = F.when(F.col("value") != 0, F.format_string("%s ~%.0f%%", "direction", F.abs((F.col("value") - F.col("edge")) / F.col("value") * 100))).otherwise(F.concat("direction", F.lit(" from zero")))
    order = Window.partitionBy("doc_id").orderBy(F.desc("level"), F.desc(F.round("deviation", 9)), "dim")
    ranked = graded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select(
        "doc_id", "rank", F.translate("dim", ":", ".").alias("id"), F.get(F.array(*map(F.lit, SEVERITIES)), F.col("level")).alias("severity"), "direction", F.col("value").alias("observed"), "low", "high", "z", "deviation",
        F.concat(F.format_string("%.2f per 1k tokens vs reference band %.2f-%.2f - ", "value", "low", "high"), change).alias("message"),
    )


def capped_distance(contributions: DataFrame, share: float = 0.05) -> DataFrame:
    """(a, b, distance) with each contribution clamped to a share of all their sizes together."""
    size = F.sum(F.abs("contribution")).over(Window.partitionBy("a", "b"))
    clamped = contributions.withColumn("cap", share * size).withColumn("c", F.greatest(-F.col("cap"), F.least(F.col("contribution"), F.col("cap"))))
    return clamped.groupBy("a", "b").agg(F.sum("c").alias("distance"))


def report(found: DataFrame, version: str = "1") -> DataFrame:
    """(doc_id, report): a JSON document of each document's findings."""
    item = F.struct("rank", "id", "severity", "direction", "observed", F.array("low", "high").alias("target_band"), "z", "message")
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("findings")).select("doc_id", F.to_json(F.struct(F.lit(version).alias("version"), "findings")).alias("report"))


def exit_code(severity: Column) -> Column:
    """0 clean, 1 findings, 2 a grave one: the greatest of a document's."""
    return F.when(severity == "high", 2).when(severity.isNotNull(), 1).otherwise(0)


def fingerprint(docs: DataFrame, function_words: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, words, grams): what a revision must keep: distinct content words of over two letters, and hashes of 4 characters."""
    forms = F.filter(token_array(F.col("text")), lambda w: (F.length(w) > 2) & ~w.isin(*function_words) if function_words else F.length(w) > 2)
    chars = F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", " "), "")
    held = docs.select("doc_id", F.array_distinct(forms).alias("words"), chars.alias("c"))
    cuts = F.when(F.size("c") >= 4, F.transform(F.sequence(F.lit(0), F.size("c") - 4), lambda i: F.concat(*(F.get("c", i + k) for k in range(4))))).otherwise(F.array().cast("array<string>"))
    return held.select("doc_id", "words", F.array_distinct(cuts).alias("grams"))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 1 of two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def rolling(docs: DataFrame, vocabulary: list[str], target: DataFrame, size: int, step: int) -> DataFrame:
    """(doc_id, start, distance): Burrows distance of each overlapping window of tokens to target (dim, mean, scale, z)."""
    held = docs.select("doc_id", token_array(F.col("text")).alias("ws")).where(F.size("ws") >= size)
    cut = held.select("doc_id", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - size, F.lit(step))).alias("start")).select("doc_id", "start", F.slice("ws", F.col("start") + 1, size).alias("ws"))
    rates = F.array(*(F.struct(F.lit(v).alias("dim"), (occurrences("ws", v) / size).alias("value")) for v in vocabulary))
    each = cut.select("doc_id", "start", F.explode(rates).alias("r")).select("doc_id", "start", "r.*").join(F.broadcast(target), "dim")
    return each.groupBy("doc_id", "start").agg(F.avg(F.abs((F.col("value") - F.col("mean")) / F.col("scale") - F.col("z"))).alias("distance"))
