"""Measures of verse: of texts whose lines are mostly short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penstroke.functions.text import token_array, unpivot


def verse_rates(docs: DataFrame, least: int = 6, short: int = 14) -> DataFrame:
    """Geometry and figures per 100 lines; null unless there are `least` lines, half of them of at most `short` tokens."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l", "line")).withColumn("ws", token_array(F.col("line"))).where(F.size("ws") > 0)
    order = Window.partitionBy("doc_id").orderBy("l")
    head, tail = F.array_join(F.slice("ws", 1, 2), " "), F.array_join(F.slice("ws", -2, 2), " ")
    two = F.size("ws") >= 2
    framed = lines.select("doc_id", "l", F.size("ws").alias("n"), F.when(two, head).alias("head"), F.when(two, tail).alias("tail"), F.regexp("line", F.lit(r"^[\x20\x09]*\p{Ll}")).alias("lower"), F.regexp("line", F.lit(r"[.!?;:,…]['\"”’)]*[\x20\x09\x0D]*$")).alias("stop"))
    figured = framed.withColumn("anaphora", F.col("head") == F.lead("head").over(order)).withColumn("epistrophe", F.col("tail") == F.lead("tail").over(order))
    grouped = figured.groupBy("doc_id").agg(
        F.count("*").alias("k"), F.count_if(F.col("n") <= short).alias("short"), F.avg("n").alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd"),
        *(F.count_if(c).alias(name) for name, c in (("one_word", F.col("n") == 1), ("lower", F.col("lower")), ("end_stop", F.col("stop")), ("enjambment", ~F.col("stop")), ("anaphora", F.col("anaphora")), ("epistrophe", F.col("epistrophe")))),
    )
    gate = lambda value: F.when((F.col("k") >= least) & (F.col("short") >= 0.5 * F.col("k")), value)
    rate = lambda c: gate(100.0 * F.col(c) / F.col("k"))
    return unpivot(grouped, "doc_id", {
        "verse:line_len_mean": gate(F.col("mean")), "verse:line_len_stddev": gate(F.col("sd")), "verse:one_word_line_rate": rate("one_word"), "verse:lowercase_initial_rate": rate("lower"),
        "verse:end_stop_rate": rate("end_stop"), "verse:enjambment_rate": rate("enjambment"), "verse:figure:anaphora": rate("anaphora"), "verse:figure:epistrophe": rate("epistrophe"),
    })
