"""Corpora: authors and their documents in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def authors(docs: DataFrame) -> DataFrame:
    """(author, n_docs, n_chars): a row for each author, without collecting their documents."""
    return docs.groupBy("author").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


def aggregate(docs: DataFrame, *by: str) -> DataFrame:
    """One pseudo-document for each group: its texts in the order of doc_id, a blank line between."""
    keys = by or ("author",)
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    return docs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def split_halves(docs: DataFrame) -> DataFrame:
    """docs of authors with two documents or more, with `half` 0 for the first n / 2 of them and 1 for the rest."""
    whole = Window.partitionBy("author")
    numbered = docs.withColumn("rn", F.row_number().over(whole.orderBy("doc_id"))).withColumn("n", F.count("*").over(whole))
    return numbered.where("n >= 2").withColumn("half", F.when(F.col("rn") <= F.floor(F.col("n") / 2), 0).otherwise(1)).drop("rn", "n")


def held_out(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """docs with held_out: k documents of each author that has at least 3k, by a seeded hash order."""
    order = Window.partitionBy("author").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), "doc_id")
    numbered = docs.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("author")))
    return numbered.withColumn("held_out", (F.col("n") >= 3 * k) & (F.col("rn") <= k)).drop("rn", "n")


def exact_dedupe(docs: DataFrame) -> DataFrame:
    """The first document of each text, white space aside: an aggregate over digests, so copies never meet in one task."""
    keyed = docs.withColumn("digest", F.sha1(F.regexp_replace(F.trim("text"), r"[\x20\x09-\x0D]+", " ")))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return keyed.join(first.select("doc_id"), "doc_id", "left_semi").drop("digest")
