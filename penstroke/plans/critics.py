"""Queries of the loop around a critique, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.operators import critic, distance, features
from penstroke.plans.lexical import _q, query, rounded

_MARKS = ", ".join(f"({_q(name)}, {_q(chars)})" for name, chars in W.MARKS.items())


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    return turns.select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a conversation as its drafts: reported are the gaps of marks from their means over all answers, held out those of letters."""
    turns = _turns(spark, sf_dir)
    gap = lambda values: distance.z_scores(values, distance.dim_stats(values, W.NOISE_FLOORS["per_1k"])).groupBy("doc_id").agg(F.avg(F.abs("z")).alias("gap"))
    reported, held = gap(features.mark_rates(turns)), gap(features.letters(turns).withColumn("value", F.col("value") * 1000))
    scored = turns.select("session", "at", "doc_id").join(reported.withColumnRenamed("gap", "reported"), "doc_id").join(held.withColumnRenamed("gap", "canary"), "doc_id")
    return critic.with_content(scored.withColumn("p_same", F.exp(-3 * F.col("reported"))), turns)


_LOOP = rf"""t AS (SELECT conv_id AS session, turn AS place, conv_id * 1000 + turn AS doc_id, text, len(regexp_extract_all(lower(text), {_q(W.TOKEN)})) AS n FROM conversations WHERE role = 'assistant'),
r AS (SELECT doc_id, name AS dim, 1000.0 * (length(text) - length(translate(text, chars, ''))) / n AS value FROM t CROSS JOIN (VALUES {_MARKS}) m(name, chars) WHERE n > 0),
a AS (SELECT doc_id, list_filter(string_split(lower(text), ''), lambda c: c BETWEEN 'a' AND 'z' AND strlen(c) = 1) AS cs, list_filter(string_split(text, ''), lambda c: c BETWEEN '0' AND '9' AND strlen(c) = 1) AS ds FROM t),
l AS (SELECT doc_id, c AS dim, CASE WHEN len(cs) > 0 THEN 1000.0 * len(list_filter(cs, lambda x: x = c)) / len(cs) ELSE 0 END AS value FROM a CROSS JOIN (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c)
  UNION ALL SELECT doc_id, c, CASE WHEN len(ds) > 0 THEN 1000.0 * len(list_filter(ds, lambda x: x = c)) / len(ds) ELSE 0 END FROM a CROSS JOIN (SELECT unnest(string_split('0123456789', '')) AS c)),
v AS (SELECT 'reported' AS side, * FROM r UNION ALL SELECT 'canary', * FROM l),
s AS (SELECT side, dim, avg(value) AS mean, greatest(coalesce(stddev_samp(value), 0), 0.5) AS scale FROM v GROUP BY side, dim),
g AS (SELECT doc_id, avg(abs((value - mean) / scale)) FILTER (side = 'reported') AS reported, avg(abs((value - mean) / scale)) FILTER (side = 'canary') AS canary FROM v JOIN s USING (side, dim) GROUP BY doc_id),
f AS (SELECT session, place, doc_id, reported, canary, list_distinct(list_filter(regexp_extract_all(lower(text), {_q(W.TOKEN)}), lambda w: length(w) > 2)) AS words, string_split(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), '') AS c FROM t JOIN g USING (doc_id) WHERE reported IS NOT NULL),
h AS (SELECT *, list_distinct(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])) AS grams FROM f),
w AS (SELECT *, row_number() OVER o AS iteration, lag(reported) OVER o AS r0, lag(canary) OVER o AS c0, first_value(words) OVER o AS w0, first_value(grams) OVER o AS g0 FROM h WINDOW o AS (PARTITION BY session ORDER BY place, doc_id)),
j AS (SELECT *, CASE WHEN iteration > 1 THEN (CASE WHEN len(words) + len(w0) = 0 THEN 1 ELSE len(list_intersect(words, w0))::DOUBLE / len(list_distinct(list_concat(words, w0))) END
  + CASE WHEN len(grams) + len(g0) = 0 THEN 1 ELSE len(list_intersect(grams, g0))::DOUBLE / len(list_distinct(list_concat(grams, g0))) END) / 2 END AS kept FROM w),
steps AS (SELECT session, doc_id, iteration, exp(-3 * reported) >= {critic.PASS} AS passed, NOT coalesce(reported < r0 * (1 - {critic.CHANGE}) AND canary > c0 * (1 + {critic.CHANGE}), false) AS canary_ok, coalesce(kept, 1) >= {critic.LEAST_OVERLAP} AS drift_ok, kept FROM j)"""


@query(f"""WITH {_LOOP} SELECT session, doc_id, iteration, passed, canary_ok, drift_ok, round(kept, 6) AS content_overlap, CASE WHEN passed THEN 0 ELSE 1 END::BIGINT AS exit_code FROM steps""")
def review_loops(spark, sf):
    """Answers of each conversation as drafts of one session: gate, canary, drift and exit code."""
    return rounded(critic.advance(_scored(spark, sf)))


@query(f"""WITH {_LOOP} SELECT session, count(*)::BIGINT AS drafts, arg_min(iteration, CASE WHEN passed THEN iteration ELSE 1000000 + iteration END)::BIGINT AS settled, count(*) FILTER (NOT canary_ok)::BIGINT AS tripped FROM steps GROUP BY session""")
def loop_outcomes(spark, sf):
    """Of each session: its drafts, the first that passed (else the first), and how often its canary failed."""
    steps = critic.advance(_scored(spark, sf))
    return steps.groupBy("session").agg(
        F.count("*").alias("drafts"), F.min_by("iteration", F.when(F.col("passed"), F.col("iteration")).otherwise(1_000_000 + F.col("iteration"))).alias("settled"), F.count_if(~F.col("canary_ok")).alias("tripped"),
    )
