"""Queries of calibration over sampled pairs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.functions.text import token_array
from penstroke.operators import calibrate
from penstroke.plans.lexical import TOK, documents, query, rounded

SIZES, PER_AUTHOR, SEED = (40, 120), 4, 3
#: Words that are counted: closed classes of the corpus' languages.
WORDS = "the of and to in is it that for was la le les des du que qui dans der die das und zu den ist nicht el los las y en del por con".split()


def _cut(spark: SparkSession, sf_dir: str, size: int | None) -> DataFrame:
    """(id, author, tokens, x): word rates of sampled windows, or of the sampled documents whole."""
    docs = documents(spark, sf_dir)
    drawn = calibrate.windows(docs, size or max(SIZES), PER_AUTHOR, SEED)
    if size is None:
        drawn = docs.join(drawn.select("doc_id"), "doc_id").select("doc_id", "author", token_array(F.col("text")).alias("ws"))
    rates = F.transform(F.array(*map(F.lit, WORDS)), lambda v: F.size(F.filter("ws", lambda w: w == v)) / F.size("ws"))
    return drawn.select(F.col("doc_id").alias("id"), "author", F.size("ws").alias("tokens"), rates.alias("x"))


def _pairs(vectors: DataFrame) -> DataFrame:
    """(a, b, same, distance, tokens_a, tokens_b) of each two of a bounded sample: mean difference of rates over the noise floor."""
    a, b = (vectors.select(*(F.col(c).alias(f"{c}_{k}") for c in vectors.columns)) for k in "ab")
    gap = F.aggregate(F.zip_with("x_a", "x_b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / (len(WORDS) * W.NOISE_FLOORS["frequency"])
    return a.join(b, F.col("id_a") < F.col("id_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), (F.col("author_a") == F.col("author_b")).alias("same"), F.round(gap, 9).alias("distance"), "tokens_a", "tokens_b")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for size in SIZES:
        one = _pairs(_cut(spark, sf_dir, size)).select(F.lit(size).alias("tokens"), "same", "distance")
        out = one if out is None else out.unionByName(one)
    return calibrate.thinned(out, 400)


_SIDE = "PARTITION BY tokens, same"
_SQL = rf"""{TOK}, sizes AS (SELECT unnest([{', '.join(map(str, SIZES))}]) AS size),
drawn AS (SELECT size, doc_id, author, ws, row_number() OVER (PARTITION BY size, author ORDER BY md5('{SEED}:' || doc_id), doc_id) AS rn FROM docs CROSS JOIN sizes WHERE len(ws) >= size),
cuts AS (SELECT size, doc_id AS id, author, (('0x' || left(md5('{SEED + 1}:' || doc_id), 8))::BIGINT % (len(ws) - size + 1))::BIGINT AS pos, ws FROM drawn WHERE rn <= {PER_AUTHOR}),
texts AS (SELECT size, id, author, ws[pos + 1:pos + size] AS ws FROM cuts UNION ALL SELECT 0, id, author, ws FROM cuts WHERE size = {max(SIZES)}),
vecs AS (SELECT size, id, author, len(ws) AS tokens, list_transform([{', '.join("'" + w + "'" for w in WORDS)}], lambda v: len(list_filter(ws, lambda w: w = v))::DOUBLE / len(ws)) AS x FROM texts),
pairs AS (SELECT a.size, a.id AS a, b.id AS b, a.author = b.author AS same, a.tokens AS ta, b.tokens AS tb, round(list_sum(list_transform(range(1, {len(WORDS) + 1}), lambda i: abs(a.x[i] - b.x[i]))) / ({len(WORDS)} * {W.NOISE_FLOORS['frequency']}), 9) AS distance
  FROM vecs a JOIN vecs b ON a.size = b.size AND a.id < b.id),
numbered AS (SELECT size AS tokens, same, distance, row_number() OVER ({_SIDE.replace('tokens', 'size')} ORDER BY distance) - 1 AS r, count(*) OVER ({_SIDE.replace('tokens', 'size')}) AS n FROM pairs WHERE size > 0),
samples AS (SELECT tokens, same, distance FROM numbered WHERE round(round(r / greatest(1.0, (n - 1) / 399.0)) * greatest(1.0, (n - 1) / 399.0)) = r),
q AS (SELECT tokens, same, count(*) AS n, stddev_samp(distance) AS sd, quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25) AS iqr, min(distance) AS low, max(distance) AS high FROM samples GROUP BY tokens, same),
sides AS (SELECT *, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34) ELSE sd END * pow(n, -0.2) AS h FROM q),
bins AS (SELECT tokens, min(low) - 3 * max(h) AS low, (max(high) - min(low) + 6 * max(h)) / {calibrate.GRID} AS width FROM sides GROUP BY tokens HAVING count(*) = 2 AND min(n) >= {calibrate.LEAST_SAMPLE}),
asked AS (SELECT a, b, distance, sqrt(ta::DOUBLE * tb) AS at_tokens FROM pairs WHERE size = 0),
placed AS (SELECT *, coalesce((SELECT max(tokens) FROM bins WHERE tokens <= at_tokens), (SELECT min(tokens) FROM bins)) AS lo, coalesce((SELECT min(tokens) FROM bins WHERE tokens >= at_tokens), (SELECT max(tokens) FROM bins)) AS hi,
  (SELECT count(*) FROM bins WHERE tokens <= at_tokens) = 0 OR (SELECT count(*) FROM bins WHERE tokens >= at_tokens) = 0 AS extrapolated FROM asked),
spots AS (SELECT DISTINCT distance, tokens, low, width, floor((distance - low) / width) AS cell FROM (SELECT distance, unnest([lo, hi]) AS tokens FROM placed) JOIN bins USING (tokens)),
ends AS (SELECT s.tokens, s.distance, v.same, count(*) FILTER (v.distance <= s.distance)::DOUBLE / count(*) AS below, any_value(s.cell) AS cell,
  sum(exp(-0.5 * pow((s.low + cell * width - v.distance) / h, 2)) / (n * h * sqrt(2 * pi()))) AS l, sum(exp(-0.5 * pow((s.low + (cell + 1) * width - v.distance) / h, 2)) / (n * h * sqrt(2 * pi()))) AS r, any_value((s.distance - s.low) / width - cell) AS share
  FROM spots s JOIN samples v ON v.tokens = s.tokens JOIN sides d ON d.tokens = v.tokens AND d.same = v.same GROUP BY s.tokens, s.distance, v.same),
found AS (SELECT tokens, distance, max(below) FILTER (NOT same) AS p_unrelated, 1 - max(below) FILTER (same) AS p_same, max(CASE WHEN cell BETWEEN 0 AND {calibrate.GRID - 1} THEN l + (r - l) * share ELSE 0 END) FILTER (same) AS ds,
  max(CASE WHEN cell BETWEEN 0 AND {calibrate.GRID - 1} THEN l + (r - l) * share ELSE 0 END) FILTER (NOT same) AS dd FROM ends GROUP BY tokens, distance),
rated AS (SELECT *, CASE WHEN dd <= 1e-300 THEN 1e3 ELSE greatest(1e-3, least(1e3, ds / dd)) END AS ratio FROM found),
worth AS (SELECT p.*, CASE WHEN hi > lo THEN (ln(at_tokens) - ln(lo)) / (ln(hi) - ln(lo)) ELSE 0 END AS s FROM placed p)
SELECT w.a, w.b, round(w.distance, 6) AS distance, round(at_tokens, 6) AS at_tokens, extrapolated, round(x.p_unrelated * (1 - s) + y.p_unrelated * s, 6) + 0.0 AS p_unrelated, round(x.p_same * (1 - s) + y.p_same * s, 6) + 0.0 AS p_same, round(x.ratio * (1 - s) + y.ratio * s, 4) + 0.0 AS likelihood_ratio
FROM worth w JOIN rated x ON x.tokens = w.lo AND x.distance = w.distance JOIN rated y ON y.tokens = w.hi AND y.distance = w.distance"""


@query(f"WITH {_SQL}")
def assessed_pairs(spark, sf):
    """Every two of the sampled documents, whole, assessed against distributions of windows of two lengths."""
    asked = _pairs(_cut(spark, sf, None)).drop("same")
    found = calibrate.assess_by_tables(asked, calibrate.tables(_samples(spark, sf)))
    return rounded(found.withColumn("likelihood_ratio", F.round("likelihood_ratio", 4)))
