"""Queries of lexicons, norms, calibration, verification and critique, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.functions.text import token_array
from penstroke.operators import calibrate, critique, distance, features, lexicon, phrases, verify, vocabulary
from penstroke.plans.lexical import _MARK, _Z, TOK, _author_vectors, _long, _q, _values, documents, query, rounded

#: A small pack of closed-class words of the corpus' four languages.
CLOSED = lexicon.check_pack({
    "name": "closed-class", "version": "2026.11", "license": "CC0-1.0", "redistributable": True,
    "terms": [
        {"id": f"{lang}-{w}", "word": w, "category": lang}
        for lang, listed in (("english", "the of and to in is it that for was"), ("french", "le la les des du que qui dans pour avec"), ("german", "der die das und zu den ist nicht sich auf"), ("spanish", "el los las y en del por con para una"))
        for w in listed.split()
    ],
})
#: Patterns over tokens: a gap, either of two words, a number.
PATTERNS = lexicon.check_pack({
    "name": "patterns", "version": "2026.11", "license": "CC0-1.0", "redistributable": True,
    "phrases": [
        {"id": "the-of", "pattern": "the * of", "category": "frame"}, {"id": "either-the", "pattern": "{in|of} the", "category": "frame"}, {"id": "number-word", "pattern": "# is", "category": "number"},
        {"id": "le-de", "pattern": "le * de", "category": "frame"}, {"id": "de-la", "pattern": "de la", "category": "frame"},
    ],
})
_TERMS = f"p(id, w, category) AS (VALUES {_values((t['id'], t['word'], t['category']) for t in CLOSED['terms'])})"


@query(f"""WITH {TOK}, {_TERMS}, h AS (SELECT doc_id, id, category, count(*) AS c FROM tok JOIN p USING (w) GROUP BY ALL),
d AS (SELECT doc_id, 'lex:closed-class:' || id AS dim, c FROM h UNION ALL SELECT doc_id, 'lex:closed-class:cat:' || category, c FROM h UNION ALL SELECT doc_id, 'lex:closed-class:total', c FROM h)
SELECT doc_id, dim, round(1000.0 * sum(c) / any_value(z.n), 6) AS value FROM d JOIN sized z USING (doc_id) GROUP BY doc_id, dim""")
def lexicon_terms(spark, sf):
    return rounded(lexicon.lexicon_rates(documents(spark, sf), CLOSED))


def _phrase(pattern: str) -> str:
    """A pattern over tokens with a space behind each, from the first on."""
    part = lambda words: "".join({"*": "([^ ]+ ){1,4}", "#": "([0-9][0-9,.%kmb]*|[0-9][0-9,.]*[a-z]*) "}.get(w, w + " ") for w in words)
    return "^" + "".join("(" + "|".join(map(part, choices)) + ")" for choices in phrases.elements(pattern))


_HITS = " UNION ALL ".join(f"SELECT doc_id, {_q(p['id'])} AS id, {_q(p['category'])} AS category FROM l WHERE regexp_matches(line, {_q(_phrase(p['pattern']))})" for p in PATTERNS["phrases"])


@query(f"""WITH {TOK}, l AS (SELECT doc_id, array_to_string(ws[i:i + 12], ' ') || ' ' AS line FROM (SELECT doc_id, ws, unnest(range(1, n + 1)) AS i FROM sized)),
h AS (SELECT doc_id, id, category, count(*) AS c FROM ({_HITS}) GROUP BY ALL),
d AS (SELECT doc_id, 'lex:patterns:' || id AS dim, c FROM h UNION ALL SELECT doc_id, 'lex:patterns:cat:' || category, c FROM h UNION ALL SELECT doc_id, 'lex:patterns:total', c FROM h)
SELECT doc_id, dim, round(1000.0 * sum(c) / any_value(z.n), 6) AS value FROM d JOIN sized z USING (doc_id) GROUP BY doc_id, dim""")
def lexicon_phrases(spark, sf):
    return rounded(lexicon.lexicon_rates(documents(spark, sf), PATTERNS))


def _norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(token_array(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.length("term").cast("double").alias("score"))


_NORM = f"""WITH {TOK}, b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {_q(W.TOKEN)})) AS w FROM benchmark), norm AS (SELECT w, length(w)::DOUBLE AS score FROM b),
s AS (SELECT doc_id, score FROM tok JOIN norm USING (w)), q AS (SELECT quantile_cont(score, 0.75) AS q FROM norm)"""


@query(f"{_NORM}, g AS (SELECT doc_id, count(*) AS n, avg(score) AS m, quantile_cont(score, 0.9) AS p, avg((score >= q)::INT) AS h FROM s CROSS JOIN q GROUP BY doc_id) " + _long(
    {f"norm:length:{k}": f"CASE WHEN n >= 20 THEN {v} END" for k, v in (("mean", "m"), ("p90", "p"), ("high_share", "h"))}, "g"))
def norm_density(spark, sf):
    return rounded(lexicon.norm_density(documents(spark, sf), _norms(spark, sf), "length"))


@query(f"""{_NORM}, m AS (SELECT doc_id, score, avg(score) OVER (PARTITION BY doc_id) AS m FROM s),
g AS (SELECT doc_id, count(*) AS n, any_value(m) AS m, coalesce(var_samp(score), 0) AS v, avg((score - m) ** 2) AS m2, avg((score - m) ** 3) AS m3, avg((score - m) ** 4) AS m4 FROM m GROUP BY doc_id) """ + _long({
    "form:mean": "CASE WHEN n >= 20 THEN m END", "form:variance": "CASE WHEN n >= 20 THEN v END",
    "form:bimodality": "CASE WHEN n >= 20 THEN CASE WHEN m2 > 1e-12 THEN (m3 * m3 / (m2 * m2 * m2) + 1) / (m4 / (m2 * m2)) ELSE 0 END END"}, "g"))
def formality_distribution(spark, sf):
    return rounded(lexicon.formality(documents(spark, sf), _norms(spark, sf)))


@query(f"""WITH {TOK}, p AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM tok)
SELECT doc_id, 'dev:litotes_rate' AS dim, round(1000.0 * count(*) FILTER (WHERE w = 'not' AND (starts_with(x, 'un') OR starts_with(x, 'in') OR x IN ('bad', 'small', 'uncommon', 'unlike', 'without'))) / count(*), 6) AS value FROM p GROUP BY doc_id""")
def litotes(spark, sf):
    return rounded(lexicon.litotes(documents(spark, sf)))


@query(f"""WITH {TOK}, p AS (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS term FROM tok), k AS (SELECT term FROM p JOIN documents USING (doc_id) WHERE lang = 'en' AND term IS NOT NULL GROUP BY term HAVING count(DISTINCT doc_id) >= 2)
SELECT z.doc_id, 'dev:novel_pair_rate' AS dim, round(1000.0 * count(p.term) FILTER (WHERE p.term NOT IN (SELECT term FROM k)) / any_value(z.n), 6) AS value FROM sized z LEFT JOIN p ON p.doc_id = z.doc_id AND p.term IS NOT NULL GROUP BY z.doc_id""")
def novel_pairs(spark, sf):
    docs = documents(spark, sf)
    return rounded(lexicon.novel_pairs(docs, docs.where("lang = 'en'")))


_CONTEST = f"""{_Z}, it AS (SELECT unnest(range(0, 100)) AS it), o AS (SELECT DISTINCT author FROM z WHERE author NOT IN ('src0', 'src1')),
d AS (SELECT it, term FROM (SELECT it, term, row_number() OVER (PARTITION BY it ORDER BY md5('1:dim:' || it || ':' || term), term) AS r FROM it CROSS JOIN (SELECT DISTINCT term FROM z)) WHERE r <= 25),
m AS (SELECT it, author FROM (SELECT it, author, row_number() OVER (PARTITION BY it ORDER BY md5('1:id:' || it || ':' || author), author) AS r FROM it CROSS JOIN o) WHERE r <= (SELECT count(*) // 2 FROM o)),
e AS (SELECT d.it, p.b, avg(abs(x - y)) AS d FROM d JOIN p ON p.term = d.term GROUP BY d.it, p.b),
w AS (SELECT e.it, min(CASE WHEN e.b = 'src1' THEN e.d END) AS t, min(CASE WHEN m.author IS NOT NULL THEN e.d END) AS o FROM e LEFT JOIN m ON m.it = e.it AND m.author = e.b GROUP BY e.it)
SELECT round(avg((t < o)::INT), 6) AS score, CASE WHEN avg((t < o)::INT) < 0.35 THEN 'disfavoured' WHEN avg((t < o)::INT) > 0.65 THEN 'favoured' ELSE 'abstain' END AS verdict FROM w"""


@query(_CONTEST)
def verify_author(spark, sf):
    z, _, _ = _author_vectors(spark, sf)
    asked = z.where("id = 'src0'").select("dim", F.col("z").alias("x"))
    others = z.where("id != 'src0'").select("id", (F.col("id") == "src1").alias("target"), "dim", F.col("z").alias("y"))
    return rounded(verify.impostor_scores(asked, others).withColumn("verdict", verify.verdict(F.col("score"))))


_STATS = """s AS (SELECT dim, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, greatest(coalesce(stddev_samp(value), 0), 0.5) AS scale, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM v GROUP BY dim),
b AS (SELECT v.doc_id, v.dim, v.value, mean, scale, CASE WHEN sd <= 1e-12 + 1e-9 * abs(mean) THEN mn ELSE p05 END AS low, CASE WHEN sd <= 1e-12 + 1e-9 * abs(mean) THEN mx ELSE p95 END AS high FROM v JOIN s ON s.dim = v.dim),
e AS (SELECT *, CASE WHEN value > high THEN 'reduce' WHEN value < low THEN 'increase' END AS direction, CASE WHEN value > high THEN high ELSE low END AS edge, (value - mean) / scale AS z FROM b WHERE value > high OR value < low),
f AS (SELECT *, abs(value - edge) / (abs(edge) + 0.5) AS deviation FROM e),
l AS (SELECT *, greatest(CASE WHEN abs(z) >= 3 THEN 2 WHEN abs(z) >= 2 THEN 1 ELSE 0 END, CASE WHEN deviation >= 1 THEN 2 WHEN deviation >= 0.35 THEN 1 ELSE 0 END) AS level FROM f WHERE deviation >= 0.05),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC, round(deviation, 9) DESC, dim) AS rank FROM l)"""


@query(f"""{_MARK}, {_STATS} SELECT doc_id, rank::BIGINT AS rank, replace(dim, ':', '.') AS id, ['low', 'medium', 'high'][level + 1] AS severity, direction, round(value, 6) + 0.0 AS observed, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(z, 6) + 0.0 AS z, round(deviation, 6) + 0.0 AS deviation FROM r WHERE rank <= 10""")
def critique_findings(spark, sf):
    values = features.mark_rates(documents(spark, sf))
    return rounded(critique.findings(values, distance.dim_stats(values, W.NOISE_FLOORS["per_1k"])).drop("message"))


@query()
def critique_reports(spark, sf):
    values = features.mark_rates(documents(spark, sf))
    return critique.report(critique.findings(values, distance.dim_stats(values, W.NOISE_FLOORS["per_1k"])))


@query(f"""{_Z}, c AS (SELECT b, term, abs(x - y) / 50 AS c FROM p), t AS (SELECT b, sum(abs(c)) AS t FROM c GROUP BY b) SELECT b AS author, round(sum(least(c, 0.05 * t)), 6) AS distance FROM c JOIN t USING (b) GROUP BY b""")
def capped_distances(spark, sf):
    z, _, _ = _author_vectors(spark, sf)
    paired = distance.pairs(z.where("id = 'src0'"), z.where("id != 'src0'"), "z")
    return rounded(critique.capped_distance(distance.contributions(paired, "burrows")).select(F.col("b").alias("author"), "distance"))


@query(rf"""WITH {TOK}, f AS (SELECT d.doc_id, list_distinct(list_filter(ws, lambda w: length(w) > 2)) AS words, string_split(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), '') AS c FROM docs d),
g AS (SELECT doc_id, words, list_distinct(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])) AS grams FROM f),
p AS (SELECT a.doc_id, a.words AS wa, b.words AS wb, a.grams AS ga, b.grams AS gb FROM g a JOIN g b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round((CASE WHEN len(wa) + len(wb) = 0 THEN 1 ELSE len(list_intersect(wa, wb))::DOUBLE / len(list_distinct(list_concat(wa, wb))) END
  + CASE WHEN len(ga) + len(gb) = 0 THEN 1 ELSE len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(list_concat(ga, gb))) END) / 2, 6) AS kept FROM p""")
def content_kept(spark, sf):
    held = critique.fingerprint(documents(spark, sf))
    after = held.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("w2"), F.col("grams").alias("g2"))
    return rounded(held.join(after, "doc_id").select("doc_id", ((critique.overlap(F.col("words"), F.col("w2")) + critique.overlap(F.col("grams"), F.col("g2"))) / 2).alias("kept")))


def _sampled(spark: SparkSession, sf_dir: str, size: int, per_author: int = 5) -> DataFrame:
    docs = documents(spark, sf_dir)
    top = [r.term for r in vocabulary.frequent_words(docs, 30).select("term").collect()]  # 30 words
    samples = calibrate.windows(docs, size, per_author, 3)
    unit = spark.createDataFrame([(w, 0.0, 0.01) for w in top], "dim string, mean double, scale double")
    stats = distance.dim_stats(calibrate.profiles(samples, top, unit).select("dim", (F.col("z") * 0.01).alias("value")), W.NOISE_FLOORS["frequency"])
    return calibrate.pair_distances(calibrate.profiles(samples, top, stats))


@query()
def calibrated_distances(spark, sf):
    """A ladder of distances at one length, assessed against distributions of sampled pairs at two others."""
    bins = None
    for size in (50, 200):
        sides = calibrate.subsample(_sampled(spark, sf, size), 200)
        one = sides.groupBy(F.lit(size).alias("tokens")).agg(F.first(F.when(F.col("same"), F.col("sample")), ignorenulls=True).alias("same"), F.first(F.when(~F.col("same"), F.col("sample")), ignorenulls=True).alias("different"))
        bins = one if bins is None else bins.unionByName(one)
    asked = spark.createDataFrame([(k, k + 1, 0.1 * k, 40 * k + 10, 120) for k in range(1, 16)], "a long, b long, distance double, tokens_a int, tokens_b int")
    return rounded(calibrate.assess(asked, bins))


@query(f"""WITH {TOK}, top AS (SELECT w FROM tok GROUP BY w ORDER BY count(*) DESC, w LIMIT 30), per AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY doc_id, w),
r AS (SELECT z.doc_id, top.w, coalesce(c, 0)::DOUBLE / z.n AS value FROM sized z CROSS JOIN top LEFT JOIN per ON per.doc_id = z.doc_id AND per.w = top.w),
s AS (SELECT w, avg(value) AS mean, greatest(coalesce(stddev_samp(value), 0), {W.NOISE_FLOORS["frequency"]}) AS scale FROM r GROUP BY w),
cut AS (SELECT doc_id, start, ws[start + 1:start + 200] AS ws FROM (SELECT doc_id, ws, unnest(range(0, n - 199, 100)) AS start FROM sized WHERE n >= 200))
SELECT doc_id, start::BIGINT AS start, round(avg(abs((len(list_filter(ws, lambda x: x = s.w)) / 200.0 - mean) / scale)), 6) AS distance FROM cut CROSS JOIN s GROUP BY doc_id, start""")
def rolling_distances(spark, sf):
    docs = documents(spark, sf)
    top = [r.term for r in vocabulary.frequent_words(docs, 30).select("term").collect()]  # 30 words
    values = vocabulary.word_rates(docs, spark.createDataFrame([(w,) for w in top], "term string")).withColumnRenamed("term", "dim")
    target = distance.dim_stats(values, W.NOISE_FLOORS["frequency"]).select("dim", "mean", "scale", F.lit(0.0).alias("z"))
    return rounded(critique.rolling(docs, top, target, 200, 100))


@query()
def best_thresholds(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("same"))
    rates = features.mark_rates(documents(spark, sf)).where("dim = 'punct:hash_rate'")
    return verify.optimize_thresholds(rates.join(labels, "doc_id").select((1 / (1 + F.col("value") / 10)).alias("score"), "same"))


_SEARCH = "SELECT a.vec_id AS a, b.vec_id AS b, round(sum(abs(a.x - b.x)), 4) AS l1, round(sum(a.x * b.x), 4) + 0.0 AS dot FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 50 = 0) a JOIN (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) b USING (i) GROUP BY a.vec_id, b.vec_id"


@query(_SEARCH)
def vector_distances(spark, sf):
    """Each vector whose vec_id is divisible by 50 against all, in blocks of queries."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = distance.dense_pairs(vectors.where("id % 50 = 0"), vectors)
    return found.select("a", "b", F.round("l1", 4).alias("l1"), (F.round("dot", 4) + F.lit(0.0)).alias("dot"))



@query(_SEARCH)
def vector_distances_every_50th(spark, sf):
    return vector_distances(spark, sf)
