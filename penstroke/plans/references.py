"""Queries of fitted references, typed n-gram rates, sides of a contrast and agreement, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.functions.text import lengths
from penstroke.operators import agreement, contrast, critique, distance, reference, surprisal, vocabulary
from penstroke.plans.lexical import ORACLES, _GRAM, _ODDS, _SURP, _Z, TOK, _author_vectors, _count, _long, _q, _sides, documents, query, rounded

SIZES = {"word": 50, "punct": 32, "gram": 40}

_TYPED = _GRAM[: _GRAM.index("\nSELECT gram")].replace("SELECT ch || n1 || n2 AS gram, l,", "SELECT doc_id, ch || n1 || n2 AS gram, l,").replace("(SELECT ch, lead(ch, 1)", "(SELECT doc_id, ch, lead(ch, 1)").replace("k AS (SELECT gram,", "k AS (SELECT doc_id, gram,")
_GRAM_RATES = """top AS (SELECT type || ':' || gram AS term, row_number() OVER (ORDER BY count(*) DESC, type, gram) - 1 AS idx FROM k GROUP BY gram, type ORDER BY count(*) DESC, type, gram LIMIT {}),
per_doc AS (SELECT doc_id, type || ':' || gram AS term, count(*) AS c FROM k GROUP BY doc_id, gram, type), total AS (SELECT doc_id, sum(c) AS size FROM per_doc GROUP BY doc_id),
gram_rate AS (SELECT total.doc_id, top.term, top.idx, coalesce(c, 0)::DOUBLE / size AS value FROM total CROSS JOIN top LEFT JOIN per_doc ON per_doc.doc_id = total.doc_id AND per_doc.term = top.term)"""


@query(f"{_TYPED}, {_GRAM_RATES.format(100)} SELECT doc_id, term, round(value, 6) AS value FROM gram_rate")
def char_gram_rates(spark, sf):
    docs = documents(spark, sf)
    return rounded(vocabulary.gram_rates(docs, vocabulary.frequent_grams(docs, 3, 100), 3))


_PUNCT = _long({f"punct:{m}_rate": f"1000.0 * {_count(c)} / n" for m, c in W.MARKS.items()}, "sized").replace("round((", "((").replace("::DOUBLE, 6) + 0.0", "::DOUBLE)")
_MEASURED = f"""{_TYPED.replace('WITH t AS', f'WITH {TOK}, t AS', 1)}, {_GRAM_RATES.format(SIZES['gram'])},
vw AS (SELECT w AS term, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS idx FROM tok GROUP BY w ORDER BY count(*) DESC, w LIMIT {SIZES['word']}), hw AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY doc_id, w),
marks AS ({_PUNCT}), mark_order(dim, idx) AS (VALUES {', '.join(f"({_q(f'punct:{m}_rate')}, {i})" for i, m in enumerate(W.MARKS))}),
measured AS (
  SELECT z.doc_id, 'word:' || vw.term AS dim, vw.idx, 'word' AS family, 0.002 AS floor, coalesce(hw.c, 0)::DOUBLE / z.n AS value FROM sized z CROSS JOIN vw LEFT JOIN hw ON hw.doc_id = z.doc_id AND hw.w = vw.term
  UNION ALL SELECT doc_id, dim, {SIZES['word']} + idx, 'punct', 0.5, value FROM marks JOIN mark_order USING (dim)
  UNION ALL SELECT doc_id, 'gram:' || term, {SIZES['word'] + len(W.MARKS)} + idx, 'gram', 0.002, value FROM gram_rate),
stats AS (SELECT dim, any_value(idx) AS idx, any_value(family) AS family, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, greatest(coalesce(stddev_samp(value), 0), any_value(floor)) AS scale, quantile_cont(value, 0.5) AS p50 FROM measured GROUP BY dim),
profiled AS (SELECT d.doc_id, s.dim, s.family, coalesce(m.value, s.mean) AS value, coalesce((coalesce(m.value, s.mean) - s.mean) / s.scale, 0) AS z, m.value IS NULL AS missing
  FROM documents d CROSS JOIN stats s LEFT JOIN measured m ON m.doc_id = d.doc_id AND m.dim = s.dim)"""


def _fitted(spark, sf):
    return reference.fit(documents(spark, sf).select("doc_id", "text"), "documents", SIZES)


@query(f"{_MEASURED} SELECT dim, idx::BIGINT AS idx, family, n::BIGINT AS n, round(mean, 6) AS mean, round(scale, 6) AS scale, round(p50, 6) AS p50 FROM stats")
def fit_reference(spark, sf):
    return rounded(_fitted(spark, sf).table(spark).select("dim", "idx", "family", "n", "mean", "scale", "p50"))


@query(f"{_MEASURED} SELECT doc_id, dim, round(value, 6) AS value, round(z, 6) + 0.0 AS z, missing FROM profiled")
def profile_documents(spark, sf):
    return rounded(reference.profile(documents(spark, sf), _fitted(spark, sf)).select("doc_id", "dim", "value", "z", "missing"))


@query(f"{_MEASURED} SELECT doc_id, family, round(avg(abs(z)), 6) AS gap FROM profiled GROUP BY doc_id, family")
def family_gaps(spark, sf):
    fitted = _fitted(spark, sf)
    return rounded(reference.family_gaps(reference.profile(documents(spark, sf), fitted), fitted))


_NEAREST = """, q AS (SELECT a.doc_id AS a, b.doc_id AS b, avg(abs(a.z - b.z)) AS distance FROM profiled a JOIN profiled b ON a.dim = b.dim WHERE a.doc_id % 50 = 0 AND b.doc_id != a.doc_id GROUP BY ALL)
SELECT a, b, round(distance, 6) AS distance FROM q"""


@query(_MEASURED + _NEAREST)
def compare_documents(spark, sf):
    fitted = _fitted(spark, sf)
    docs = documents(spark, sf)
    found = reference.compare(fitted, reference.profile(docs.where("doc_id % 50 = 0"), fitted), reference.profile(docs, fitted)).where("a != b")
    return rounded(found.select("a", "b", "distance"))


@query(_ODDS.replace("{terms}", "t AS (SELECT doc_id, w AS term FROM tok)") + """, z AS (SELECT term, delta / sqrt(variance) AS z FROM m)
SELECT 'a' AS side, term, row_number() OVER (ORDER BY round(z, 6) DESC, term)::BIGINT AS rank FROM z QUALIFY rank <= 25 UNION ALL SELECT 'b', term, row_number() OVER (ORDER BY round(z, 6), term)::BIGINT AS rank FROM z QUALIFY rank <= 25""")
def contrast_terms_by_side(spark, sf):
    odds = contrast.log_odds(*_sides(spark, sf)).withColumn("z", F.round("z", 6))
    side = lambda a: contrast.terms_of_side(odds, 25, a).select(F.lit("a" if a else "b").alias("side"), "term", "rank")
    return side(True).unionByName(side(False))


@query("""WITH l AS (SELECT quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, avg((quality = toxic)::INT) AS observed FROM l),
e AS (SELECT sum(a.c * b.c)::DOUBLE AS s FROM (SELECT quality AS x, count(*) AS c FROM l GROUP BY 1) a JOIN (SELECT toxic AS x, count(*) AS c FROM l GROUP BY 1) b USING (x))
SELECT n::BIGINT AS n, round(observed, 6) AS observed, round((observed - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, e""")
def label_agreement(spark, sf):
    return rounded(agreement.kappa(spark.read.parquet(f"{sf}/labels.parquet"), "quality", "toxic"))


@query("""WITH s AS (SELECT length(text)::DOUBLE AS score, quality = 1 AS positive FROM documents JOIN labels USING (doc_id)), t AS (SELECT quantile_cont(score, 0.9) AS threshold FROM s WHERE NOT positive)
SELECT round(threshold, 6) AS threshold, round(avg((score >= threshold)::INT), 6) AS tpr FROM s, t WHERE positive GROUP BY threshold""")
def detection_at_fixed_alarms(spark, sf):
    scored = documents(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return rounded(agreement.detection(scored.select(F.length("text").cast("double").alias("score"), (F.col("quality") == 1).alias("positive")), 0.1))


@query("""WITH j AS (SELECT CASE WHEN a.n > b.n THEN 'win' WHEN a.n < b.n THEN 'loss' ELSE 'tie' END AS result FROM (SELECT conv_id, avg(length(text)) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1) a JOIN (SELECT conv_id, avg(length(text)) AS n FROM conversations WHERE role = 'user' GROUP BY 1) b USING (conv_id))
SELECT count(*)::BIGINT AS pairs, count_if(result != 'tie')::BIGINT AS decided, count_if(result = 'win')::BIGINT AS wins, round(count_if(result = 'win')::DOUBLE / nullif(count_if(result != 'tie'), 0), 6) AS win_rate FROM j""")
def longer_side_wins(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    side = lambda role, name: turns.where(F.col("role") == role).groupBy("conv_id").agg(F.avg(F.length("text")).alias(name))
    judged = side("assistant", "a").join(side("user", "b"), "conv_id").select(F.when(F.col("a") > F.col("b"), "win").when(F.col("a") < F.col("b"), "loss").otherwise("tie").alias("result"))
    return rounded(agreement.win_rate(judged))


@query(f"WITH {TOK}, u AS (SELECT * FROM (SELECT doc_id, i, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS context, w AS unit FROM tok) WHERE context IS NOT NULL)" + _SURP[: _SURP.index(",\nf AS")].replace("SELECT doc_id, i, -log2", "SELECT doc_id, i, unit, -log2")
       + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(bits, 9) DESC, i)::BIGINT AS rank, i::BIGINT AS i, unit, round(bits, 6) AS bits FROM b QUALIFY rank <= 3")
def surprising_words(spark, sf):
    return rounded(surprisal.word_peaks(documents(spark, sf), 3))


@query(f"""{_Z}, st AS (SELECT term, avg(value) AS mean, stddev_samp(value) AS sd, greatest(stddev_samp(value), 0.002) AS scale FROM r GROUP BY term),
q AS (SELECT d.term, abs(d.z - y.z) - abs(d.z - x.z) AS pull, d.u AS observed, y.u AS aim FROM z d JOIN z x ON x.term = d.term AND x.author = 'src1' JOIN z y ON y.term = d.term AND y.author = 'src2' WHERE d.author = 'src0'),
b AS (SELECT term, observed, (observed - mean) / scale AS z, aim - greatest(sd * 0.5, 0.0005) AS low, aim + greatest(sd * 0.5, 0.0005) AS high FROM q JOIN st USING (term) WHERE pull > 0),
e AS (SELECT *, CASE WHEN observed > high THEN 'reduce' WHEN observed < low THEN 'increase' END AS direction, CASE WHEN observed > high THEN high ELSE low END AS edge FROM b),
g AS (SELECT *, abs(observed - edge) / (abs(edge) + 0.002) AS deviation FROM e WHERE direction IS NOT NULL)
SELECT replace(term, ':', '.') AS id, direction, round(observed, 6) AS observed, round(low, 6) AS low, round(high, 6) AS high, round(deviation, 6) AS deviation,
  CASE greatest(CASE WHEN abs(z) >= 3 THEN 2 WHEN abs(z) >= 2 THEN 1 ELSE 0 END, CASE WHEN deviation >= 1 THEN 2 WHEN deviation >= 0.35 THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM g WHERE deviation >= 0.05""")
def contrast_findings(spark, sf):
    z, u, _ = _author_vectors(spark, sf)
    stats = distance.dim_stats(u, W.NOISE_FLOORS["frequency"])
    side = lambda name: distance.pairs(z.where("id = 'src0'"), z.where(F.col("id") == name), "z")
    pulls = distance.classify(side("src1"), side("src2"), "burrows").withColumnRenamed("a", "doc_id")
    drafts = u.where("id = 'src0'").withColumnRenamed("id", "doc_id")
    found = critique.contrast_findings(drafts, u.where("id = 'src2'"), pulls, stats, W.NOISE_FLOORS["frequency"], 1000)
    return rounded(found.select("id", "direction", "observed", "low", "high", "deviation", "severity"))


@query(f"WITH {TOK}, u AS (SELECT * FROM (SELECT doc_id, i, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS context, w AS unit FROM tok) WHERE context IS NOT NULL)" + _SURP[: _SURP.index(",\nf AS")] + " SELECT round(quantile_cont(bits, 0.25), 6) AS low FROM b")
def surprisal_threshold(spark, sf):
    return rounded(surprisal.word_threshold(documents(spark, sf)))


@query(f"WITH {TOK} SELECT doc_id, len(ws)::BIGINT AS tokens FROM docs")
def document_lengths(spark, sf):
    return lengths(documents(spark, sf))


@query(f"{_Z}, n(term, family) AS (SELECT term, CASE WHEN length(term) <= 2 THEN 'short' ELSE 'long' END FROM v) SELECT b AS author, family, round(sum(abs(x - y) / 50), 6) AS contribution FROM p JOIN n USING (term) GROUP BY b, family")
def family_contributions(spark, sf):
    z, _, _ = _author_vectors(spark, sf)
    named = z.withColumn("dim", F.concat(F.when(F.length("dim") <= 2, "short:").otherwise("long:"), "dim"))
    terms = distance.contributions(distance.pairs(named.where("id = 'src0'"), named.where("id != 'src0'"), "z"), "burrows")
    return rounded(distance.by_family(terms, "contribution").select(F.col("b").alias("author"), "family", "contribution"))


@query(_MEASURED + """, aims AS (SELECT source AS target, dim, avg(z) AS z FROM profiled JOIN documents USING (doc_id) GROUP BY ALL),
scored AS (SELECT p.doc_id, t.target, avg(abs(p.z - t.z)) AS distance, avg(abs(p.z - t.z)) FILTER (p.family = 'gram') AS gap FROM profiled p JOIN aims t USING (dim) WHERE p.doc_id % 50 = 0 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, target) AS rank, count(*) OVER (PARTITION BY doc_id) AS n FROM scored)
SELECT doc_id, target, round(distance, 6) AS distance, round(gap, 6) AS canary_gap FROM o WHERE rank = n // 2 + 1""")
def reviews(spark, sf):
    """Documents whose doc_id is divisible by 50 against the mean profile of each author."""
    docs, fitted = documents(spark, sf), _fitted(spark, sf)
    profiles = reference.profile(docs.select(F.struct("doc_id", "author").alias("doc_id"), "text"), fitted)
    means = profiles.groupBy("fingerprint", F.col("doc_id.author").alias("doc_id"), "dim").agg(F.avg("z").alias("z")).persist()  # read twice; a row for each author and dimension
    return rounded(reference.review(fitted, reference.profile(docs.where("doc_id % 50 = 0"), fitted), means))


#: Families of measures, and the queries whose SQL gives their values.
_MANY = {
    "style": "style_ratios", "kinds": "token_kinds", "letters": "letter_frequencies", "word_lengths": "word_lengths", "sentence_lengths": "sentence_dispersion", "openers": "sentence_openers", "richness": "richness",
    "readability": "readability",
}
_EVERY = " UNION ALL ".join(f"SELECT {_q(family)} AS family, dim, value FROM ({ORACLES[name].replace(', 6)', ', 12)')})" for family, name in _MANY.items())  # their values before rounding


@query(f"""SELECT family, dim, count(*)::BIGINT AS n, round(avg(value), 5) + 0.0 AS mean, round(coalesce(stddev_samp(value), 0), 5) + 0.0 AS sd, round(quantile_cont(value, 0.5), 5) + 0.0 AS p50 FROM ({_EVERY}) WHERE value IS NOT NULL GROUP BY family, dim""")
def fit_families(spark, sf):
    """A reference over eight more families: their dimensions and statistics."""
    docs = documents(spark, sf).select("doc_id", "text")
    fitted = reference.fit(docs, "families", dict.fromkeys(_MANY, 1000))
    return fitted.table(spark).select("family", "dim", "n", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("mean", "sd", "p50")))
