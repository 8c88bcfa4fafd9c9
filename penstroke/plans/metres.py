"""Queries of metre, and their SQL. The table of pronunciations is made of the benchmark's words by a rule: its place is that of a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.functions.text import token_array
from penstroke.operators import metre
from penstroke.plans.lexical import TOK, _q, documents, query, rounded


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark that end in a vowel or n: stressed on their last syllable, which is also their rhyme's key."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(token_array(F.col("text"))).alias("w")).distinct().where(F.regexp("w", F.lit("^[a-z]*[aeioun]$")))
    groups = F.regexp_count("w", F.lit("[aeiouy]+"))
    n = F.greatest(F.lit(1), groups)
    return words.select("w", n.alias("syllables"), F.lpad(F.lit("1"), n, F.lit("0")).alias("stress"), F.regexp_extract("w", "([aeiouy]+[^aeiouy]*)$", 1).alias("rhyme"))


_IN = lambda items: "(" + ", ".join(map(_q, items)) + ")"
_LINES = rf"""{TOK}, pron AS (SELECT DISTINCT w, greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))) AS n, regexp_extract(w, '([aeiouy]+[^aeiouy]*)$', 1) AS rhyme FROM (SELECT unnest(regexp_extract_all(lower(text), {_q(W.TOKEN)})) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]*[aeioun]')),
cut AS (SELECT doc_id, line, regexp_extract_all(lower(line), {_q(W.TOKEN)}) AS ws, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM docs)),
worded AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l) AS i, count(*) OVER (PARTITION BY doc_id) AS k, count(*) FILTER (len(ws) <= 14) OVER (PARTITION BY doc_id) AS short FROM cut WHERE len(ws) > 0),
verse AS (SELECT * FROM worded WHERE k >= 6 AND short >= 0.5 * k)"""
_LETTERS = r"regexp_replace(w, '[^\p{L}]', '', 'g')"
_SYLLABLES = f"CASE WHEN {_LETTERS} = '' THEN 1 ELSE greatest(1, len(regexp_extract_all({_LETTERS}, '[aeiouy]+')) - CASE WHEN regexp_matches({_LETTERS}, '[^aeiouy]e$') AND NOT regexp_matches({_LETTERS}, '[^aeiouy]le$') AND len(regexp_extract_all({_LETTERS}, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"
_RATES = {"feminine_ending_rate": "length(f) > 1 AND right(f, 1) = '0'", "midline_pause_rate": "regexp_matches(t, '[,;:.?!].')", "run_on_rate": f"NOT regexp_matches(t, '[.,;:?!—]$') AND ws[-1] IN {_IN(metre.FUNCTION_FINAL)}", "stopped_rate": "regexp_matches(t, '[.,;:?!—]$')"}
_PLACES = range(1, metre.POSITIONS + 1)
_HITS = " + ".join(f"CASE WHEN f[{i}] != '' AND (f[{i}] != '0') = {str(i % 2 == 0).lower()} THEN 1 ELSE 0 END" for i in _PLACES)
_DIMS = " UNION ALL ".join([
    *(f"SELECT doc_id, 'verse:{d}' AS dim, round(100.0 * count(*) FILTER ({c}) / any_value(k), 6) AS value FROM r GROUP BY doc_id" for d, c in _RATES.items()),
    *(f"SELECT doc_id, 'verse:stress:{i}', round(count(*) FILTER (f[{i}] != '' AND f[{i}] != '0')::DOUBLE / nullif(count(*) FILTER (f[{i}] != ''), 0), 6) FROM r GROUP BY doc_id" for i in _PLACES),
    f"SELECT doc_id, 'verse:iambic_share', round(sum({_HITS})::DOUBLE / sum(least(length(f), {metre.POSITIONS})), 6) FROM r GROUP BY doc_id",
])


@query(rf"""WITH {_LINES}, each AS (SELECT doc_id, i, generate_subscripts(ws, 1) AS j, unnest(ws) AS w FROM verse),
scanned AS (SELECT e.doc_id, e.i, e.j, e.w, p.n AS listed, coalesce(p.n, {_SYLLABLES.replace('(w,', '(e.w,')}) AS n FROM each e LEFT JOIN pron p ON p.w = e.w),
figures AS (SELECT doc_id, i, string_agg(CASE WHEN listed IS NOT NULL THEN lpad('1', n::INT, '0') WHEN n <= 1 THEN CASE WHEN w IN {_IN(metre.FUNCTION_FINAL)} THEN '0' ELSE '1' END ELSE rpad('1', n::INT, '0') END, '' ORDER BY j) AS f FROM scanned GROUP BY doc_id, i),
r AS (SELECT v.*, f, regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS t FROM verse v JOIN figures USING (doc_id, i)) {_DIMS}""")
def metre_rates(spark, sf):
    return rounded(metre.metre(documents(spark, sf), _table(spark, sf)))


@query(rf"""WITH {_LINES}, last AS (SELECT doc_id, i, k, ws[-1] AS w, p.rhyme FROM verse LEFT JOIN pron p ON p.w = ws[-1])
SELECT a.doc_id, 'verse:rhyme_rate' AS dim, round(100.0 * count(*) FILTER (EXISTS (SELECT 1 FROM last b WHERE b.doc_id = a.doc_id AND b.i BETWEEN a.i - 2 AND a.i - 1 AND b.rhyme = a.rhyme AND b.w != a.w)) / any_value(k), 6) AS value FROM last a GROUP BY a.doc_id""")
def rhyme_rates(spark, sf):
    return rounded(metre.rhymes(documents(spark, sf), _table(spark, sf)))


@query(rf"""WITH {_LINES}, d AS (SELECT doc_id, ws, len(ws) AS n FROM docs WHERE doc_id IN (SELECT doc_id FROM verse)),
c AS (SELECT doc_id, n, len(list_filter(ws, lambda w: w IN {_IN(metre.THOU)})) AS thou, len(list_filter(ws, lambda w: w IN {_IN(metre.YOU)})) AS you, len(list_filter(ws, lambda w: w IN {_IN(metre.ETH)} OR (strlen(w) > 4 AND ends_with(w, 'eth')))) AS eth,
  len(list_filter(ws, lambda w: w IN {_IN(metre.EST)} OR (strlen(w) > 4 AND ends_with(w, 'est') AND NOT ends_with(w, 'iest')))) AS est FROM d)
SELECT doc_id, 'verse:thou_you' AS dim, round(CASE WHEN you = 0 THEN thou::DOUBLE ELSE thou::DOUBLE / you END, 6) AS value FROM c UNION ALL SELECT doc_id, 'verse:eth_rate', round(1000.0 * eth / n, 6) FROM c UNION ALL SELECT doc_id, 'verse:est_rate', round(1000.0 * est / n, 6) FROM c""")
def archaisms(spark, sf):
    return rounded(metre.archaism(documents(spark, sf)))
