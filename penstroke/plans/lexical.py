"""Queries of the lexical tier and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.operators import contrast, corpus, distance, features, surprisal, vocabulary

QUERIES, ORACLES = {}, {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("author", F.col("source"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c).cast("long") if kind == "int" else F.col(c) for c, kind in df.dtypes))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


TOK = rf"""docs AS (SELECT doc_id, source AS author, lang, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), {_q(W.TOKEN)}) AS ws FROM documents),
tok AS (SELECT doc_id, author, lang, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM docs),
sized AS (SELECT doc_id, author, text, ws, len(ws) AS n FROM docs WHERE len(ws) > 0)"""
SENT = rf"""parts AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), {_q(W.SENTENCE)}), lambda s: regexp_matches(s, '[\p{{L}}\p{{Nd}}_]')) AS ss FROM documents),
sent AS (SELECT doc_id, s, sentence, regexp_extract_all(lower(sentence), {_q(W.TOKEN)}) AS ws, len(regexp_extract_all(lower(sentence), {_q(W.TOKEN)})) AS len
  FROM (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS s, unnest(ss) AS sentence FROM parts))"""


def _long(dims: dict[str, str], source: str, key: str = "doc_id", where: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT {key}, {_q(d)} AS dim, round(({e})::DOUBLE, 6) + 0.0 AS value FROM {source}" for d, e in dims.items())
    return f"SELECT * FROM ({parts}) {where}"


def _count(chars: str) -> str:
    return f"(length(text) - length(translate(text, {_q(chars)}, '')))"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(text, {_q(pattern)}))"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"


def _among(items) -> str:
    return f"len(list_filter(ws, lambda w: w IN ({', '.join(map(_q, items))})))"


@query("SELECT source AS author, count(*)::BIGINT AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source")
def corpus_authors(spark, sf):
    return corpus.authors(documents(spark, sf))


@query("SELECT source AS author, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def corpus_aggregate(spark, sf):
    return corpus.aggregate(documents(spark, sf)).select("author", F.md5("text").alias("digest"))


@query("""WITH n AS (SELECT doc_id, source AS author, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, author, CASE WHEN rn <= n // 2 THEN 0 ELSE 1 END::BIGINT AS half FROM n WHERE n >= 2""")
def corpus_split_halves(spark, sf):
    return rounded(corpus.split_halves(documents(spark, sf).select("doc_id", "author")))


@query("""WITH n AS (SELECT doc_id, source AS author, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, author, n >= 15 AND rn <= 5 AS held_out FROM n""")
def corpus_held_out(spark, sf):
    return corpus.held_out(documents(spark, sf).select("doc_id", "author"), 5, 7)


@query(r"""SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(trim(text), '[\x20\x09-\x0D]+', ' ', 'g')""")
def corpus_exact_dedupe(spark, sf):
    return corpus.exact_dedupe(documents(spark, sf).select("doc_id", "text")).select("doc_id")


_WORDS = f"WITH {TOK}, c AS (SELECT w AS term, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY w)"


@query(f"{_WORDS} SELECT term, n::BIGINT AS n, df::BIGINT AS df, row_number() OVER (ORDER BY n DESC, term)::BIGINT AS rank FROM c WHERE df >= ceil(0.05 * (SELECT count(*) FROM documents)) ORDER BY n DESC, term LIMIT 500")
def frequent_words(spark, sf):
    return rounded(vocabulary.frequent_words(documents(spark, sf), 500, 0.05))


@query(f"""{_WORDS}, v AS (SELECT term FROM c ORDER BY n DESC, term LIMIT 50), h AS (SELECT doc_id, w, count(*) AS k FROM tok GROUP BY doc_id, w)
SELECT z.doc_id, v.term, round(coalesce(h.k, 0)::DOUBLE / z.n, 6) AS value FROM sized z CROSS JOIN v LEFT JOIN h ON h.doc_id = z.doc_id AND h.w = v.term""")
def word_rates(spark, sf):
    docs = documents(spark, sf)
    return rounded(vocabulary.word_rates(docs, vocabulary.frequent_words(docs, 50)))


_GRAM = r"""WITH t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
e AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS ch FROM (SELECT doc_id, string_split(t, '') AS c FROM t WHERE length(t) >= 3)),
g AS (SELECT ch || n1 || n2 AS gram, l, coalesce(n3, ' ') AS r FROM (SELECT ch, lead(ch, 1) OVER o AS n1, lead(ch, 2) OVER o AS n2, lead(ch, 3) OVER o AS n3, coalesce(lag(ch) OVER o, ' ') AS l FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE n2 IS NOT NULL),
k AS (SELECT gram, CASE WHEN regexp_matches(gram, '^[^\p{L}\p{Nd}\x20]') THEN 'beg_punct' WHEN regexp_matches(gram, '[^\p{L}\p{Nd}\x20]$') THEN 'end_punct'
  WHEN regexp_matches(gram, '[^\p{L}\p{Nd}\x20]') THEN 'mid_punct' WHEN gram[1] = ' ' THEN 'space_prefix' WHEN gram[3] = ' ' THEN 'space_suffix' WHEN contains(gram, ' ') THEN 'multi_word'
  WHEN NOT regexp_matches(l, '[\p{L}\p{Nd}]') AND NOT regexp_matches(r, '[\p{L}\p{Nd}]') THEN 'whole_word' WHEN NOT regexp_matches(l, '[\p{L}\p{Nd}]') THEN 'prefix'
  WHEN NOT regexp_matches(r, '[\p{L}\p{Nd}]') THEN 'suffix' ELSE 'mid_word' END AS type FROM g)
SELECT gram, type, count(*)::BIGINT AS c FROM k GROUP BY gram, type ORDER BY c DESC, type, gram LIMIT 1000"""


@query(_GRAM)
def frequent_char_grams(spark, sf):
    return vocabulary.frequent_grams(documents(spark, sf), 3)


@query(f"WITH {TOK} " + _long({f"punct:{m}_rate": f"1000.0 * {_count(c)} / n" for m, c in W.MARKS.items()}, "sized"))
def mark_rates(spark, sf):
    return rounded(features.mark_rates(documents(spark, sf)))


@query(f"WITH {TOK} " + _long({
    "punct:style:em_dash_spaced": _share(_n(r"\x20—\x20"), _n("—")), "punct:style:dash_em_share": _share(_n("—"), _n("[—–-]")), "punct:style:quote_curly_share": _share(_n("[“”]"), _n('["“”]')),
    "punct:style:apostrophe_curly_share": _share(_n(r"\p{L}’\p{L}"), _n(r"\p{L}['’]\p{L}")), "punct:style:ellipsis_char_share": _share(_n("…"), f"{_n('…')} + {_n(r'\.\.\.')}"),
    "punct:style:serial_comma_share": _share(f"{_n(', and ')} + {_n(', or ')}", f"{_n(' and ')} + {_n(' or ')}"), "punct:style:double_space_after_period": _share(_n(r"[.!?]  \p{L}"), _n(r"[.!?] +\p{L}")),
    "punct:style:space_before_punct": _share(_n(" [,;:.!?]"), _n("[,;:.!?]")), "punct:style:sentence_initial_lower": _share(_n(r"[.!?] +\p{Ll}"), _n(r"[.!?] +\p{L}")),
    "punct:style:number_grouped_share": _share(_n(r"\p{Nd},\p{Nd}{3}"), _n(r"\p{Nd},\p{Nd}{3}|\p{Nd}{4}")),
}, "sized"))
def style_ratios(spark, sf):
    return rounded(features.style_ratios(documents(spark, sf)))


_INFORMAL = {
    "repeated_char": f"len(list_filter(ws, lambda w: regexp_matches(w, '{'|'.join(c + c + c for c in 'abcdefghijklmnopqrstuvwxyz')}')))", "missing_apostrophe": _among(W.MISSING_APOSTROPHE),
    "common_misspelling": _among(W.MISSPELLINGS), "elongated_punct": _n(r"!{2,}|\?{2,}"), "lowercase_i": _n(r"(^| )i( |$)"),
}


@query(f"WITH {TOK} " + _long({f"punct:informal:{k}": f"1000.0 * {v} / n" for k, v in _INFORMAL.items()} | {"punct:informal:total": f"1000.0 * ({' + '.join(_INFORMAL.values())}) / n"}, "sized"))
def informality(spark, sf):
    return rounded(features.informality(documents(spark, sf)))


@query(f"WITH {TOK} " + _long({
    "punct:allcaps_rate": f"1000.0 * len(list_filter(regexp_extract_all(text, {_q(W.TOKEN)}), lambda w: regexp_matches(w, '^\\p{{Lu}}[\\p{{Lu}}\\p{{Nd}}]*\\p{{Lu}}[\\p{{Lu}}\\p{{Nd}}]*$'))) / n",
    "punct:contraction_rate": "1000.0 * len(list_filter(ws, lambda w: regexp_matches(w, '[''’](s|t|re|ve|ll|d|m)$'))) / n",
    "punct:number_rate": r"1000.0 * len(list_filter(ws, lambda w: regexp_matches(w, '\p{Nd}') AND NOT regexp_matches(w, '\p{L}'))) / n",
}, "sized"))
def token_kinds(spark, sf):
    return rounded(features.kinds(documents(spark, sf)))


_ABC = "abcdefghijklmnopqrstuvwxyz"


@query("WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS text FROM documents) " + _long(
    {f"punct:letter:{c}": _share(_count(c), _count(_ABC)) for c in _ABC} | {f"punct:digit:{c}": _share(_count(c), _count("0123456789")) for c in "0123456789"}, "low"
))
def letter_frequencies(spark, sf):
    return rounded(features.letters(documents(spark, sf)))


_WL = {f"punct:word_len:{k}": f"avg((size = {k})::INT)" for k in range(1, 13)} | {"punct:word_len:13+": "avg((size >= 13)::INT)", "punct:word_len_mean": "avg(size)", "punct:word_len_stddev": "coalesce(stddev_samp(size), 0)"}


@query(rf"WITH {TOK}, each AS (SELECT doc_id, length(regexp_replace(w, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS size FROM tok WHERE regexp_matches(w, '\p{{L}}')) " + _long(_WL, "each", "doc_id", "").replace(" FROM each", " FROM each GROUP BY doc_id"))
def word_lengths(spark, sf):
    return rounded(features.word_lengths(documents(spark, sf)))


_LENS = f"WITH {SENT}, lens AS (SELECT * FROM sent WHERE len > 0)"
_DISP = {
    "sent:len_mean": "m", "sent:len_stddev": "sqrt(v)", "sent:len_variance": "v", "sent:len_fano": "v / m", "sent:len_cv": "sqrt(v) / m", "sent:len_p10": "p10", "sent:len_p50": "p50", "sent:len_p90": "p90"
}


@query(f"{_LENS}, g AS (SELECT doc_id, count(*) AS n, avg(len) AS m, var_samp(len) AS v, quantile_cont(len, 0.1) AS p10, quantile_cont(len, 0.5) AS p50, quantile_cont(len, 0.9) AS p90 FROM lens GROUP BY doc_id) " + _long({k: f"CASE WHEN n >= 4 THEN {v} END" for k, v in _DISP.items()}, "g"))
def sentence_dispersion(spark, sf):
    return rounded(features.sentence_dispersion(documents(spark, sf)))


@query(f"""WITH {TOK}, {SENT}, c AS (SELECT z.doc_id, z.text, z.n, len(p.ss) AS s, len(list_filter(regexp_split_to_array(z.text, '\\n[\\x20\\x09]*\\n'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nd}}_]'))) AS p
FROM sized z JOIN parts p USING (doc_id)) """ + _long({
    "sent:count_rate": "1000.0 * s / n", "sent:clause_per_sentence": _share(_count(",;:—–"), "s"), "sent:comma_per_sentence": _share(_count(","), "s"), "para:sentences_mean": _share("s", "p"),
    "para:tokens_mean": _share("n", "p"), "para:count_rate": "1000.0 * p / n",
}, "c"))
def sentence_counts(spark, sf):
    return rounded(features.sentence_counts(documents(spark, sf)))


@query(f"""WITH {SENT}, o(dim, opener) AS (VALUES {_values((f"sent:opener:{o}", o.replace("_", " ")) for o in W.OPENERS)}),
h AS (SELECT doc_id, opener, dim, count(*) AS c FROM sent JOIN o ON array_to_string(ws[1:len(string_split(opener, ' '))], ' ') = opener GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id) SELECT doc_id, dim, round(100.0 * c / n, 6) AS value FROM h JOIN t USING (doc_id)""")
def sentence_openers(spark, sf):
    return rounded(features.openers(documents(spark, sf)))


#: The tables hold none of these words and traces: some of their words are replaced by them here.
_PLANTED = "SELECT doc_id, source, lang, replace(replace(replace(replace(coalesce(text, ''), ' of ', ' however '), ' der ', ' indeed '), ' de ', ' Moreover '), ' the ', ' the' || chr(8203) || ' ') || CASE WHEN doc_id % 3 = 0 THEN ' oaicite turn0search1' ELSE '' END AS text FROM documents"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with discourse markers, invisible characters and traces of chat windows in them."""
    text = F.coalesce("text", F.lit(""))
    for a, b in ((" of ", " however "), (" der ", " indeed "), (" de ", " Moreover "), (" the ", " the\u200b ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    trace = F.when(F.col("doc_id") % 3 == 0, " oaicite turn0search1").otherwise("")
    return documents(spark, sf_dir).withColumn("text", F.concat(text, trace))


@query(f"WITH {TOK.replace('FROM documents)', f'FROM ({_PLANTED}))', 1)}, m(w) AS (VALUES {_values((m,) for m in W.MARKERS)}) SELECT doc_id, 'sent:marker:' || w AS dim, round(1000.0 * count(*) / any_value(z.n), 6) AS value FROM tok JOIN m USING (w) JOIN sized z USING (doc_id) GROUP BY doc_id, w")
def discourse_markers(spark, sf):
    return rounded(features.markers(planted(spark, sf)))


_KIND = {"heading": r"^#{1,6}\x20", "rule": r"^(-{3,}|\*{3,}|_{3,})$", "bullet": r"^[-*+]\x20", "numbered": r"^[0-9]{1,3}[.)]\x20", "quote": "^>", "table": r"^\|.+\|$"}


@query(rf"""WITH {TOK}, l AS (SELECT doc_id, regexp_replace(line, '^[\x20\x09]+|[\x20\x09\x0D]+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
k AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(line, {_q(p)}) THEN '{k}'" for k, p in _KIND.items())} END AS kind FROM l WHERE line != ''),
c AS (SELECT doc_id, count(*) AS lines, count(kind) AS structured, {', '.join(f"coalesce(count_if(kind = '{k}'), 0) AS k_{k}" for k in _KIND)} FROM k GROUP BY doc_id),
j AS (SELECT *, {_n(r'\*\*')} // 2 AS bold, {_count('`')} // 2 AS code, {_count('*')} // 2 AS stars FROM sized JOIN c USING (doc_id)) """ + _long(
    {f"md:{k}_rate": f"1000.0 * k_{k} / n" for k in _KIND} | {f"md:{k}_rate": f"1000.0 * {k} / n" for k in ("bold", "code")} | {"md:italic_rate": "1000.0 * greatest(0, stars - 2 * bold) / n", "md:structured_line_share": "structured / lines"}, "j"
))
def markdown_rates(spark, sf):
    return rounded(features.markdown(documents(spark, sf)))


@query(f"""{_LENS}, f AS (SELECT doc_id, len, lag(len) OVER o AS before, avg(len) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS mean FROM lens WINDOW o AS (PARTITION BY doc_id ORDER BY s))
SELECT doc_id, 'sent:punch_short_rate' AS dim, CASE WHEN count(*) >= 3 THEN round(100.0 * count_if(before >= 1.5 * mean AND len <= 0.5 * mean) / count(*), 6) END AS value FROM f GROUP BY doc_id""")
def punch_rate(spark, sf):
    return rounded(features.punch_rate(documents(spark, sf)))


@query(f"""WITH {TOK}, f AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY doc_id, w), g AS (SELECT doc_id, sum(c)::DOUBLE AS n, sum(c * c)::DOUBLE AS s2 FROM f GROUP BY doc_id) """ + _long(
    {"rich:yule_k": "CASE WHEN n >= 50 THEN 10000.0 * (s2 - n) / (n * n) END", "rich:simpson_d": "CASE WHEN n >= 50 THEN (s2 - n) / (n * (n - 1)) END"}, "g"))
def richness(spark, sf):
    return rounded(features.richness(documents(spark, sf)))


@query(f"""WITH {TOK}, w AS (SELECT doc_id, len(list_distinct(ws[i : i + 99])) AS r FROM (SELECT doc_id, ws, unnest(range(1, n - 98)) AS i FROM sized WHERE n >= 100))
SELECT z.doc_id, 'rich:mattr100' AS dim, round(sum(r)::DOUBLE / (count(r) * 100), 6) AS value FROM sized z LEFT JOIN w USING (doc_id) GROUP BY z.doc_id""")
def moving_type_ratio(spark, sf):
    return rounded(features.mattr(documents(spark, sf)))


@query()
def type_diversity_runs(spark, sf):
    return rounded(features.mtld(documents(spark, sf)))


_SYL = r"""CASE WHEN l = '' THEN 1 ELSE greatest(1, len(regexp_extract_all(l, '[aeiouy]+'))
  - CASE WHEN regexp_matches(l, '[^aeiouy]e$') AND NOT regexp_matches(l, '[^aeiouy]le$') AND len(regexp_extract_all(l, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"""
_GRADES = {
    "flesch_kincaid": "0.39 * w / s + 11.8 * y / w - 15.59", "gunning_fog": "0.4 * (w / s + 100.0 * p / w)", "smog": "1.0430 * sqrt(p * 30.0 / s) + 3.1291",
    "coleman_liau": "0.0588 * c * 100.0 / w - 0.296 * s * 100.0 / w - 15.8", "ari": "4.71 * c / w + 0.5 * w / s - 21.43", "syllables_per_word": "y / w",
}


@query(rf"""WITH {TOK}, {SENT}, a AS (SELECT doc_id, length(regexp_replace(w, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS c, regexp_replace(w, '[^\p{{L}}]', '', 'g') AS l FROM tok), b AS (SELECT doc_id, c, {_SYL} AS y FROM a),
d AS (SELECT doc_id, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS y, count_if(y >= 3)::DOUBLE AS p, sum(c)::DOUBLE AS c FROM b GROUP BY doc_id),
j AS (SELECT * FROM d JOIN (SELECT doc_id, count(*)::DOUBLE AS s FROM sent WHERE len > 0 GROUP BY doc_id) USING (doc_id)) """ + _long({f"read:{k}": f"CASE WHEN s >= 4 THEN {v} END" for k, v in _GRADES.items()}, "j"))
def readability(spark, sf):
    return rounded(features.readability(documents(spark, sf)))


_REG = {k: _among(v.split()) for k, v in W.REGISTER.items()} | {
    "analytic_negation_rate": "len(list_filter(ws, lambda w: w = 'not' OR regexp_matches(w, 'n[''’]t$')))",
    "nominalization_rate": f"len(list_filter(ws, lambda w: length(w) >= 6 AND regexp_matches(w, '({'|'.join(W.NOMINAL_SUFFIXES)})$') AND w NOT IN ({', '.join(map(_q, W.NOT_NOMINAL))})))",
}
_RATE = {k: f"1000.0 * {v} / n" for k, v in _REG.items()} | {"mean_word_len": "length(array_to_string(ws, ''))::DOUBLE / n"}


@query(f"WITH {TOK}, r AS (SELECT doc_id, {', '.join(f'{v} AS \"{k}\"' for k, v in _RATE.items())} FROM sized) " + _long(
    {f"biber:{k}": f'"{k}"' for k in _RATE} | {
        "biber:d1_involved": '"pron:p1" + private_verb_rate + discourse_particle_rate + emphatic_rate - nominalization_rate - 10 * mean_word_len',
        "biber:d4_persuasion": 'suasive_verb_rate + "modal:necessity" + "modal:prediction" + 0.5 * "pron:p2"',
    }, "r"))
def register_rates(spark, sf):
    return rounded(features.register(documents(spark, sf)))


@query(rf"""WITH {TOK}, f AS (SELECT doc_id, i, CASE WHEN regexp_matches(w, '^\p{{L}}') THEN w[1] END AS c FROM tok), g AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run FROM f),
h AS (SELECT doc_id, count(*) AS k FROM g WHERE c IS NOT NULL GROUP BY doc_id, c, run HAVING count(*) >= 3)
SELECT z.doc_id, 'dev:alliteration_rate' AS dim, round(1000.0 * count(h.k) / any_value(z.n), 6) AS value FROM sized z LEFT JOIN h USING (doc_id) GROUP BY z.doc_id""")
def alliteration(spark, sf):
    return rounded(features.alliteration(documents(spark, sf)))


@query(rf"""WITH {SENT}, u AS (SELECT doc_id, s, regexp_replace(unnest(ws), '[^\p{{L}}]', '', 'g') AS l FROM sent WHERE len > 0), y AS (SELECT doc_id, s, sum({_SYL})::DOUBLE AS y FROM u GROUP BY doc_id, s),
f AS (SELECT doc_id, y, row_number() OVER o AS x, lag(y) OVER o AS b, avg(y) OVER (PARTITION BY doc_id) AS m FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
g AS (SELECT doc_id, count(*) AS n, avg(y) AS mean, max(y) AS top, regr_slope(y, x) AS slope, sum((y - m) * (b - m)) AS cov, sum((y - m) * (y - m)) AS var FROM f GROUP BY doc_id) """ + _long({
    "syn:syllable_slope": "CASE WHEN n >= 6 THEN slope / mean END", "syn:syllable_autocorr": "CASE WHEN n >= 6 THEN CASE WHEN var > 0 THEN cov / var ELSE 0 END END", "syn:syllable_peak_ratio": "CASE WHEN n >= 6 THEN top / mean END",
}, "g"))
def escalation(spark, sf):
    return rounded(features.escalation(documents(spark, sf)))


@query(f"""WITH {SENT}, e AS (SELECT doc_id, length(sentence) - length(replace(sentence, ',', '')) AS c, len(list_filter(ws, lambda w: w IN ('and', 'or', 'nor'))) AS j FROM sent),
g AS (SELECT doc_id, count(*) AS n, count_if(j >= 3) AS p, count_if(c >= 3 AND j = 0) AS a, avg(CASE WHEN c > 0 THEN c END) AS m FROM e GROUP BY doc_id) """ + _long({
    "syn:polysyndeton_rate": "100.0 * p / n", "syn:asyndeton_rate": "100.0 * a / n", "syn:comma_chain_mean": "m"}, "g"))
def catalogues(spark, sf):
    return rounded(features.catalogues(documents(spark, sf)))


@query(f"WITH t AS ({_PLANTED}) " + _long({
    "artifact.zero_width": _n(r"[\x{AD}\x{61C}\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{FFF9}-\x{FFFB}]"),
    "artifact.chatbot_residue": " + ".join(f"(length(text) - length(replace(text, {_q(r)}, ''))) / {len(r)}" for r in W.RESIDUE),
}, "t", "doc_id", "WHERE value > 0"))
def artifact_counts(spark, sf):
    return rounded(features.artifacts(planted(spark, sf)))


@query(f"WITH {TOK}, f(family, low, ok) AS (VALUES {_values((f, *x) for f, x in W.FLOORS.items())}) SELECT doc_id, family, CASE WHEN len(ws) < low THEN 'none' WHEN len(ws) < ok THEN 'low' ELSE 'ok' END AS confidence FROM docs CROSS JOIN f")
def family_confidence(spark, sf):
    return features.confidence(documents(spark, sf))


_MARK = f"WITH {TOK}, v AS ({_long({f'punct:{m}_rate': f'1000.0 * {_count(c)} / n' for m, c in W.MARKS.items()}, 'sized').replace('round((', '((').replace('::DOUBLE, 6) + 0.0', '::DOUBLE)')})"


@query(f"""{_MARK} SELECT dim, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(greatest(coalesce(stddev_samp(value), 0), 0.5), 6) AS scale, round(min(value), 6) AS min, round(max(value), 6) AS max,
{', '.join(f'round(quantile_cont(value, {q}), 6) AS {n}' for n, q in (('p05', .05), ('p25', .25), ('p50', .5), ('p75', .75), ('p95', .95)))}, coalesce(stddev_samp(value), 0) <= 1e-12 + 1e-9 * abs(avg(value)) AS degenerate FROM v GROUP BY dim""")
def dimension_statistics(spark, sf):
    return rounded(distance.dim_stats(features.mark_rates(documents(spark, sf)), W.NOISE_FLOORS["per_1k"]))


# Sources as authors: z-scores of the most frequent words' rates in each source's text, one source against all others.
_Z = f"""WITH {TOK}, v AS (SELECT w AS term, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS idx FROM tok GROUP BY w ORDER BY count(*) DESC, w LIMIT 50),
a AS (SELECT author, count(*) AS n FROM tok GROUP BY author), h AS (SELECT author, w, count(*) AS k FROM tok GROUP BY author, w),
r AS (SELECT a.author, v.term, v.idx, coalesce(h.k, 0)::DOUBLE / a.n AS value FROM a CROSS JOIN v LEFT JOIN h ON h.author = a.author AND h.w = v.term),
s AS (SELECT term, avg(value) AS mean, greatest(coalesce(stddev_samp(value), 0), 0.002) AS scale, least(min(value), 0) AS shift FROM r GROUP BY term),
z AS (SELECT author, r.term, idx, (value - mean) / scale AS z, greatest(value - shift, 0) AS u FROM r JOIN s ON r.term = s.term),
p AS (SELECT y.author AS b, x.term AS term, x.idx, x.z AS x, y.z AS y, x.u AS xu, y.u AS yu FROM z x JOIN z y ON x.term = y.term WHERE x.author = 'src0' AND y.author != 'src0')"""


def _author_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """z and shifted vectors (id, dim, ...) of all authors, and (dim, idx)."""
    docs = documents(spark, sf_dir)
    words = [(r["rank"], r.term) for r in vocabulary.most_frequent(docs, 50).collect()]  # 50 words
    top = spark.createDataFrame(words, "rank int, term string").coalesce(1)
    rates = vocabulary.word_rates(docs.select(F.col("author").alias("doc_id"), "text"), top, many=True)
    values = rates.select(F.col("doc_id").alias("author"), F.col("term").alias("dim"), "value").persist()  # read several times; a row for each author and word
    stats = distance.dim_stats(values, W.NOISE_FLOORS["frequency"])
    z = distance.z_scores(values, stats, "author").select(F.col("author").alias("id"), "dim", "z")
    u = distance.shifted(values, stats, "author").select(F.col("author").alias("id"), "dim", "value")
    return z, u, top.select(F.col("term").alias("dim"), (F.col("rank") - 1).alias("idx"))


def _against(vectors: DataFrame, value: str) -> DataFrame:
    return distance.pairs(vectors.where("id = 'src0'"), vectors.where("id != 'src0'"), value)


@query(f"{_Z} SELECT b AS author, round(avg(abs(x - y)), 6) AS distance FROM p GROUP BY b")
def rank_authors_burrows(spark, sf):
    z, _, _ = _author_vectors(spark, sf)
    return rounded(distance.distances(_against(z, "z"), "burrows").select(F.col("b").alias("author"), "distance"))


@query(f"{_Z} SELECT b AS author, round(sum((50 - idx) / 50.0 * abs(x - y)) / 50, 6) AS distance FROM p GROUP BY b")
def rank_authors_eder(spark, sf):
    z, _, rank = _author_vectors(spark, sf)
    return rounded(distance.distances(_against(z, "z"), "eder", rank).select(F.col("b").alias("author"), "distance"))


@query(f"{_Z} SELECT b AS author, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS distance FROM p GROUP BY b")
def rank_authors_cosine(spark, sf):
    z, _, _ = _author_vectors(spark, sf)
    return rounded(distance.distances(_against(z, "z"), "cosine").select(F.col("b").alias("author"), "distance"))


@query(f"{_Z} SELECT b AS author, round(sum(abs(xu - yu)) / sum(greatest(xu, yu)), 6) AS distance FROM p GROUP BY b")
def rank_authors_minmax(spark, sf):
    _, u, _ = _author_vectors(spark, sf)
    return rounded(distance.distances(_against(u, "value"), "minmax").select(F.col("b").alias("author"), "distance"))


@query(f"{_Z} SELECT b AS author, term AS dim, round(abs(x - y) / 50, 6) AS contribution FROM p")
def author_contributions(spark, sf):
    z, _, _ = _author_vectors(spark, sf)
    return rounded(distance.contributions(_against(z, "z"), "burrows").select(F.col("b").alias("author"), "dim", "contribution"))


@query(f"""{_Z}, q AS (SELECT d.author AS a, d.term, abs(d.z - x.z) / 50 AS ca, abs(d.z - y.z) / 50 AS cb FROM z d JOIN z x ON x.term = d.term AND x.author = 'src1' JOIN z y ON y.term = d.term AND y.author = 'src2' WHERE d.author = 'src0')
SELECT term AS dim, round(cb - ca, 6) + 0.0 AS pull FROM q""")
def classify_between_authors(spark, sf):
    z, _, _ = _author_vectors(spark, sf)
    side = lambda name: distance.pairs(z.where("id = 'src0'"), z.where(F.col("id") == name), "z")
    return rounded(distance.classify(side("src1"), side("src2"), "burrows").select("dim", "pull"))


_ODDS = f"""WITH {TOK}, {{terms}}, c AS (SELECT term, count_if(quality = 1) AS n_a, count_if(quality = 0) AS n_b, count(DISTINCT CASE WHEN quality = 1 THEN doc_id END) + count(DISTINCT CASE WHEN quality = 0 THEN doc_id END) AS df
  FROM t JOIN labels USING (doc_id) GROUP BY term),
s AS (SELECT *, sum(n_a) OVER ()::DOUBLE AS ta, sum(n_b) OVER ()::DOUBLE AS tb, sum(n_a + n_b + 0.5) OVER ()::DOUBLE AS tp FROM c),
o AS (SELECT *, least(ta, tb) AS size, least(ta, tb) * (n_a + n_b + 0.5) / tp AS alpha FROM s),
m AS (SELECT term, n_a, n_b, df, ln((n_a + alpha) / (ta + size - n_a - alpha)) - ln((n_b + alpha) / (tb + size - n_b - alpha)) AS delta, 1 / (n_a + alpha) + 1 / (n_b + alpha) AS variance FROM o WHERE n_a + n_b >= 5)"""
_ODDS_OUT = " SELECT term, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, df::BIGINT AS df, round(delta, 6) + 0.0 AS delta, round(variance, 6) AS variance, round(delta / sqrt(variance), 6) + 0.0 AS z FROM m"


def _sides(spark: SparkSession, sf_dir: str, kind: str = "word", n: int = 1) -> tuple[DataFrame, DataFrame]:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    terms = vocabulary.universe(documents(spark, sf_dir).join(labels, "doc_id"), kind, n).join(labels, "doc_id")
    return terms.where("quality = 1").select("doc_id", "term"), terms.where("quality = 0").select("doc_id", "term")


@query(_ODDS.replace("{terms}", "t AS (SELECT doc_id, w AS term FROM tok)") + _ODDS_OUT)
def contrast_words(spark, sf):
    return rounded(contrast.log_odds(*_sides(spark, sf)))


_BIGRAMS = "t AS (SELECT doc_id, term FROM (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS term FROM tok) WHERE term IS NOT NULL)"


@query(_ODDS.replace("{terms}", _BIGRAMS) + _ODDS_OUT)
def contrast_bigrams(spark, sf):
    return rounded(contrast.log_odds(*_sides(spark, sf, "word", 2)))


@query(_ODDS.replace("{terms}", "t AS (SELECT doc_id, w AS term FROM tok)") + " SELECT term, round(delta / sqrt(variance), 6) + 0.0 AS z FROM m WHERE abs(delta / sqrt(variance)) >= 3")
def contrast_vocabulary(spark, sf):
    return rounded(contrast.to_vocabulary(contrast.log_odds(*_sides(spark, sf)), 3.0))


_SURP = """, j AS (SELECT context, unit, count(*) AS j FROM u GROUP BY ALL), m AS (SELECT context, sum(j) AS m FROM j GROUP BY context), v AS (SELECT count(DISTINCT unit) + 1 AS v FROM u),
b AS (SELECT doc_id, i, -log2((j + 0.5) / (m + 0.5 * v)) AS bits FROM u JOIN j USING (context, unit) JOIN m USING (context) CROSS JOIN v),
f AS (SELECT doc_id, bits, avg(bits) OVER (PARTITION BY doc_id) AS mean, lag(bits) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM b),
g AS (SELECT doc_id, any_value(mean) AS mean, coalesce(var_samp(bits), 0) AS v, quantile_cont(bits, 0.1) AS p10, quantile_cont(bits, 0.9) AS p90, coalesce(sum((bits - mean) * (p - mean)), 0) AS cov, sum((bits - mean) * (bits - mean)) AS var, avg((bits < 2)::INT) AS low FROM f GROUP BY doc_id) """


def _surp_dims(prefix: str) -> dict[str, str]:
    return {f"{prefix}_mean": "mean", f"{prefix}_stddev": "sqrt(v)", f"{prefix}_variance": "v", f"{prefix}_fano": "CASE WHEN mean > 0 THEN v / mean ELSE 0 END", f"{prefix}_p10": "p10", f"{prefix}_p90": "p90", f"{prefix}_autocorr": "CASE WHEN var > 1e-9 THEN cov / var ELSE 0 END", f"{prefix}_low_share": "low"}


@query("""WITH e AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS ch FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), '') AS c FROM documents)),
u AS (SELECT doc_id, i, p2 || p1 AS context, ch AS unit FROM (SELECT doc_id, i, ch, lag(ch) OVER o AS p1, lag(ch, 2) OVER o AS p2 FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE p2 IS NOT NULL)""" + _SURP + _long(_surp_dims("surp:char"), "g"))
def char_surprisal(spark, sf):
    return rounded(surprisal.char_series(documents(spark, sf), 2.0))


@query(f"WITH {TOK}, u AS (SELECT * FROM (SELECT doc_id, i, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS context, w AS unit FROM tok) WHERE context IS NOT NULL)" + _SURP + _long(_surp_dims("surp:word"), "g"))
def word_surprisal(spark, sf):
    return rounded(surprisal.word_series(documents(spark, sf), 2.0))
