"""Queries of devices and syntax, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.operators import devices, surprisal
from penstroke.plans.lexical import SENT, TOK, _among, _long, _n, _q, _share, _values, documents, query, rounded
from penstroke.plans.models import _NORM, _norms

_AMPLIFIERS = W.REGISTER["amplifier_rate"].split()


@query(f"WITH {TOK} " + _long({f"syn:{k}": f"1000.0 * {v} / n" for k, v in {
    "ly_adverb_rate": "len(list_filter(ws, lambda w: length(w) > 4 AND ends_with(w, 'ly')))", "intensifier_rate": _among(_AMPLIFIERS), "interjection_rate": _among(devices.INTERJECTIONS),
    **{f"person:{k}": _among(v.split()) for k, v in devices.PERSONS.items()}, "allcaps_exclaim_rate": _n(r"\p{Lu}{2,}!")}.items()}, "sized"))
def syntax_texture(spark, sf):
    return rounded(devices.texture(documents(spark, sf)))


@query(f"""WITH {SENT}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE ws[1] IN ({', '.join(map(_q, devices.COORDINATORS))})) AS f, sum({_among(devices.SUBORDINATORS)}) AS s, sum({_among(devices.COORDINATORS)}) AS c FROM sent WHERE len > 0 GROUP BY doc_id) """ + _long(
    {"syn:initial_conj_rate": "100.0 * f / n", "syn:sub_coord_ratio": _share("s", "c")}, "g"))
def clause_shape(spark, sf):
    return rounded(devices.clause_shape(documents(spark, sf)))


_SHAPES = {
    "imperative_rate": f"ws[1] IN ({', '.join(map(_q, devices.IMPERATIVES))}) AND coalesce(ws[2], '') != 'not'", "headline:number_initial": "regexp_matches(ws[1], '^[0-9]+$')",
    "headline:listicle": "len <= 12 AND regexp_matches(ws[1], '^[0-9]+$') AND ws[2] IN ('ways', 'things', 'reasons', 'tips', 'steps')", "headline:question": "len <= 12 AND ends_with(sentence, '?')",
    "headline:demonstrative": f"len <= 12 AND ws[1] IN ({', '.join(map(_q, devices.DEMONSTRATIVES))})",
}


@query(f"""WITH {TOK}, {SENT}, g AS (SELECT doc_id, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {v}) AS "{k}"' for k, v in _SHAPES.items())} FROM sent WHERE len > 0 GROUP BY doc_id) """ + _long({f"dev:{k}": f'100.0 * "{k}" / n' for k in _SHAPES}, "g")
    + " UNION ALL " + _long({"dev:triplet_rate": "1000.0 * " + _n(r"[\p{L}]+, [\p{L}]+,? (?:and|or) [\p{L}]+") + " / n"}, "sized"))
def marketing_shapes(spark, sf):
    return rounded(devices.marketing(documents(spark, sf)))


#: Sentences of a document, and its tokens in a line with two spaces between, so that counted patterns may touch.
_COUNTED = f"{TOK}, {SENT}, z AS (SELECT s.doc_id, s.text, s.n, s.ws, len(p.ss) AS k, p.ss, '  ' || array_to_string(s.ws, '  ') || '  ' AS wide, ' ' || array_to_string(s.ws, ' ') || ' ' AS line FROM sized s JOIN parts p USING (doc_id) WHERE regexp_matches(s.text, '[\\p{{L}}\\p{{Nd}}_]'))"


@query(f"WITH {_COUNTED} " + _long({
    "read:passive_rate": "100 * " + _share(f"len(regexp_extract_all(wide, ' (?:{'|'.join(devices.BE)})  (?:[^ ]+  ){{0,2}}?[^ ]{{2,}}(?:ed|en|wn|ught) '))", "k"),
    "read:acronym_rate": r"1000.0 * len(list_filter(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: regexp_full_match(x, '[\p{Lu}\p{Nd}]{2,8}') AND len(regexp_extract_all(x, '\p{Lu}')) >= 2)) / n"}, "z"))
def passive_and_acronyms(spark, sf):
    return rounded(devices.passives(documents(spark, sf)))


_FRAME = "(?: as (?:[^ ]+ ){1,3}?as | like an? | much the same way )"


@query(f"""WITH {_COUNTED}, f AS (SELECT *, len(regexp_extract_all(line, '{_FRAME}')) AS c, len(regexp_extract_all(line, ' (?:not|never|hardly){_FRAME}')) AS negated, {' + '.join("len(regexp_extract_all(wide, ' " + x.replace(' ', '  ') + " '))" for x in devices.FROZEN)} AS frozen,
  list_transform(regexp_split_to_array(line, '{_FRAME}')[2:-2], lambda p: len(list_filter(string_split(p, ' '), lambda w: w != ''))::DOUBLE) AS gaps FROM z), g AS (SELECT *, list_avg(gaps) AS m, list_stddev_pop(gaps) AS sd FROM f) """ + _long({
    "frame:simile_rate": "1000.0 * c / n", "frame:negated_vehicle_rate": "1000.0 * negated / n", "frame:frozen_share": "least(1.0, " + _share("frozen", "c") + ")",
    "frame:figure_burstiness": "CASE WHEN c >= 4 AND len(gaps) >= 2 AND sd + m > 0 THEN (sd - m) / (sd + m) END"}, "g"))
def comparison_frames(spark, sf):
    return rounded(devices.frames(documents(spark, sf)))


@query(f"WITH {_COUNTED} " + _long({
    "md:link_rate": r"1000.0 * (len(regexp_extract_all(text, '\]\([^)]*\)')) + len(regexp_extract_all(regexp_replace(text, '\]\([^)]*\)', ' ', 'g'), '(?:^|[^(])https?://'))) / n", "md:footnote_rate": r"1000.0 * len(regexp_extract_all(text, '\[\^[^\]]+\]')) / n",
    "sent:rhetorical_question_rate": "100 * " + _share(r"len(list_filter(ss, lambda s: ends_with(s, '?') AND NOT regexp_matches(lower(trim(s)), '^(do|did|can|could|will|would|are|have|may|should) you\b')))", "k")}, "z"))
def links_and_questions(spark, sf):
    return rounded(devices.links(documents(spark, sf)))


@query(f"""WITH {TOK}, {SENT}, a AS (SELECT z.doc_id, z.n, len(p.ss) AS s, regexp_extract_all(z.text, '\\([^()\\n]+\\)|—[^—\\n]+—') AS xs FROM sized z JOIN parts p USING (doc_id)),
g AS (SELECT doc_id, n, s, len(xs) AS k, coalesce(list_sum(list_transform(xs, lambda x: len(regexp_extract_all(lower(x), {_q(W.TOKEN)})))), 0) AS t FROM a) """ + _long({
    "sent:aside_rate": "100 * " + _share("k", "s"), "sent:aside_len_mean": _share("t", "k"), "sent:aside_share": _share("t", "n")}, "g"))
def asides(spark, sf):
    return rounded(devices.asides(documents(spark, sf)))


_PAIRS = (("the", "of"), ("le", "la"), ("der", "die"), ("el", "la"), ("is", "was"))


@query(f"""WITH {TOK}, {SENT}, p(a, b) AS (VALUES {_values(_PAIRS)}), h AS (SELECT DISTINCT doc_id, s FROM sent JOIN p ON list_contains(ws, a) AND list_contains(ws, b))
SELECT z.doc_id, 'dev:antonym_pair_rate' AS dim, round(1000.0 * count(h.s) / any_value(z.n), 6) AS value FROM sized z LEFT JOIN h USING (doc_id) GROUP BY z.doc_id""")
def paired_words(spark, sf):
    return rounded(devices.paired_words(documents(spark, sf), spark.createDataFrame(list(_PAIRS), "a string, b string")))


@query(f"""WITH {TOK}, r AS (SELECT doc_id, i, right(w, 3) AS key FROM tok WHERE length(w) >= 4), g AS (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id, key ORDER BY i) AS gap FROM r)
SELECT z.doc_id, 'dev:rhyme_chain_rate' AS dim, round(1000.0 * count(gap) FILTER (WHERE gap <= 12) / any_value(z.n), 6) AS value FROM sized z LEFT JOIN g USING (doc_id) GROUP BY z.doc_id""")
def near_endings(spark, sf):
    """Endings of three letters in the place of rhymes."""
    from penstroke.functions.text import tokens

    docs = documents(spark, sf)
    keys = tokens(docs).where(F.length("w") >= 4).select("w", F.expr("right(w, 3)").alias("key")).distinct()
    return rounded(devices.near_keys(docs, keys))


@query(f"""{_NORM}, {SENT}, c AS (SELECT quantile_cont(score, 0.25) AS lo, quantile_cont(score, 0.75) AS hi FROM norm), e AS (SELECT doc_id, s, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM sent),
k AS (SELECT e.doc_id, e.s, e.i, CASE WHEN score >= hi THEN 1 WHEN score <= lo THEN 0 END AS side FROM e LEFT JOIN norm ON norm.w = e.w CROSS JOIN c),
h AS (SELECT DISTINCT a.doc_id, a.s FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.s = b.s AND a.side = 1 AND b.side = 0 AND abs(a.i - b.i) <= 12), t AS (SELECT doc_id, count(DISTINCT s) AS n FROM e GROUP BY doc_id)
SELECT t.doc_id, 'form:clash_rate' AS dim, round(100.0 * count(h.s) / any_value(t.n), 6) AS value FROM t LEFT JOIN h ON h.doc_id = t.doc_id GROUP BY t.doc_id""")
def norm_clashes(spark, sf):
    return rounded(devices.clashes(documents(spark, sf), _norms(spark, sf)))


@query()
def punchlines(spark, sf):
    return rounded(surprisal.sentence_punches(documents(spark, sf)))
