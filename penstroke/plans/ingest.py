"""Queries of cleaning before ingest, and their SQL. Books are made of the part table, whose names stand as captions and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from penstroke.functions import clean
from penstroke.functions import ingest as I
from penstroke.functions import words as W
from penstroke.operators import features
from penstroke.plans.cleaning import _BLANK, _HTML
from penstroke.plans.lexical import SENT, _long, _q, documents, query, rounded

_NOTES = (*I.APPARATUS, *I.TAIL_PHRASES, "First published in 1901", "# About the author", "Also by somebody:", "plain words")
_BOOK = f"""lines AS (SELECT p_size AS book, p_partkey AS k, CASE WHEN p_partkey % 7 < 5 THEN p_partkey % 100 || '. ' || upper(p_name) WHEN p_partkey % 11 = 0 THEN p_name || chr(10) || chr(10) || [{', '.join(map(_q, _NOTES))}][p_partkey % {len(_NOTES)} + 1] || chr(10) || chr(10) ELSE p_name END AS line FROM part),
books AS (SELECT book, string_agg(line, chr(10) ORDER BY k) AS text FROM lines GROUP BY book)"""


def _books(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    note = F.element_at(F.array(*map(F.lit, _NOTES)), (k % len(_NOTES) + 1).cast("int"))
    line = F.when(k % 7 < 5, F.concat((k % 100).cast("string"), F.lit(". "), F.upper(name))).when(k % 11 == 0, F.concat(name, F.lit("\n\n"), note, F.lit("\n\n"))).otherwise(name)
    lines = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").alias("book"), k.alias("k"), line.alias("line"))
    return lines.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(p)})" for p in phrases) + ")"


def _n_words(column: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({column}, '[\x20\x09-\x0D]+'), lambda w: w != ''))"


@query(f"""WITH {_BOOK}, p AS (SELECT book, generate_subscripts(s, 1) AS i, unnest(s) AS p FROM (SELECT book, string_split(text, chr(10) || chr(10)) AS s FROM books)),
k AS (SELECT *, {_n_words('p')} AS n FROM p)
SELECT book, md5(string_agg(p, chr(10) || chr(10) ORDER BY i)) AS digest, count(*)::BIGINT AS kept FROM k
WHERE NOT (n > 0 AND ((n <= 300 AND {_any('lower(p)', I.APPARATUS)}) OR (n <= 25 AND {_any('lower(p)', I.APPARATUS_SHORT)}))) GROUP BY book""")
def apparatus_stripped(spark, sf):
    kept = _books(spark, sf).select("book", I.strip_apparatus(F.col("text")).alias("text"))
    return rounded(kept.select("book", F.md5("text").alias("digest"), F.size(F.split("text", "\n\n")).alias("kept")))


@query(rf"""WITH {_BOOK}, l AS (SELECT book, generate_subscripts(s, 1) AS i, unnest(s) AS line FROM (SELECT book, string_split(text, chr(10)) AS s FROM books)),
r AS (SELECT *, regexp_replace(line, '^[\x20\x09]*[0-9]{{1,4}}\.[\x20\x09]*', '') AS rest FROM l),
f AS (SELECT *, regexp_matches(line, '^[\x20\x09]*[0-9]{{1,4}}\.[\x20\x09]*\S') AND {_n_words('rest')} <= 12 AND len(regexp_extract_all(rest, '\p{{L}}')) > 0
  AND len(regexp_extract_all(rest, '\p{{Lu}}')) * 10 >= len(regexp_extract_all(rest, '\p{{L}}')) * 8 AS plate FROM r),
g AS (SELECT *, i - row_number() OVER (PARTITION BY book, plate ORDER BY i) AS run FROM f), c AS (SELECT *, count(*) OVER (PARTITION BY book, plate, run) AS n FROM g)
SELECT book, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (plate AND n >= 5)), '')) AS digest FROM c GROUP BY book""")
def plates_stripped(spark, sf):
    return _books(spark, sf).select("book", F.md5(I.strip_plate_lists(F.col("text"))).alias("digest"))


@query(rf"""WITH {_BOOK}, s AS (SELECT book, text, string_split(text, chr(10)) AS s FROM books), l AS (SELECT book, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS line, len(s) AS n FROM s),
b AS (SELECT *, rtrim(trim(ltrim(trim(line), '#')), '.:') AS bare FROM l),
m AS (SELECT book, min(i) AS cut_at FROM b WHERE i >= n * 2 // 3 AND ({_any('lower(bare)', I.TAIL_PHRASES)} OR (regexp_full_match(bare, '(?i)({'|'.join(f'(?:{h})' for h in I.TAIL_HEADINGS)})') AND {_n_words('bare')} <= 8)) GROUP BY book),
h AS (SELECT book, text, array_to_string(list_slice(s, 1, cut_at), chr(10)) AS head, cut_at FROM s LEFT JOIN m USING (book))
SELECT book, md5(CASE WHEN cut_at IS NOT NULL AND {_n_words('text')} - {_n_words('head')} <= 0.6 * {_n_words('text')} THEN regexp_replace(head, '[\x20\x09-\x0D]+$', '') ELSE text END) AS digest, cut_at IS NOT NULL AS marked FROM h""")
def tails_cut(spark, sf):
    return _books(spark, sf).select("book", F.md5(I.cut_tail(F.col("text"))).alias("digest"), I.has_tail(F.col("text")).alias("marked"))


_LIST = lambda words: ", ".join(map(_q, words))


@query(f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{I.WORD}'), lambda w: lower(w)) AS ws FROM documents)
SELECT doc_id, round(CASE WHEN len(ws) > 0 THEN 1000.0 * len(list_filter(ws, lambda w: length(w) >= 5 AND w NOT IN ({_LIST(I.FUNCTION_WORDS + I.COMPOUNDS)})
  AND len(list_filter(range(2, length(w) - 1), lambda k: w[1:k] IN ({_LIST(I.FUNCTION_WORDS)}) AND w[k + 1:] IN ({_LIST(I.FUNCTION_WORDS)}))) > 0)) / len(ws) ELSE 0 END, 6) AS rate FROM w""")
def glued_words(spark, sf):
    return rounded(documents(spark, sf).select("doc_id", I.glue_rate(F.coalesce("text", F.lit(""))).alias("rate")))


@query(rf"""WITH {SENT}, p AS (SELECT doc_id, len, regexp_extract_all(lower(sentence), {_q(f'(?:{W.TOKEN})|[^' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]')}) AS p FROM sent),
h AS (SELECT doc_id, len, len(p) >= 4 AND len(list_filter(range(len(p) // 2, len(p) - 1), lambda i: p[i + 1] = ',' AND length(p[i + 2]) > 4 AND ends_with(p[i + 2], 'ing') AND p[i + 2] NOT IN ({_LIST(W.ING_NOUNS)}))) > 0 AS hit FROM p)
SELECT doc_id, 'biber:participial_clause_rate' AS dim, round(1000.0 * count_if(hit) / sum(len), 6) AS value FROM h GROUP BY doc_id""")
def participial_clauses(spark, sf):
    return rounded(features.participial(documents(spark, sf)))


@query(r"""WITH d AS (SELECT doc_id AS id, text, lang || ' ' || source AS labels FROM documents),
j AS (SELECT id, string_split(labels, ' ')[2] AS register, len(regexp_extract_all(text, 'http')) AS chrome, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w != '')) AS n FROM d),
v AS (SELECT id, register, CASE WHEN register NOT IN ('src0', 'src1', 'src2') THEN 'register:' || register WHEN chrome > 1 THEN 'chrome:' || register WHEN n < 50 THEN 'short:' || register END AS reason FROM j)
SELECT coalesce(reason, 'kept ' || register) AS verdict, count(*)::BIGINT AS n FROM v GROUP BY 1""")
def register_reasons(spark, sf):
    lines = documents(spark, sf).select(F.concat_ws("\t", F.concat_ws(" ", "lang", "source"), F.col("doc_id").cast("string"), F.col("text")).alias("value"))
    judged = I.register_verdicts(I.read_register_rows(lines), {f"src{k}": f"src{k}" for k in range(3)}, "http", 1, 50)
    return judged.groupBy(F.coalesce("reason", F.concat(F.lit("kept "), "register")).alias("verdict")).agg(F.count("*").alias("n"))


#: Notes put into texts: within, behind the last word, and before the first.
_NOTED = r"""noted AS (SELECT doc_id, text AS was, CASE doc_id % 4 WHEN 0 THEN regexp_replace(text, ' ', ' [Transcriber''s Note for edition ' || doc_id || ': changed.]')
  WHEN 1 THEN text || chr(10) || chr(10) || 'Transcriber''s Notes:' || chr(10) || chr(10) || 'Written by somebody else.' WHEN 2 THEN 'Original Transcriber''s Notes' || chr(13) || chr(10) || chr(13) || chr(10) || 'From two archives.' || chr(13) || chr(10) || chr(13) || chr(10) || text
  ELSE text || chr(10) || 'End of Project Gutenberg''s files' END AS text FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text FROM documents))"""


@query(rf"""WITH {_NOTED} SELECT doc_id, md5(was) AS digest, CASE doc_id % 4 WHEN 0 THEN CASE WHEN contains(was, ' ') THEN 'bracketed-note' END WHEN 2 THEN 'inline-note' WHEN 3 THEN 'inner-footer'
  ELSE CASE WHEN strlen(was) + 2 > 0.85 * strlen(text) THEN 'trailing-note' ELSE 'inline-note' END END AS rule,
  CASE doc_id % 4 WHEN 0 THEN CASE WHEN contains(was, ' ') THEN 6 END WHEN 1 THEN 6 WHEN 2 THEN 6 ELSE 5 END::BIGINT AS words FROM noted""")
def editorial_stripped(spark, sf):
    """Texts with a note put into each, without it again, and what was removed: the SQL gives the text as it was."""
    edge = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
    text, k = F.regexp_replace(F.coalesce("text", F.lit("")), edge, ""), F.col("doc_id") % 4
    within = F.regexp_replace(text, r"^([^ ]*) ", F.concat(F.lit("$1 [Transcriber's Note for edition "), F.col("doc_id").cast("string"), F.lit(": changed.]")))
    noted = (
        F.when(k == 0, within).when(k == 1, F.concat(text, F.lit("\n\nTranscriber's Notes:\n\nWritten by somebody else.")))
        .when(k == 2, F.concat(F.lit("Original Transcriber's Notes\r\n\r\nFrom two archives.\r\n\r\n"), text)).otherwise(F.concat(text, F.lit("\nEnd of Project Gutenberg's files")))
    )
    found = documents(spark, sf).select("doc_id", I.strip_editorial(noted).alias("e")).select("doc_id", F.md5("e.text").alias("digest"), F.col("e.removals").alias("r"))
    one = F.get("r", F.lit(0))
    return found.select("doc_id", "digest", F.when(F.size("r") <= 1, one["rule"]).otherwise("several").alias("rule"), one["words"].cast("long").alias("words"))


_PAGE = _BLANK.replace("{x}", _HTML)


@query(rf"""WITH RECURSIVE p AS (SELECT page_id, {_PAGE} AS text FROM pages),
e AS (SELECT page_id, text, list_filter(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ps FROM p),
f AS (SELECT page_id, 1 AS i, 0 AS piece, {_n_words('ps[1]')} AS n, ps FROM e WHERE len(ps) > 0
  UNION ALL SELECT page_id, i + 1, CASE WHEN n >= 60 THEN piece + 1 ELSE piece END, CASE WHEN n >= 60 THEN 0 ELSE n END + {_n_words('ps[i + 1]')}, ps FROM f WHERE i < len(ps)),
l AS (SELECT page_id, max(piece) AS last, arg_max(n, i) AS n FROM f GROUP BY page_id),
j AS (SELECT f.page_id, CASE WHEN piece = last AND last > 0 AND l.n < 30 THEN piece - 1 ELSE piece END AS piece, i, ps[i] AS p FROM f JOIN l USING (page_id))
SELECT page_id, piece::BIGINT AS piece, md5(string_agg(p, chr(10) || chr(10) ORDER BY i)) AS digest FROM j GROUP BY page_id, piece
UNION ALL SELECT page_id, 0, md5(text) FROM e WHERE len(ps) = 0""")
def resized_pages(spark, sf):
    """Pages cut between paragraphs into pieces of about 60 words."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", clean.clean_html(F.col("html")).alias("text"))
    return rounded(pages.select("page_id", F.posexplode(I.resize(F.col("text"), 60)).alias("piece", "t")).select("page_id", "piece", F.md5("t").alias("digest")))


@query(rf"""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, text, {_n_words('text')} AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
f AS (SELECT conv_id, i, 1 AS part, n AS held, role, n >= 40 AS full_, m FROM s WHERE i = 1
  UNION ALL SELECT s.conv_id, s.i, CASE WHEN s.n >= 40 AND f.held >= 40 THEN f.part + 1 ELSE f.part END, CASE WHEN s.n >= 40 AND f.held >= 40 THEN s.n ELSE f.held + s.n END,
    CASE WHEN s.n >= 40 THEN s.role ELSE f.role END, true, s.m FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1)
SELECT conv_id, part::BIGINT - 1 AS part, arg_max(f.role, i) AS heading, md5(regexp_replace(string_agg(s.text, chr(10) || chr(10) ORDER BY i), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS digest FROM f JOIN s USING (conv_id, i) GROUP BY conv_id, part""")
def merged_turns(spark, sf):
    """Turns of conversations as sections, those below 40 words merged."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("heading"), F.col("text").alias("body")))).alias("t"))  # turns of one conversation
    merged = I.merge_short(F.transform("t", lambda x: F.struct(x["heading"].alias("heading"), x["body"].alias("body"))).cast(I.SECTIONS), 40)
    return rounded(parts.select("conv_id", F.posexplode(merged).alias("part", "s")).select("conv_id", "part", F.col("s.heading").alias("heading"), F.md5("s.body").alias("digest")))


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(split_part(url, '?', 1), '^.*/', ''), '(.)\.[^.]*$', '\1') AS stem, {_PAGE} AS text FROM pages),
w AS (SELECT *, {_n_words('text')} AS n, list_filter([{', '.join(map(_q, I.BOILERPLATE))}], lambda b: contains(lower(text), b)) AS hits FROM p)
SELECT page_id, CASE WHEN regexp_matches(stem, {_q(I.FRONT_BACK)}) THEN 'filename:' || stem WHEN len(hits) >= 3 OR (len(hits) >= 2 AND n < 2000) THEN 'boilerplate:' || array_to_string(hits[1:3], ',')
  WHEN n < 500 AND regexp_matches(text, '(?im)^[# ]*(?:about the author|by the same author)[.: ]*$') THEN 'back-matter' WHEN n < 40 THEN 'too-short:' || n || 'w' END AS reason FROM w""")
def section_reasons(spark, sf):
    """Why pages would be dropped as sections of a book."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.substring_index("url", "?", 1).alias("name"), clean.clean_html(F.col("html")).alias("text"))
    return pages.select("page_id", I.section_verdict(F.col("name"), F.array().cast("array<string>"), F.col("text")).alias("reason"))


_MARKED = """t AS (SELECT doc_id, '# ' || upper(left(coalesce(text, ''), 1)) || 'itle Words Here' || chr(10) || replace(replace(coalesce(text, ''), ' the ', ', and '), ' of ', CASE WHEN doc_id % 2 = 0 THEN ' — ' ELSE ' of ' END) AS text FROM documents)"""


def _marked(spark, sf):
    """Documents with a heading, and with commas and dashes in the place of some words."""
    text = F.coalesce("text", F.lit(""))
    body = F.replace(F.replace(text, F.lit(" the "), F.lit(", and ")), F.lit(" of "), F.when(F.col("doc_id") % 2 == 0, " — ").otherwise(" of "))
    return documents(spark, sf).select("doc_id", F.concat(F.lit("# "), F.upper(F.left(text, F.lit(1))), F.lit("itle Words Here\n"), body).alias("text"))


@query(rf"""WITH {_MARKED}, s AS (SELECT doc_id, text, len(regexp_extract_all(lower(text), {_q(W.TOKEN)})) AS n, regexp_extract_all(text, {_q('(?:' + W.TOKEN + ')|[^' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]')}) AS p,
  len(list_filter(regexp_extract_all(text, {_q(W.SENTENCE)}), lambda x: length(x) - length(replace(x, '—', '')) >= 2)) AS chains,
  len(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} ')), lambda x: list_filter(regexp_split_to_array(regexp_replace(x, '^[# ]+', ''), '[ \t]+'), lambda w: strlen(w) > 3)),
    lambda ws: len(ws) >= 2 AND len(list_filter(ws, lambda w: NOT regexp_matches(w, '^\p{{Lu}}'))) = 0)) AS titles FROM t),
c AS (SELECT *, len(list_filter(range(1, len(p) - 4), lambda i: regexp_matches(p[i], '^[\p{{L}}\p{{Nd}}_]') AND p[i + 1] = ',' AND regexp_matches(p[i + 2], '^[\p{{L}}\p{{Nd}}_]') AND p[i + 3] = ',' AND lower(p[i + 4]) = 'and' AND regexp_matches(p[i + 5], '^[\p{{L}}\p{{Nd}}_]'))) AS triples FROM s WHERE n > 0)
""" + _long({"lex:structural:rule_of_three": "1000.0 * triples / n", "lex:structural:em_dash_chain": "1000.0 * chains / n", "lex:structural:title_case_heading": "1000.0 * titles / n"}, "c"))
def structural_rules(spark, sf):
    return rounded(features.structural(_marked(spark, sf)))
