"""Queries of sources and cleaning, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from penstroke.functions import clean
from penstroke.functions.text import whitespace_words
from penstroke.plans.lexical import _q, documents, query, rounded
from penstroke.sources import records

_BLANK = r"regexp_replace(regexp_replace({x}, '\n[\x20\x09\x0D]*\n([\x20\x09\x0D]*\n)+', chr(10) || chr(10), 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


def _entities(text: str) -> str:
    for entity, char in clean.ENTITIES.items():
        text = f"replace({text}, {_q(entity)}, {_q(char)})"
    return text


_HTML = _entities(r"regexp_replace(regexp_replace(coalesce(html, ''), '(?i)<(p|br)\x20*/?>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')")


@query(f"SELECT page_id, md5({_BLANK.replace('{x}', _HTML)}) AS digest, length({_BLANK.replace('{x}', _HTML)})::BIGINT AS n FROM pages")
def page_texts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", clean.clean_html(F.col("html")).alias("t"))
    return pages.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations""")
def carried_questions(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    return turns.select("conv_id", "turn", records.carry_forward(turns, F.when(F.col("role") == "user", F.col("text")), "conv_id", order="turn").alias("asked"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w != ''))::BIGINT AS n FROM documents")
def whitespace_word_counts(spark, sf):
    return documents(spark, sf).select("doc_id", whitespace_words(F.col("text")).cast("long").alias("n"))


@query()
def stripped_code(spark, sf):
    found = records.prose_of(documents(spark, sf).select("doc_id", "text"))
    return found.select("doc_id", "code_share", "kept", F.md5("text").alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents)
SELECT doc_id, round(CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w != '')) >= 8
  AND NOT list_has_any([left(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), 1)], ['#', '|', '-', '*', '>']) AND NOT starts_with(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '..')))::DOUBLE / len(ls) ELSE 0 END, 6) AS share FROM l""")
def prose_shares(spark, sf):
    return rounded(documents(spark, sf).select("doc_id", clean.prose_ratio(F.col("text")).alias("share")))


@query(r"""SELECT doc_id, md5(regexp_replace(translate(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), '\p{Zs}', ' ', 'g')) AS digest FROM documents""")
def normal_spaces(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(clean.normalize_spaces(F.col("text"))).alias("digest"))


_TOKENS = r"""regexp_replace(text, '([,.;:!?%”’)\]])', ' \1', 'g')"""
_REPAIRED = _TOKENS
for _pattern, _to in ((r"([\p{L}\p{N}_])[ \t]+([’''])[ \t]*(s|t|re|ve|ll|d|m)\b", r"\1\2\3"), (r"[ \t]+([,.;:!?%])", r"\1"), (r"([“‘(\[])[ \t]+", r"\1"), (r"[ \t]+([”’)\]])", r"\1"), (r"[ \t]{2,}", " ")):
    _REPAIRED = f"regexp_replace({_REPAIRED}, '{_pattern}', '{_to}', 'g')"


@query(rf"""SELECT doc_id, md5(regexp_replace({_REPAIRED}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS digest, len(regexp_extract_all({_TOKENS}, '[ \t]+[,.;:!?%]')) > 0 AS changed FROM documents""")
def repaired_typography(spark, sf):
    """Texts with a space put before each mark, as a tokeniser leaves them, repaired."""
    cut = F.regexp_replace("text", r"([,.;:!?%”’)\]])", r" $1")
    text, _ = clean.repair_typography(cut)
    return documents(spark, sf).select("doc_id", F.md5(text).alias("digest"), (F.regexp_count(cut, F.lit(r"[ \t]+[,.;:!?%]")) > 0).alias("changed"))
