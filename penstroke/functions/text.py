"""Column expressions of the lexical tier; each has the same meaning in any engine with these regular expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstroke.functions import words as W


def token_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({W.TOKEN})"), 1)


def sentence_array(text: Column) -> Column:
    """Sentences with a token in them."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({W.SENTENCE})"), 1)
    return F.filter(found, lambda s: F.regexp(s, F.lit(r"[\p{L}\p{Nd}_]")))


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, keep..., i, w): the lexical tokens of each document."""
    return docs.select("doc_id", *keep, F.posexplode(token_array(F.col("text"))).alias("i", "w"))


def sentences(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, keep..., s, sentence)."""
    return docs.select("doc_id", *keep, F.posexplode(sentence_array(F.col("text"))).alias("s", "sentence"))


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens): the length of each document in lexical tokens."""
    return docs.select("doc_id", F.size(token_array(F.col("text"))).cast("long").alias("tokens"))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of text are among `characters`: bytes lost by taking each out, which is a plain byte search."""
    total = None
    for c in characters:
        lost = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c)))
        lost = lost if c.isascii() else (lost / len(c.encode())).cast("int")
        total = lost if total is None else total + lost
    return total


def per_1k(count: Column, size: Column) -> Column:
    return F.when(size > 0, 1000.0 * count / size).otherwise(0.0)


def ratio(count: Column, size: Column) -> Column:
    return F.when(size > 0, count / size).otherwise(0.0)


def occurrences(forms: str, word: str) -> Column:
    """How often a word is in a column of tokens."""
    return F.size(F.filter(forms, lambda w: w == word))


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e (not after a consonant and l), at least 1; 0 of an empty word."""
    letters = F.regexp_replace(word, r"[^\p{L}]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    silent = F.regexp(letters, F.lit("[^aeiouy]e$")) & ~F.regexp(letters, F.lit("[^aeiouy]le$"))
    counted = F.greatest(F.lit(1), groups - F.when(silent & (groups > 1), 1).otherwise(0))
    return F.when(word == "", 0).when(letters == "", 1).otherwise(counted)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whitespace_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def unpivot(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """(key, dim, value) from one expression for each dimension."""
    pairs = F.array(*(F.struct(F.lit(name).alias("dim"), value.cast("double").alias("value")) for name, value in columns.items()))
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.dim", "p.value")
