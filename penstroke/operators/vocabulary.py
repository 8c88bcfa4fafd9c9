"""Vocabularies chosen from a corpus, and documents' rates over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from penstroke.functions.text import tokens
from penstroke.text.batches import code_points, different, runs, spaced, strings, tokens_of, word_characters, words_of


def term_frequencies(terms: DataFrame) -> DataFrame:
    """(term, n, df): occurrences and documents of each term."""
    by_doc = terms.groupBy("term", "doc_id").agg(F.count("*").alias("c"))
    return by_doc.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("df"))


def frequent_words(docs: DataFrame, k: int = 500, culling: float = 0.0) -> DataFrame:
    """(term, n, df, rank): the k most frequent words, ties by word, in at least the share `culling` of documents."""
    counts = term_frequencies(tokens(docs).withColumnRenamed("w", "term"))
    if culling:
        counts = counts.where(F.col("df") >= F.ceil(F.lit(culling) * docs.count()))
    top = counts.orderBy(F.desc("n"), "term").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "term")))  # k rows


def _words_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, 0):
        points, begins = code_points(batch.column(0))
        held = pc.value_counts(words_of(points, *tokens_of(points, begins)[:2]))
        yield pa.RecordBatch.from_arrays([held.field("values"), held.field("counts")], ["term", "n"])


def most_frequent(docs: DataFrame, k: int) -> DataFrame:
    """(term, n, rank): as frequent_words, without the documents of a word. Runs of texts are counted as they are read, so only their
    different words are exchanged."""
    counted = docs.select(_lower().alias("text")).mapInArrow(_words_counted, "term string, n long")
    top = counted.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "term")))  # k rows


def word_rates(docs: DataFrame, vocabulary: DataFrame, many: bool = False) -> DataFrame:
    """(doc_id, term, value): relative frequency of each vocabulary word in each document, 0 included; documents without a word are left
    out. The vocabulary is small: words are looked up in it as they are read. many: a doc_id has many rows, as an author's texts under their name."""
    terms = [r.term for r in vocabulary.select("term").collect()]  # a vocabulary

    def count(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        points, begins = code_points(texts)
        starts, stops, sizes = tokens_of(points, begins)
        found = pc.index_in(words_of(points, starts, stops), pa.array(terms, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        return sizes, np.bincount(owner[found >= 0] * len(terms) + found[found >= 0], minlength=len(texts) * len(terms))

    return _counts(docs, terms, count, many)


def _lower() -> Column:
    return F.lower(F.coalesce("text", F.lit("")))


def _spaced() -> Column:
    """Text in lower case with one space in the place of each run of white space."""
    return F.regexp_replace(_lower(), r"[\x20\x09-\x0D]+", " ")


def char_grams(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, gram, type): every n-gram of the lower-cased text, typed by where it stands: with punctuation, with a space, within or
    at the edge of a word."""
    chars = docs.select("doc_id", F.split(_spaced(), "").alias("c")).where(F.size("c") >= n)
    one = lambda i: F.get("c", i)
    cuts = F.transform(F.sequence(F.lit(0), F.size("c") - n), lambda i: F.struct(F.concat(*(one(i + k) for k in range(n))).alias("gram"), F.coalesce(one(i - 1), F.lit(" ")).alias("left"), F.coalesce(one(i + n), F.lit(" ")).alias("right")))
    cut = chars.select("doc_id", F.explode(cuts).alias("g")).select("doc_id", "g.*")
    return cut.select("doc_id", "gram", gram_type().alias("type"))


def gram_type() -> Column:
    """The type of an n-gram (gram) between two characters (left, right; a space at the ends of a text)."""
    punct, space, letter = r"[^\p{L}\p{Nd}\x20]", r"\x20", r"[\p{L}\p{Nd}]"
    has = lambda c, p: F.regexp(F.col(c), F.lit(p))
    return (
        F.when(has("gram", f"^{punct}"), "beg_punct").when(has("gram", f"{punct}$"), "end_punct").when(has("gram", punct), "mid_punct")
        .when(has("gram", f"^{space}"), "space_prefix").when(has("gram", f"{space}$"), "space_suffix").when(has("gram", space), "multi_word")
        .when(~has("left", letter) & ~has("right", letter), "whole_word").when(~has("left", letter), "prefix").when(~has("right", letter), "suffix").otherwise("mid_word")
    )


#: Types of n-grams, in the order in which they are tried.
TYPES = ("beg_punct", "end_punct", "mid_punct", "space_prefix", "space_suffix", "multi_word", "whole_word", "prefix", "suffix", "mid_word")


def _typed(points: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of the types of n-grams, given as rows of code points; left and right: whether a letter or digit stands beside."""
    space = points == 32
    punct = ~space & ~word_characters()[points]
    tests = (punct[:, 0], punct[:, -1], punct.any(1), space[:, 0], space[:, -1], space.any(1), ~left & ~right, ~left, ~right, np.ones(len(points), bool))
    return np.argmax(np.stack(tests), axis=0)


def _grams_of(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Typed n-grams of each run of texts, counted. Texts stand in one row of characters with line ends between, which they don't have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 0):
            points, _ = spaced(*code_points(batch.column(0)))
            letters = np.flatnonzero(np.bincount(points))
            table = np.zeros(letters[-1] + 1, np.int32)
            table[letters] = np.arange(len(letters))
            codes, beside = table[points], word_characters()[points]
            m = max(0, len(points) - n - 1)
            rows, counts = different([beside[:m] * np.int8(2) + beside[n + 1 : n + 1 + m], *(codes[1 + k : 1 + k + m] for k in range(n))], [4] + [len(letters)] * n)
            held = letters[rows[:, 1:]]
            whole = (held != 10).all(axis=1)
            held, sides, counts = held[whole], rows[whole, 0], counts[whole]
            kinds = _typed(held, sides >= 2, sides % 2 == 1)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(strings(held), pa.string()), "type": pa.array([TYPES[k] for k in kinds], pa.string()), "c": pa.array(counts, pa.int64())})

    return count


def frequent_grams(docs: DataFrame, n: int, k: int = 1000) -> DataFrame:
    """(gram, type, c): the k most frequent typed n-grams, ties by type and gram. Runs of texts are counted as they are read, so only
    their different n-grams are exchanged."""
    counted = docs.select(_lower().alias("text")).mapInArrow(_grams_of(n), "gram string, type string, c long")
    return counted.groupBy("gram", "type").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "type", "gram").limit(k)


def ranked_grams(docs: DataFrame, n: int, k: int = 1000) -> DataFrame:
    """frequent_grams with their rank from 1."""
    return frequent_grams(docs, n, k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("c"), "type", "gram")))  # k rows


def rates(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, term, value): share of each vocabulary term among all terms (doc_id, term) of a document, 0 included; documents without a
    term are left out. One shuffle: terms outside the vocabulary, which is small, only count."""
    held = terms.join(F.broadcast(vocabulary.select("term", F.lit(True).alias("listed"))), "term", "left")
    by_term = held.groupBy("doc_id", F.when(F.col("listed"), F.col("term")).alias("term")).agg(F.count("*").alias("c"))
    entries = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "c")))
    packed = by_term.groupBy("doc_id").agg(F.sum("c").alias("size"), F.map_from_entries(entries).alias("held"))
    dense = packed.crossJoin(F.broadcast(vocabulary.select("term")))
    return dense.select("doc_id", "term", (F.coalesce(F.try_element_at("held", F.col("term")), F.lit(0)) / F.col("size")).alias("value"))


def _counts(docs: DataFrame, terms: list[str], count: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], many: bool = False) -> DataFrame:
    """(doc_id, term, value): `count` gives for an array of documents how many terms of any kind each has, and a row of how many of each listed
    one. Rows of one doc_id are one document; documents without a term are left out. Only counts are exchanged."""
    spark, key = docs.sparkSession, docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            size, held = count(batch.column(1))
            flat = pa.array(held.astype(np.int64).ravel(), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(terms), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), lists], ["doc_id", "size", "c"])

    counted = docs.select("doc_id", _lower().alias("text")).mapInArrow(run, StructType([key, StructField("size", LongType()), StructField("c", ArrayType(LongType()))]))
    if many:  # sums by key and term, which tasks add up before they exchange them
        each = counted.where("size > 0").select("doc_id", "size", F.posexplode("c").alias("k", "c"))
        summed = each.groupBy("doc_id", "k").agg(F.sum("size").alias("size"), F.sum("c").alias("c"))
        return summed.join(F.broadcast(spark.createDataFrame(list(enumerate(terms)), "k int, term string")), "k").select("doc_id", "term", (F.col("c") / F.col("size")).alias("value"))
    merged = counted.where("size > 0").groupBy("doc_id").agg(F.sum("size").alias("size"), F.collect_list("c").alias("all"))
    c = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    each = merged.select("doc_id", "size", F.posexplode(c).alias("k", "c"))
    listed = spark.createDataFrame(list(enumerate(terms)), "k int, term string")
    return each.join(F.broadcast(listed), "k").select("doc_id", "term", (F.col("c") / F.col("size")).alias("value"))


def gram_rates(docs: DataFrame, vocabulary: DataFrame, n: int) -> DataFrame:
    """(doc_id, term, value): share of typed n-grams (gram, type) among all n-grams of a document; shorter documents are left out. The
    vocabulary is small: n-grams are looked up in it as they are read."""
    listed = [(r.gram, r.type) for r in vocabulary.select("gram", "type").collect()]  # a vocabulary
    letters = sorted({ord(c) for gram, _ in listed for c in gram})
    kinds = {name: i for i, name in enumerate(TYPES)}
    #: Of each length the beginnings of n-grams, numbered from 1; a step leads from one and a letter to a longer one, or to 0.
    begun = [sorted({gram[:k] for gram, _ in listed if len(gram) == n}) for k in range(n + 1)]
    number = [{x: i + 1 for i, x in enumerate(level)} for level in begun]
    steps = [np.zeros((len(level) + 1, len(letters) + 1), np.int32) for level in begun[:n]]
    for k, level in enumerate(begun[1:]):
        for x in level:
            steps[k][number[k][x[:-1]], letters.index(ord(x[-1])) + 1] = number[k + 1][x]
    lookup = np.full((len(begun[n]) + 1, len(TYPES)), -1)
    for k, (gram, kind) in enumerate(listed):
        if len(gram) == n and kind in kinds:
            lookup[number[n][gram], kinds[kind]] = k

    def count(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        points, begins = spaced(*code_points(texts))
        table = np.zeros(max(letters, default=0) + 1, np.int32)
        table[letters] = np.arange(1, len(letters) + 1)
        codes = table[np.where(points < len(table), points, 0)]
        codes[points >= len(table)] = 0
        m = max(0, len(points) - n - 1)
        state = np.ones(m, np.int32)
        for k, step in enumerate(steps):
            state = step.ravel()[state * np.int32(len(letters) + 1) + codes[1 + k : 1 + k + m]] if begun[n] else state * 0
        at = np.flatnonzero(state)
        state, at, beside = state[at], at + 1, word_characters()
        kind = _typed(points[at[:, None] + np.arange(n)], beside[points[at - 1]], beside[points[at + n]])
        term = lookup[state, kind]
        at, term = at[term >= 0], term[term >= 0]
        owner = np.searchsorted(begins, at, side="right") - 1
        return np.maximum(np.diff(begins) - n, 0), np.bincount(owner * len(listed) + term, minlength=len(texts) * len(listed))

    return _counts(docs, [f"{kind}:{gram}" for gram, kind in listed], count)


def universe(docs: DataFrame, kind: str, n: int = 1) -> DataFrame:
    """(doc_id, term): words, runs of n words, or runs of n characters."""
    if kind == "char":
        return char_grams(docs, n).select("doc_id", F.col("gram").alias("term"))
    each = tokens(docs)
    if n == 1:
        return each.select("doc_id", F.col("w").alias("term"))
    order = Window.partitionBy("doc_id").orderBy("i")
    terms = each.select("doc_id", F.concat_ws(" ", "w", *(F.lead("w", k).over(order) for k in range(1, n))).alias("term"), F.lead("w", n - 1).over(order).alias("last"))
    return terms.where("last IS NOT NULL").drop("last")
