"""Operator 3, language identification: a document as a mixture of languages.

Spark counts character trigrams of each language, of letters and marks as they are (in lower case, all else as one gap), over all labelled rows. A
language's model is its ENTRIES most frequent trigrams, sorted, with their bigrams and single characters for what is
smoothed; the LANGUAGES values of lang with the most rows are learned (ties by name), so a model has a bound whatever stands in the column. Texts of
rarer values are predicted as the nearest learned language. A word's likelihood under a language is
the product of its trigrams' probabilities. Expectation-maximisation estimates the proportions of
the languages over the words of a document; languages are then dropped, least proportion first, while
the likelihood lost is below the penalty of one parameter (half the logarithm of the number of words,
as in the Bayesian information criterion). The document's language is the largest proportion left.

Degenerate rows: a null text, or one without a letter, is `und` with score 0; ties go to the language
first by name; repeated rows are each predicted; without any training row every text is `und`; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstroke.llm.common import chunks, code_points, per_row, row_numbers, settle, table, texts_of

#: Bits of a code point, and the letters that an unseen one is taken to be among.
BITS, ALPHABET = 21, 4096
LANGUAGES, ENTRIES = 256, 1 << 15
STEPS, STEPS_AFTER = 10, 5
#: Weight of the shorter n-gram's probability in a smoothed probability.
PRIOR = 8.0
#: Entries that a task adds up before it sends them on.
HELD = 1 << 19


def _class(point: int) -> int:
    """0 for what is no letter or mark, else the code point of the lower case."""
    low = chr(point).lower()
    return 0 if unicodedata.category(chr(point))[0] not in "LM" else ord(low) if len(low) == 1 else point


CLASS_OF = np.array([_class(p) for p in range(0x10000)], np.int64)
LETTER = np.array([chr(p).isalpha() for p in range(0x10000)])


def _looked_up(points: np.ndarray, table_: np.ndarray, rest: Callable[[int], int]) -> np.ndarray:
    out = table_[points & 0xFFFF]
    far = np.flatnonzero(points >= 0x10000)
    if len(far):
        kinds, at = np.unique(points[far], return_inverse=True)
        out[far] = np.array([rest(p) for p in kinds.tolist()], table_.dtype)[at]
    return out


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the trigrams that touch a letter: code, row and word number; and whether each row has a letter."""
    points, offsets = code_points(texts)
    kind = _looked_up(points, CLASS_OF, _class)
    n = len(offsets) - 1
    row = row_numbers(offsets)
    at = np.arange(len(points)) + 2 * row + 1  # a gap on both sides of each text
    padded = np.zeros(len(points) + 2 * n + 2, np.int64)
    padded[at] = kind
    code = (padded[:-2] << 2 * BITS) | (padded[1:-1] << BITS) | padded[2:]
    letter = padded > 0
    word = np.cumsum(letter[1:] & ~letter[:-1])  # number of the word that a position is in or after
    use = np.flatnonzero(letter[1:-1])
    of = np.zeros(len(padded), np.int64)
    of[at] = row
    return code[use], of[use + 1], word[use], per_row(_looked_up(points, LETTER, lambda p: chr(p).isalpha()), offsets) > 0


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts added up."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.diff(keys, prepend=-2))
    return keys[first], np.add.reduceat(counts[by], first) if len(first) else counts


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows with text and lang, added up within each task first; code -1 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows_of() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                code, n = _counted(*map(np.concatenate, zip(*parts, strict=True)))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(code), pa.string()), "code": code, "n": n})

        for batch in chunks(batches, 0):
            code, row, _, _ = trigrams(texts_of(batch.column(0)))
            names = batch.column(1).dictionary_encode()
            index = names.indices.to_numpy()
            by = np.argsort(index[row], kind="stable")
            edges = np.searchsorted(index[row][by], np.arange(len(names.dictionary) + 1))
            for k, name in enumerate(names.dictionary.to_pylist()):
                mine = np.append(code[by[edges[k] : edges[k + 1]]], np.full(int((index == k).sum()), -1))
                part = _counted(mine, np.ones(len(mine), np.int64))
                held.setdefault(name, []).append(part)
                size += len(part[0])
            if size > HELD:
                held = {name: [_counted(*map(np.concatenate, zip(*parts, strict=True)))] for name, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from rows_of()
                    held, size = {}, 0
        yield from rows_of()

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Grams:
    """Counts of one language's trigrams, of the bigrams and characters in them, and of what each stands behind."""

    def __init__(self, code: np.ndarray, n: np.ndarray) -> None:
        low = (1 << 2 * BITS) - 1
        self.three = _counted(code, n)
        self.before_three = _counted(code >> BITS, n)
        self.two = _counted(code & low, n)
        self.before_two = _counted((code & low) >> BITS, n)
        self.one = _counted(code & ((1 << BITS) - 1), n)
        self.total = float(n.sum())

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Of the third character given the two before it."""
        low = (1 << 2 * BITS) - 1
        p = (_count(self.one, code & ((1 << BITS) - 1)) + PRIOR / ALPHABET) / (self.total + PRIOR)
        p = (_count(self.two, code & low) + PRIOR * p) / (_count(self.before_two, (code & low) >> BITS) + PRIOR)
        return np.log((_count(self.three, code) + PRIOR * p) / (_count(self.before_three, code >> BITS) + PRIOR)).astype(np.float32)


def _count(listed: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(listed[0], keys), len(listed[0]) - 1)
    return np.where(listed[0][at] == keys, listed[1][at], 0)


def fit(docs: DataFrame, languages: int = LANGUAGES, entries: int = ENTRIES) -> tuple[list[str], list[Grams]]:
    """Names of the learned languages, ascending, and their models."""
    counted = settle(count_trigrams(docs))
    learned = counted.where("code = -1").orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    kept = counted.where("code >= 0").join(F.broadcast(learned), "lang", "left_semi").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= entries)
    found = kept.orderBy("lang").select("lang", "code", "n").toArrow()  # at most languages * entries rows
    lang, code, n = (found.column(c).combine_chunks() for c in ("lang", "code", "n"))
    names = lang.dictionary_encode()
    index, code, n = names.indices.to_numpy(), code.to_numpy(), n.to_numpy()
    return names.dictionary.to_pylist(), [Grams(code[index == k], n[index == k]) for k in range(len(names.dictionary))]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def mixtures(logp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions of each document's languages, those outside its set at 0. logp: word by language, words
    of a document together; starts: first word of each document."""
    sizes = np.diff(np.append(starts, len(logp)))
    top = logp.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(logp - top, -60))
    n_docs, n_langs = len(starts), logp.shape[1]

    def em(pi: np.ndarray, of: np.ndarray, rows: np.ndarray, begin: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(np.append(begin, len(rows)))[:, None]
        part = like[rows]
        for _ in range(steps):
            r = part * pi[of]
            r /= r.sum(axis=1, keepdims=True)
            pi = _sums(r, begin) / n
        return pi, _sums(np.log((part * pi[of]).sum(axis=1)), begin)

    rows, of = np.arange(len(logp)), np.repeat(np.arange(n_docs), sizes)
    pi, full = em(np.full((n_docs, n_langs), 1 / n_langs, like.dtype), of, rows, starts, STEPS)
    penalty = 0.5 * np.log(np.maximum(sizes, 2))
    single = _sums(logp - top, starts)
    best = single.argmax(axis=1)
    out = np.zeros((n_docs, n_langs))
    out[np.arange(n_docs), best] = 1
    # No set of languages can gain more than all of them: most documents stay with one.
    open_ = np.flatnonzero(full - single.max(axis=1) > penalty)
    while len(open_):
        n = sizes[open_]
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        rows = np.repeat(starts[open_] - begin, n) + np.arange(n.sum())
        of = np.repeat(np.arange(len(open_)), n)
        now = pi[open_]
        out[open_] = now
        least = np.where(now > 0, now, 2).argmin(axis=1)
        fewer = now.copy()
        fewer[np.arange(len(open_)), least] = 0
        many = (now > 0).sum(axis=1) > 1
        fewer[~many] = now[~many]
        fewer = np.where(fewer > 0, np.maximum(fewer, 1e-6), 0).astype(like.dtype)
        fewer /= fewer.sum(axis=1, keepdims=True)
        fewer, reached = em(fewer, of, rows, begin, STEPS_AFTER)
        dropped = many & (full[open_] - reached <= penalty[open_])
        pi[open_[dropped]], full[open_[dropped]] = fewer[dropped], reached[dropped]
        out[open_[dropped]] = fewer[dropped]
        open_ = open_[dropped & ((fewer > 0).sum(axis=1) > 1)]
    return out


def predict(docs: DataFrame, names: list[str], model: list[Grams]) -> DataFrame:
    """All columns of docs, then lang_pred, score and n_languages (which replace columns of the same name)."""
    docs = docs.drop("lang_pred", "score", "n_languages")
    shared, at_ = docs.sparkSession.sparkContext.broadcast((np.array([*names, "und"], dtype=object), model)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, models = shared.value
        # A chunk's table of likelihoods has a column for each language.
        for batch in chunks(batches, at_, (1 << 23) // max(8, len(labels))):
            n = batch.num_rows
            pred, score, sets = np.full(n, len(labels) - 1), np.zeros(n), np.zeros(n, np.int64)
            code, row, word, lettered = trigrams(texts_of(batch.column(at_)))
            if len(code) and len(labels) > 1:
                first = np.flatnonzero(np.diff(word, prepend=-1))
                kinds, at_kind = np.unique(code, return_inverse=True)
                likely = np.stack([m.log_probabilities(kinds) for m in models], axis=1)
                by_word = _sums(likely[at_kind], first)
                docs_ = row[first]
                starts = np.flatnonzero(np.diff(docs_, prepend=-1))
                pi = mixtures(by_word, starts)
                at = docs_[starts]
                pred[at], score[at], sets[at] = pi.argmax(axis=1), pi.max(axis=1), (pi > 0).sum(axis=1)
            pred[~lettered], score[~lettered], sets[~lettered] = len(labels) - 1, 0, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[pred], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets)], names=[*batch.schema.names, "lang_pred", "score", "n_languages"])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes), "lang_pred string, score double, n_languages long"]))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    names, model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "text", "held_out"), names, model).drop("text")
