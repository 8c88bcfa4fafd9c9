"""Operator 10, quality rules: n-gram perplexity of a modified Kneser-Ney model, beside surface rules.

Characters fall into 32 classes (letters beyond Latin ones are dealt over the letters' classes by code point), so a model of
order 4 has at most 32**4 n-grams a language: that bounds what is sent to the driver and broadcast, whatever the
corpus. Spark counts the n-grams of all documents and fits each language's model in a task; it is kept as one sorted array of n-gram
hashes for each order, with log probabilities and back-off weights beside it, and is read by binary search.

The languages are those of the column `lang`, each with a model and a band of its own; null is `und`. Models of the LANGUAGES most
frequent ones are broadcast. Documents of all others are dealt by language, in slices of about SLICE bytes, and meet their language's
model there, so that their models and bands never pass through the driver. A document is rejected when its perplexity leaves the band
of its language. What is compared is the deviation of its logarithm from that of all text of the language, divided by SPREAD + 1 /
sqrt(characters), since short texts scatter more. A band has its middle in the median of the language's documents and reaches a number of their spreads (1.4826 median absolute deviations, LEAST_SPREAD at
least) below and above; both are of a histogram over all its documents of SHORT characters or more, as wide as the deviations are.

Degenerate rows: a null text is an empty one (no word, so it fails the base rules); repeated rows are judged each; an empty
table gives no rows; further columns are kept by `judge`, those named as its results replaced; a missing `lang` is not
allowed; a language whose documents are all short has its middle at 0 and the least spread.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import SEPARATORS, byte_view, chunks, code_points, mix, per_row, row_numbers, settle, table, texts_of, windows_hash

#: Languages whose models are broadcast at most, and bytes of a slice of the documents of another one.
LANGUAGES, SLICE = 128, 64 << 20
ORDER, BITS = 4, 5
CLASSES = 1 << BITS
#: Spreads below and above the middle of a band, and the terms of a deviation's scale.
BELOW, ABOVE, SPREAD, LEAST_SPREAD, SHORT = 4.5, 4.5, 0.05, 0.35, 100
#: A histogram of deviations has steps of 1 / FINE.
FINE = 50
#: Class 0 is the start of a text; letters follow, then what remains.
SPACE, DIGIT, STOP, COMMA, OTHER = 27, 28, 29, 30, 31


def _classes() -> np.ndarray:
    """Class of each code point below 0x10000; accented Latin letters count as their base letter."""
    out = np.full(0x10000, OTHER, np.int64)
    for point in range(0x10000):
        sign = chr(point)
        base = unicodedata.normalize("NFD", sign)[0].lower() if point < 0x250 else sign
        if "a" <= base <= "z":
            out[point] = ord(base) - 96
        elif sign.isspace():
            out[point] = SPACE
        elif sign.isdigit():
            out[point] = DIGIT
        elif sign in ".!?\u3002\uff01\uff1f\u0964\u061f":
            out[point] = STOP
        elif sign in ",;:'\"-()\u3001\uff0c\u060c":
            out[point] = COMMA
        elif point >= 0x250 and sign.isalpha():
            out[point] = point % 26 + 1
    return out


CLASS_OF = _classes()


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code of the 4-gram that ends at each character (the start of a text padded), and row offsets."""
    points, offsets = code_points(texts)
    n = len(offsets) - 1
    padded = np.zeros(len(points) + (ORDER - 1) * n, np.int64)
    at = np.arange(len(points)) + (ORDER - 1) * (row_numbers(offsets) + 1)
    wide = points > 0xFFFF
    padded[at[~wide]] = CLASS_OF[points[~wide]]
    padded[at[wide]] = points[wide] % 26 + 1  # mostly letters of rarer scripts
    code = padded[at]
    for k in range(1, ORDER):
        code |= padded[at - k] << (BITS * k)
    return code, offsets


def languages_of(docs: DataFrame, most: int = LANGUAGES) -> tuple[list[str], bool]:
    """The most frequent values of lang, and `und`; and whether there are others."""
    counted = docs.where("lang IS NOT NULL AND lang != 'und'").groupBy(F.col("lang").cast("string").alias("lang")).count()
    found = [r.lang for r in counted.orderBy(F.desc("count"), "lang").limit(most + 1).collect()]
    return [*found[:most], "und"], len(found) > most


def _numbers(langs: pd.Series, names: list[str]) -> np.ndarray:
    found = pd.Index(names).get_indexer(langs)
    return np.where(found < 0, len(names) - 1, found)


def count_grams(docs: DataFrame, names: list[str], held: int = 16) -> DataFrame:
    """(lang, code, n) over all documents, added up within each task for up to `held` languages at once."""

    def rows(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([names[k]] * len(seen), pa.string()), "code": seen, "n": counts[seen]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in chunks(batches, 0):
            code, offsets = grams(texts_of(batch.column(0)))
            of = _numbers(batch.column(1).to_pandas(), names)[row_numbers(offsets)]
            for k in np.unique(of).tolist():
                if k not in total and len(total) >= held:
                    yield from rows(total)
                    total = {}
                total[k] = total.get(k, 0) + np.bincount(code[of == k], minlength=CLASSES**ORDER)
        yield from rows(total)

    parts = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, code long, n long")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def count_rare_grams(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all documents, of any number of languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 0):
            code, offsets = grams(texts_of(batch.column(0)))
            langs = batch.column(1).dictionary_encode()
            of = langs.indices.to_numpy().astype(np.int64)[row_numbers(offsets)]
            key, n = np.unique(of * CLASSES**ORDER + code, return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": langs.dictionary.take(pa.array(key // CLASSES**ORDER)), "code": key % CLASSES**ORDER, "n": n})

    parts = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, code long, n long")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discount for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    n = [max(1, int((counts == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


def _hash(code: np.ndarray, order: int) -> np.ndarray:
    return mix(np.asarray(code, np.uint64) | np.uint64(order << 60))


@dataclass
class KneserNey:
    """Modified Kneser-Ney model in back-off form: sorted n-gram hashes of each order, log probability of
    each seen n-gram, and log weight of each seen context."""

    hashes: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    perplexity: float = float("nan")

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray) -> KneserNey:
        model, by = cls(), np.argsort(codes)
        levels = [(codes[by], counts[by])]
        for order in range(ORDER - 1, 0, -1):
            levels.append(np.unique(levels[-1][0] & ((1 << BITS * order) - 1), return_counts=True))  # in how many contexts a shorter n-gram is seen
        shorter, p = np.zeros(1, np.int64), np.full(1, 1 / CLASSES)
        for order, (seen, c) in enumerate(reversed(levels), 1):
            taken = _discounts(c)[np.minimum(c, 3)]
            held, at = np.unique(seen >> BITS, return_inverse=True)
            total = np.bincount(at, c)
            gamma = np.bincount(at, taken) / total
            p = (c - taken) / total[at] + gamma[at] * p[np.searchsorted(shorter, seen & ((1 << BITS * (order - 1)) - 1))]
            shorter = seen
            for codes_, values, keys, out in ((seen, p, model.hashes, model.logp), (held, gamma, model.contexts, model.weights)):
                h = _hash(codes_, order)
                keys.append(h[by := np.argsort(h)])
                out.append(np.log(np.maximum(values, 1e-12))[by].astype(np.float32))
        model.perplexity = float(np.exp(-(model.lookup(codes) * counts).sum() / max(1, counts.sum())))
        return model

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each n-gram given those before it."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            code = codes[todo] & ((1 << BITS * order) - 1)
            at, found = _find(self.hashes[order - 1], _hash(code, order))
            out[todo[found]] += self.logp[order - 1][at[found]]
            todo, code = todo[~found], code[~found]
            at, held = _find(self.contexts[order - 1], _hash(code >> BITS, order))
            out[todo[held]] += self.weights[order - 1][at[held]]
        out[todo] += np.log(1 / CLASSES)
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fitted(counts: DataFrame) -> DataFrame:
    """(lang, model): a model for each language that has text, fitted from its at most 32**4 counts in one task."""

    def fit(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        model = KneserNey.fit(group.column("code").to_numpy(), group.column("n").to_numpy())
        return pa.table({"lang": [key[0].as_py()], "model": pa.array([pickle.dumps(vars(model))], pa.binary())})

    return counts.groupBy("lang").applyInArrow(fit, "lang string, model binary")


def fit_models(docs: DataFrame, names: list[str]) -> dict[str, KneserNey]:
    return {r.lang: KneserNey(**pickle.loads(r.model)) for r in fitted(count_grams(docs, names)).toLocalIterator()}


def surface(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base rules' figures for whole texts."""
    flat, offsets = byte_view(texts)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    symbols = np.isin(flat, np.frombuffer(b"#*$%&|<>", np.uint8))
    pieces = pc.split_pattern_regex(texts, SEPARATORS)
    at, words = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False)), pieces.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    at, ids = at[real], words.dictionary_encode().indices.to_numpy()[real]
    n_words = np.bincount(at, minlength=len(texts))

    width = 8
    key, inside = windows_hash(ids, width), at[: max(0, len(at) - width + 1)] == at[width - 1 :]
    start = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        key = mix(key[start] + mix(at[start].astype(np.uint64)))
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    again = start[by[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(by) else start
    edge = np.bincount(again, minlength=len(ids) + width) - np.bincount(again + width, minlength=len(ids) + width)
    repeated = np.bincount(at[np.cumsum(edge)[: len(ids)] > 0], minlength=len(texts))

    lines = pc.split_pattern(texts, "\n")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    coded = lines.flatten().dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy()
    row, line = row[worded[line]], line[worded[line]]
    first = np.unique(row * (len(coded.dictionary) + 1) + line)
    distinct = np.bincount(first // (len(coded.dictionary) + 1), minlength=len(texts))
    return {
        "n_words": n_words, "word_chars": per_row(~blank & ((flat & 0xC0) != 0x80), offsets), "n_symbols": per_row(symbols, offsets),
        "n_dup_lines": np.bincount(row, minlength=len(texts)) - distinct, "n_repeat_words": repeated,
    }


def perplexities(texts: pa.Array, langs: pd.Series, names: list[str], models: dict[str, KneserNey]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: perplexity under its language's model, scaled deviation from that language's own (NaN without text), number of the language."""
    code, offsets = grams(texts)
    lang = _numbers(langs, names)
    score = np.zeros(len(code))
    of = lang[row_numbers(offsets)]
    for k in np.unique(of).tolist():
        mine = np.flatnonzero(of == k)
        seen, at = np.unique(code[mine], return_inverse=True)
        score[mine] = models[names[k]].lookup(seen)[at]
    size = np.diff(offsets)
    own = np.array([np.log(models[name].perplexity) if name in models else np.nan for name in names])
    with np.errstate(invalid="ignore", divide="ignore"):
        bits = np.where(size > 0, -per_row_float(score, offsets) / size, np.nan)
        return np.exp(bits), (bits - own[lang]) / (SPREAD + 1 / np.sqrt(size)), lang


def per_row_float(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.bincount(row_numbers(offsets), weights=values, minlength=len(offsets) - 1)


def _steps(batch: pa.RecordBatch, text: int, lang_: int, names: list[str], models: dict[str, KneserNey]) -> pa.RecordBatch:
    """Rows (lang, step, n): a histogram of the deviations of a batch."""
    texts = texts_of(batch.column(text))
    _, off, lang = perplexities(texts, _langs(batch.column(lang_)), names, models)
    use = np.isfinite(off) & (pc.utf8_length(texts).to_numpy() >= SHORT)
    found, n = np.unique(np.stack((lang[use], np.rint(off[use] * FINE).astype(np.int64))), axis=1, return_counts=True)
    return pa.RecordBatch.from_pydict({"lang": pa.array(names).take(pa.array(found[0])), "step": found[1], "n": n.astype(np.int64)})


def _langs(column: pa.Array) -> pd.Series:
    return column.cast(pa.string()).to_pandas()


def bands(parts: DataFrame) -> DataFrame:
    """(lang, low, high): lower and upper deviation of each language, from rows (lang, step, n) of a histogram over all its documents."""

    def ends(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        low, high = band(group.column("step").to_numpy(), group.column("n").to_numpy())
        return pa.table({"lang": [key[0].as_py()], "low": [low], "high": [high]})

    counted = parts.groupBy("lang", "step").agg(F.sum("n").alias("n"))
    return counted.groupBy("lang").applyInArrow(ends, "lang string, low double, high double")


#: The band of a language whose documents are all short.
NO_BAND = (-BELOW * LEAST_SPREAD, ABOVE * LEAST_SPREAD)


def band(steps: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Lower and upper end, from the histogram of a language's deviations."""
    values = steps / FINE

    def median(x: np.ndarray) -> float:
        by = np.argsort(x, kind="stable")
        return float(x[by][np.searchsorted(np.cumsum(counts[by]), counts.sum() / 2)])

    middle = median(values)
    spread = max(LEAST_SPREAD, 1.4826 * median(np.abs(values - middle)))
    return middle - BELOW * spread, middle + ABOVE * spread


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, perplexity double, base_failed boolean, kept boolean"


RULES = [c.split()[0] for c in COLUMNS.split(", ")]
RULE_FIELDS = [pa.field(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in COLUMNS.split(", ")]


def _judged(batch: pa.RecordBatch, text: int, lang_: int, names: list[str], models: dict[str, KneserNey], limits: np.ndarray) -> pa.RecordBatch:
    """A batch and the columns of the rules; limits: lower and upper deviation for each of names."""
    texts = texts_of(batch.column(text))
    found = surface(texts)
    found["perplexity"], off, lang = perplexities(texts, _langs(batch.column(lang_)), names, models)
    found["base_failed"] = (found["n_words"] < 20) | (100 * found["n_repeat_words"] > 30 * found["n_words"])
    low, high = limits[lang].T
    found["kept"] = ~found["base_failed"] & ~(off < low) & ~(off > high)
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c], from_pandas=c == "perplexity") for c in RULES)], names=[*batch.schema.names, *RULES])


def _judge_frequent(docs: DataFrame, names: list[str], schema: str) -> DataFrame:
    """Documents of the languages of names, by broadcast models."""
    shared = docs.sparkSession.sparkContext.broadcast({lang: vars(model) for lang, model in fit_models(docs, names).items()})
    text, lang_ = docs.columns.index("text"), docs.columns.index("lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {lang: KneserNey(**parts) for lang, parts in shared.value.items()}
        for batch in chunks(batches, 0):
            yield _steps(batch, 0, 1, names, models)

    parts = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, step long, n long")
    held = {r.lang: (r.low, r.high) for r in bands(parts).collect()}  # a row for each of names at most
    limits = np.array([held.get(name, NO_BAND) for name in names])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {lang: KneserNey(**parts) for lang, parts in shared.value.items()}
        for batch in chunks(batches, text):
            yield _judged(batch, text, lang_, names, models, limits)

    return docs.mapInArrow(score, schema)


def _judge_rare(docs: DataFrame, schema: str) -> DataFrame:
    """Documents of any number of languages: slices of a language's documents meet its model in a task."""
    key = ["__lang", "__slice"]
    text, lang_ = docs.columns.index("text"), docs.columns.index("lang")
    own = docs.withColumn("__lang", F.col("lang").cast("string"))
    size = F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + F.lit(64))
    sizes = own.groupBy("__lang").agg((F.floor(size / SLICE) + 1).alias("__slices"))
    row = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    dealt = own.join(sizes, "__lang").withColumn("__slice", F.pmod(row, "__slices")).select(*docs.columns, *key)
    models = settle(fitted(count_rare_grams(docs)).withColumnRenamed("lang", "__lang"))
    sliced = models.join(sizes, "__lang").withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__slices") - 1))).select(*key, "model")
    names = docs.columns

    def batches_of(group: pa.Table) -> Iterator[pa.RecordBatch]:
        return chunks(iter(group.select(names).to_batches()), text)

    def models_of(at: tuple[pa.Scalar, ...], held: pa.Table) -> dict[str, KneserNey]:
        return {at[0].as_py(): KneserNey(**pickle.loads(m)) for m in held.column("model").to_pylist()}

    def count(at: tuple[pa.Scalar, ...], group: pa.Table, held: pa.Table) -> pa.Table:
        mine = models_of(at, held)
        none = pa.schema([("lang", pa.string()), ("step", pa.int64()), ("n", pa.int64())])
        return pa.Table.from_batches([_steps(b, text, lang_, [at[0].as_py()], mine) for b in batches_of(group)], None if group.num_rows else none)

    met = dealt.groupBy(*key).cogroup(sliced.groupBy(*key))
    limits = bands(met.applyInArrow(count, "lang string, step long, n long")).withColumnRenamed("lang", "__lang")
    low, high = (F.coalesce(c, F.lit(x)).alias(c) for c, x in zip(("low", "high"), NO_BAND, strict=True))
    ready = sliced.join(limits, "__lang", "left").select(*key, "model", low, high)

    def score(at: tuple[pa.Scalar, ...], group: pa.Table, held: pa.Table) -> pa.Table:
        ends = np.array([[held.column(c)[0].as_py() for c in ("low", "high")]] if held.num_rows else [NO_BAND])
        mine = models_of(at, held)
        found = [_judged(b, text, lang_, [at[0].as_py()], mine, ends) for b in batches_of(group)]
        return pa.Table.from_batches(found) if found else pa.schema([*group.select(names).schema, *RULE_FIELDS]).empty_table()

    return dealt.groupBy(*key).cogroup(ready.groupBy(*key)).applyInArrow(score, schema)


def judge(docs: DataFrame, most: int = LANGUAGES) -> DataFrame:
    """All columns of docs, then those of the rules (which replace columns of the same name); models of `most` languages are broadcast."""
    docs = docs.drop(*RULES)
    names, others = languages_of(docs, most)
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes), COLUMNS])
    if not others:
        return _judge_frequent(docs, names, schema)
    listed = F.coalesce(F.col("lang").cast("string").isin(names), F.lit(True))
    return _judge_frequent(docs.where(listed), names, schema).unionByName(_judge_rare(docs.where(~listed), schema))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")
