"""How surprising documents are to small language models of a corpus, in bits."""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from penstroke.functions.text import sentence_array, token_array, tokens, unpivot
from penstroke.text.batches import code_points, different, elements, number_of, runs, strings, tokens_of, words_of


def char_units(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, i, context, unit): each character after its `order` - 1 predecessors."""
    chars = docs.select("doc_id", F.split(F.lower(F.coalesce("text", F.lit(""))), "").alias("c")).where(F.size("c") >= order)
    one = lambda i: F.get("c", i)
    cuts = F.transform(F.sequence(F.lit(order - 1), F.size("c") - 1), lambda i: F.struct(i.alias("i"), F.concat(*(one(i - k) for k in range(order - 1, 0, -1))).alias("context"), one(i).alias("unit")))
    return chars.select("doc_id", F.explode(cuts).alias("u")).select("doc_id", "u.*")


def word_units(docs: DataFrame) -> DataFrame:
    """(doc_id, i, context, unit): each token after the one before it."""
    order = Window.partitionBy("doc_id").orderBy("i")
    return tokens(docs).select("doc_id", "i", F.lag("w").over(order).alias("context"), F.col("w").alias("unit")).where("context IS NOT NULL")


def fit(units: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """Counts (context, unit, j) of at least `least`, counts (context, m) with none left out, and the number of units plus one."""
    j = units.groupBy("context", "unit").agg(F.count("*").alias("j"))
    m = j.groupBy("context").agg(F.sum("j").alias("m"))
    return j.where(F.col("j") >= least), m, j.select("unit").distinct().count() + 1


#: Most frequent types, whose bits a broadcast holds.
HEAD = 1 << 16


def score(units: DataFrame, model: tuple[DataFrame, DataFrame, int], k: float = 0.5, head: int = HEAD) -> DataFrame:
    """units with bits: -log2((j + k) / (m + k V)). Types are counted first and looked up in the model; the bits of the `head` most frequent ones, which most units
    belong to, are broadcast, so that only units of rare types are shuffled by type, and no key of that join is hot."""
    j, m, v = model
    keys = ["context", "unit"]
    types = units.groupBy(*keys).agg(F.count("*").alias("n")).join(j, keys, "left").join(m, "context", "left")
    bits = -F.log2((F.coalesce("j", F.lit(0)) + k) / (F.coalesce("m", F.lit(0)) + k * v))
    scored = types.select(*keys, "n", bits.alias("bits"))
    frequent = F.broadcast(scored.orderBy(F.desc("n"), *keys).limit(head).select(*keys, "bits"))  # head rows
    rare = units.join(frequent.drop("bits"), keys, "left_anti").join(scored.select(*keys, "bits"), keys)
    return units.join(frequent, keys).unionByName(rare)


def series(scored: DataFrame, low: float, prefix: str = "surp:char") -> DataFrame:
    """(doc_id, dim, value): moments, tails, lag-1 autocorrelation and the share of units below `low`."""
    order = Window.partitionBy("doc_id").orderBy("i")
    framed = scored.withColumn("mean", F.avg("bits").over(Window.partitionBy("doc_id"))).withColumn("before", F.lag("bits").over(order))
    off = F.col("bits") - F.col("mean")
    q = F.percentile("bits", F.array(F.lit(0.1), F.lit(0.9)))
    grouped = framed.groupBy("doc_id").agg(
        F.first("mean").alias("mean"), F.coalesce(F.var_samp("bits"), F.lit(0.0)).alias("v"), q.alias("q"), F.sum(off * (F.col("before") - F.col("mean"))).alias("cov"),
        F.sum(off * off).alias("var"), F.avg((F.col("bits") < low).cast("double")).alias("low"),
    )
    return unpivot(grouped, "doc_id", {
        f"{prefix}_mean": F.col("mean"), f"{prefix}_stddev": F.sqrt("v"), f"{prefix}_variance": F.col("v"), f"{prefix}_fano": F.when(F.col("mean") > 0, F.col("v") / F.col("mean")).otherwise(0.0),
        f"{prefix}_p10": F.col("q")[0], f"{prefix}_p90": F.col("q")[1], f"{prefix}_autocorr": F.when(F.col("var") > 1e-9, F.coalesce(F.col("cov"), F.lit(0.0)) / F.col("var")).otherwise(0.0), f"{prefix}_low_share": F.col("low"),
    })


def peaks(scored: DataFrame, k: int) -> DataFrame:
    """(doc_id, rank, i, unit, bits): the k most surprising units of each document, ties by place."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("bits", 9)), "i")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "rank", "i", "unit", "bits")


def low_threshold(scored: DataFrame, share: float = 0.25) -> DataFrame:
    """(low): the bits below which this share of all units of a corpus lies. Units are counted by value first, so that tasks
    exchange a count for each distinct value."""
    counted = scored.groupBy("bits").agg(F.count("*").alias("n"))
    return counted.agg(F.percentile("bits", F.lit(share), F.col("n")).alias("low"))


# A corpus scored by its own model. Documents stay in runs, in which their units stand as numbers of the run's types; types are counted where they meet,
# by context, and the counts go back to the runs. So a unit is no row, and what is exchanged are packed types and counts.

_SERIES = ("mean", "stddev", "variance", "fano", "p10", "p90", "autocorr", "low_share")


#: Bytes of text in a run: the more, the fewer types are in several runs.
SPAN = 1 << 24


def _planes(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the least type that holds them, their first bytes before their second ones, which packs well."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return x.dtype.str, x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """Columns of strings, of whole numbers that are not negative and of lists of these, packed by their parts; others as Arrow has them."""
    out = {}
    for name, x in columns.items():
        if pa.types.is_string(x.type) and not x.null_count:
            sizes = pc.binary_length(x).to_numpy(zero_copy_only=False)
            out[name] = ("strings", _planes(sizes), b"".join(x.cast(pa.binary()).to_pylist()))
        elif name in ("n", "j", "m"):
            out[name] = ("numbers", _planes(x.to_numpy()))
        elif name == "numbers":
            values, offsets = elements(x)
            out[name] = ("lists", _planes(values.to_numpy(zero_copy_only=False)), _planes(np.diff(offsets)))
        else:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([(name, x.type)])) as held:
                held.write_batch(pa.RecordBatch.from_arrays([x], [name]))
            out[name] = ("arrow", sink.getvalue().to_pybytes())
    raw = pickle.dumps(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: pa.Scalar) -> pa.Table:
    raw = blob.as_buffer()
    parts = pickle.loads(pa.decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"), codec="zstd", asbytes=True))

    def numbers(kind: str, planes: bytes) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).tobytes(), kind).astype(np.int64)

    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    out = {}
    for name, (kind, *held) in parts.items():
        if kind == "strings":
            out[name] = pa.StringArray.from_buffers(len(sizes := numbers(*held[0])), ends(sizes).buffers()[1], pa.py_buffer(held[1]))
        elif kind == "numbers":
            out[name] = pa.array(numbers(*held[0]))
        elif kind == "lists":
            out[name] = pa.ListArray.from_arrays(ends(numbers(*held[1])), pa.array(numbers(*held[0])))
        else:
            out[name] = pa.ipc.open_stream(held[0]).read_all().column(0).combine_chunks()
    return pa.table(out)


def _lower() -> Column:
    return F.lower(F.coalesce("text", F.lit("")))


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a run of texts, the number of each token's word, and how many tokens each text has."""
    points, begins = code_points(texts)
    starts, stops, sizes = tokens_of(points, begins)
    held = words_of(points, starts, stops).dictionary_encode()
    return held.dictionary, held.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes


def _types_of(docs: DataFrame, buckets: int, carry: tuple[str, ...] = (), sequences: bool = True, units: bool = False) -> DataFrame:
    """(bucket, run, blob): of each run of documents its types (context, unit, n) in `buckets` by context, and in a further bucket its documents with the
    numbers of their units' types, in the order in which the buckets have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(runs(batches, size=SPAN)):
            at = (TaskContext.get().partitionId() << 32) + k
            words, codes, sizes = _coded(batch.column(1))
            ends = np.cumsum(sizes)
            paired = np.ones(max(0, len(codes) - 1), bool)  # not over the end of a text
            paired[ends[(ends > 0) & (ends < len(codes))] - 1] = False
            bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words.to_pylist()), np.int64, len(words))
            place = np.empty(len(words), np.int64)  # of contexts: by bucket, then by name, so that blobs pack well
            place[np.lexsort((pc.rank(words).to_numpy(), bucket))] = np.arange(len(words))
            keys = place[codes[:-1][paired]] * max(1, len(words)) + codes[1:][paired]
            types, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            context, unit = np.argsort(place)[types // max(1, len(words))], types % max(1, len(words))
            edges = np.searchsorted(bucket[context], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                rows.append((int(b), _packed({"context": words.take(pa.array(context[part])), "unit": words.take(pa.array(unit[part])), "n": pa.array(counts[part])})))
            if sequences:
                lengths = np.maximum(sizes - 1, 0)
                numbers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(inverse, pa.int32()))
                held = {f: batch.column(f) for f in ("doc_id", *carry)} | {"numbers": numbers}
                rows.append((buckets + at % buckets, _packed(held)))
                if units:  # their names, as one row
                    rows.append((2 * buckets + at % buckets, _packed({"unit": words.take(pa.array(unit))})))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "run": pa.array([at] * len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return docs.select("doc_id", _lower().alias("low"), *carry).mapInArrow(run, "bucket int, run long, blob binary")


def _counted(group: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of the types of one bucket, run after run: how many each run has, the counts of each in the corpus and of its context, and its count in its run."""
    held = [_unpacked(x) for x in group.column("blob")]
    all_ = pa.concat_tables(held).combine_chunks()
    context, unit = (all_.column(c).combine_chunks().dictionary_encode() for c in ("context", "unit"))
    c, u = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (context, unit))
    n = all_.column("n").to_numpy()
    inverse = np.unique(c * len(unit.dictionary) + u, return_inverse=True)[1]
    return [len(x) for x in held], np.bincount(inverse, n).astype(np.int64)[inverse], np.bincount(c, n).astype(np.int64)[c], n


def _units(docs: DataFrame) -> int:
    """The number of different words behind another one, plus one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 0):
            words, codes, sizes = _coded(batch.column(0))
            begins = np.cumsum(sizes)[:-1]
            later = np.ones(len(codes), bool)
            later[np.concatenate([[0], begins[begins < len(codes)]])[: len(codes)].astype(np.int64)] = False
            yield pa.RecordBatch.from_arrays([words.take(pa.array(np.unique(codes[later])))], ["unit"])

    return docs.select(_lower().alias("low")).mapInArrow(run, "unit string").distinct().count() + 1


def _buckets(docs: DataFrame) -> int:
    return max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def score_corpus(docs: DataFrame, measure: Callable[[pa.Table, np.ndarray, np.ndarray, pa.Array | None], pa.Table], schema: StructType, carry: tuple[str, ...] = (), units: bool = False, k: float = 0.5) -> DataFrame:
    """What `measure` gives for runs of documents (doc_id, carry...), the ends of their units among all of the run, these units' bits by a model of the
    same documents' words, and with `units` their words. Each row of docs is a document."""
    v, buckets = _units(docs), _buckets(docs)
    kinds = "bucket int, run long, blob binary"

    def count(group: pa.Table) -> pa.Table:
        group = group.sort_by("run")
        if group.column("bucket")[0].as_py() >= buckets:
            return group
        sizes, j, m, _ = _counted(group)
        ends = np.cumsum([0, *sizes])
        blobs = [_packed({"j": pa.array(j[a:b]), "m": pa.array(m[a:b])}) for a, b in zip(ends, ends[1:])]
        return pa.table([group.column("bucket"), group.column("run"), pa.array(blobs, pa.binary())], names=["bucket", "run", "blob"])

    def finish(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")
        kind = group.column("bucket").to_numpy()
        blobs = [_unpacked(x) for x in group.column("blob")]
        counts = pa.concat_tables([x for x, b in zip(blobs, kind) if b < buckets] or [pa.table({"j": pa.array([], pa.int64()), "m": pa.array([], pa.int64())})])
        bits = -np.log2((counts.column("j").to_numpy() + k) / (counts.column("m").to_numpy() + k * v))
        held = next(x for x, b in zip(blobs, kind) if buckets <= b < 2 * buckets)
        numbers, offsets = elements(held.column("numbers").combine_chunks())
        numbers = numbers.to_numpy(zero_copy_only=False)
        names = next(x for x, b in zip(blobs, kind) if b >= 2 * buckets).column("unit").combine_chunks().take(pa.array(numbers)) if units else None
        return measure(held.drop_columns("numbers"), offsets, bits[numbers], names)

    counted = _types_of(docs, buckets, carry, units=units).groupBy("bucket").applyInArrow(count, kinds)
    return counted.groupBy("run").applyInArrow(finish, schema)


def _moments(offsets: np.ndarray, bits: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a unit, and a row of `series` for each."""
    some = np.flatnonzero(np.diff(offsets))
    begins, n = offsets[some], np.diff(offsets)[some]
    if not len(some):
        return some, np.zeros((0, len(_SERIES)))
    total = lambda x: np.add.reduceat(x, begins)
    mean = total(bits) / n
    off = bits - np.repeat(mean, n)
    after = off * np.concatenate([[0.0], off[:-1]])
    after[begins] = 0.0
    squares = total(off * off)
    v = np.where(n > 1, squares / np.maximum(n - 1, 1), 0.0)
    p10, p90 = np.empty(len(some)), np.empty(len(some))
    for i, (a, size) in enumerate(zip(begins, n)):
        held = np.sort(bits[a : a + size])
        for out, q in ((p10, 0.1), (p90, 0.9)):
            at = q * (size - 1)
            lower, upper = math.floor(at), math.ceil(at)
            out[i] = held[lower] + (at - lower) * (held[upper] - held[lower])
    auto = np.where(squares > 1e-9, total(after) / np.maximum(squares, 1e-9), 0.0)
    return some, np.stack([mean, np.sqrt(v), v, np.where(mean > 0, v / np.where(mean > 0, mean, 1), 0.0), p10, p90, auto, total((bits < low).astype(np.float64)) / n], axis=1)


def _rows(ids: pa.Array, values: np.ndarray, names: list[str]) -> pa.Table:
    """(doc_id, dim, value) of a row of values for each id."""
    each = pa.array(np.repeat(np.arange(len(ids)), len(names)))
    return pa.table([ids.take(each), pa.array(names * len(ids), pa.string()), pa.array(values.ravel())], names=["doc_id", "dim", "value"])


def _long(docs: DataFrame) -> StructType:
    return StructType([docs.schema["doc_id"], StructField("dim", StringType()), StructField("value", DoubleType())])


def word_series(docs: DataFrame, low: float, prefix: str = "surp:word") -> DataFrame:
    """series of the words of documents, by a model of these documents."""
    names = [f"{prefix}_{x}" for x in _SERIES]

    def measure(held: pa.Table, offsets: np.ndarray, bits: np.ndarray, _) -> pa.Table:
        some, values = _moments(offsets, bits, low)
        return _rows(held.column("doc_id").combine_chunks().take(pa.array(some)), values, names)

    return score_corpus(docs, measure, _long(docs))


def word_peaks(docs: DataFrame, k: int) -> DataFrame:
    """peaks of the words of documents, by a model of these documents."""

    def measure(held: pa.Table, offsets: np.ndarray, bits: np.ndarray, units: pa.Array) -> pa.Table:
        found, rank, owner = [], [], []
        for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
            order = np.argsort(-np.round(bits[a:b], 9), kind="stable")[:k]
            found.append(order + a), rank.append(np.arange(len(order)) + 1), owner.append(np.full(len(order), i))
        at, rank, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, rank, owner))
        ids = held.column("doc_id").combine_chunks().take(pa.array(owner))
        return pa.table([ids, pa.array(rank, pa.int64()), pa.array(at - offsets[owner] + 1, pa.int64()), units.take(pa.array(at)), pa.array(bits[at])], names=["doc_id", "rank", "i", "unit", "bits"])

    schema = StructType([docs.schema["doc_id"], StructField("rank", LongType()), StructField("i", LongType()), StructField("unit", StringType()), StructField("bits", DoubleType())])
    return score_corpus(docs, measure, schema, units=True)


def word_threshold(docs: DataFrame, share: float = 0.25, k: float = 0.5) -> DataFrame:
    """low_threshold of the words of documents, by a model of these documents: bits are the types', so no unit is looked up."""
    v, buckets = _units(docs), _buckets(docs)

    def count(group: pa.Table) -> pa.Table:
        _, j, m, n = _counted(group)
        pairs, inverse = np.unique(np.stack([j, m], axis=1), axis=0, return_inverse=True)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.bincount(inverse.ravel(), n).astype(np.int64))], names=["j", "m", "n"])

    counted = _types_of(docs, buckets, sequences=False).groupBy("bucket").applyInArrow(count, "j long, m long, n long")
    bits = -F.log2((F.col("j") + k) / (F.col("m") + k * v))
    return counted.groupBy(bits.alias("bits")).agg(F.sum("n").alias("n")).agg(F.percentile("bits", F.lit(share), F.col("n")).alias("low"))


def sentence_punches(docs: DataFrame, least: int = 4) -> DataFrame:
    """devices.punchlines of the words of documents, by a model of these documents: a sentence of n tokens is split at its last inner comma or dash, behind
    `body` of them, 4 at least; its tokens are those after the tokens of the sentences before."""
    each = F.transform(sentence_array(F.col("text")), lambda s: F.struct(F.size(token_array(s)).alias("n"), F.size(token_array(F.regexp_extract(s, r"^(.*)[,;:—–]", 1))).alias("body")))
    split = docs.withColumn("each", each).select("doc_id", "text", F.transform("each", lambda x: x["n"]).alias("sizes"), F.transform("each", lambda x: x["body"]).alias("bodies"))
    names = ["surp:punch_ratio_mean", "surp:punch_spike_rate"]

    def measure(held: pa.Table, offsets: np.ndarray, bits: np.ndarray, _) -> pa.Table:
        sizes, ends = elements(held.column("sizes").combine_chunks())
        n, body = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (sizes, elements(held.column("bodies").combine_chunks())[0]))
        owner = np.repeat(np.arange(len(held)), np.diff(ends))
        start = np.cumsum(n) - n
        start = start - np.concatenate([start, [0]])[np.minimum(ends[:-1], len(start))][owner]
        inside = lambda i: np.clip(i - 1, 0, np.diff(offsets)[owner]) + offsets[:-1][owner]  # noqa: E731  the first token has no bits
        a, c, b = inside(start), inside(start + body), inside(start + n)
        good = (body >= 4) & (body < n) & (a < c) & (c < b)
        owner, a, c, b = owner[good], a[good], c[good], b[good]
        padded = np.append(bits, 0.0)
        sums = np.add.reduceat(padded, np.stack([a, c, b], axis=1).ravel())[: 3 * len(a)].reshape(-1, 3) if len(a) else np.zeros((0, 3))
        low, high = sums[:, 0] / (c - a), sums[:, 1] / (b - c)
        owner, ratio = owner[low > 0], (high / np.where(low > 0, low, 1))[low > 0]
        count = np.bincount(owner, minlength=len(held))
        some = np.flatnonzero(count)
        values = np.stack([np.bincount(owner, ratio, len(held)), np.bincount(owner, ratio > 1.5, len(held))], axis=1)[some] / count[some, None]
        table = _rows(held.column("doc_id").combine_chunks().take(pa.array(some)), values, names)
        enough = pa.array(np.repeat(count[some] >= least, len(names)))
        return table.set_column(2, "value", pc.if_else(enough, table.column("value"), pa.scalar(None, pa.float64())))

    return score_corpus(split, measure, _long(docs), ("sizes", "bodies"))


#: Most character types whose bits are broadcast; those of a corpus with more are joined.
BROADCAST = 1 << 21


def char_series(docs: DataFrame, low: float, order: int = 3, prefix: str = "surp:char", k: float = 0.5, most: int = BROADCAST) -> DataFrame:
    """series of the characters of documents, by a model of these documents."""
    spark, names = docs.sparkSession, [f"{prefix}_{x}" for x in _SERIES]
    between = 0x110000

    def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        points, begins = code_points(texts)
        points = points.copy()
        points[begins - 1] = between
        return points, begins

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 0):
            points, _ = units(batch.column(0))
            letters = np.flatnonzero(np.bincount(points))
            table = np.zeros(letters[-1] + 1, np.int32)
            table[letters] = np.arange(len(letters))
            codes, m = table[points], max(0, len(points) - order + 1)
            rows, counts = different([codes[i : i + m] for i in range(order)], [len(letters)] * order)
            held = letters[rows]
            whole = (held != between).all(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(strings(held[whole]), pa.string()), pa.array(counts[whole], pa.int64())], ["gram", "j"])

    text = docs.select("doc_id", _lower().alias("low"))
    model = text.select("low").mapInArrow(count, "gram string, j long").groupBy("gram").agg(F.sum("j").alias("j")).limit(most + 1).toArrow()  # bounded by `most`
    if len(model) > most:
        held = char_units(docs, order)
        return series(score(held, fit(held), k), low, prefix)
    grams = np.frombuffer("".join(model.column("gram").to_pylist()).encode("utf-32-le"), np.int32).reshape(-1, order)
    j = model.column("j").to_numpy()
    letters, codes = np.unique(grams, return_inverse=True)
    codes = codes.reshape(grams.shape).astype(np.int64)
    #: Of each length from 2 to the order the beginnings of types, as a number of the shorter one and a letter.
    levels, state = [], codes[:, 0]
    for i in range(1, order):
        known, state = np.unique(state * len(letters) + codes[:, i], return_inverse=True)
        levels.append(known)
    context = np.unique(grams[:, :-1], axis=0, return_inverse=True)[1].ravel() if len(grams) else np.zeros(0, np.int64)
    m = np.bincount(context, j)[context]
    v = len(np.unique(grams[:, -1])) + 1
    bits = np.empty(len(grams))
    bits[state] = -np.log2((j + k) / (m + k * v))
    shared = spark.sparkContext.broadcast((letters, levels, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, levels, bits = shared.value
        table = np.zeros(between + 1, np.int64)
        table[letters] = np.arange(len(letters))
        steps = [number_of(known) for known in levels]
        for batch in runs(batches):
            points, begins = units(batch.column(1))
            n = np.maximum(np.diff(begins) - order, 0)
            offsets = np.concatenate([[0], np.cumsum(n)])
            codes = table[points]
            at = np.arange(offsets[-1]) + np.repeat(begins[:-1] - offsets[:-1], n)
            state = codes[at]
            for i, step in enumerate(steps):
                state = step(state * len(letters) + codes[at + i + 1])
            some, values = _moments(offsets, bits[state], low)
            yield from _rows(batch.column(0).take(pa.array(some)), values, names).to_batches()

    return text.mapInArrow(run, _long(docs))
