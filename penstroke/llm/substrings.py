"""Operator 9, suffix-array dedup: every byte covered by a string of LENGTH bytes that also starts earlier goes.

Suffixes are sampled, so that few need sorting. Each window of LENGTH bytes holds the same least GRAM-byte hash
wherever it occurs (the last among equals): its anchor. A window can only repeat if its anchor's gram does, so:

1. anchors of all documents, each with the run of windows it stands for, are dealt by hash; those whose gram occurs once
   are dropped. An occurrence within a batch speaks for all that the batch has of its gram.
2. Anchors left take along the bytes of their windows and are dealt by gram again. Equal ones collapse: the first
   stays, the others are removed whole. For the rest, two suffix arrays, of the bytes from each anchor on and
   of those before it backwards, built by Lyndon-prefix groups over blocks of bytes as symbols, sort the surroundings;
   byte-wise common prefixes of neighbours then class every window by its part before the anchor and its part from the
   anchor on, and a window goes if its class has an earlier member.
3. A gram with more than HOT occurrences (the LISTED most frequent of them, should there be more) has its windows dealt one by
   one, by the hash of the window: the surroundings of a passage common to very many documents never meet in one task.

A document is a doc_id with a text, by 64 bits of hash: rows that share a doc_id (or have none) and differ in text are documents of their
own, in the order of the hashes where their doc_ids tell no order.

Degenerate rows: null and empty texts have no byte; rows with equal doc_id and text (both without doc_id, too) are one document, so they remove nothing from each
other and lose the same bytes; rows without doc_id come before all others; an empty table gives no rows; further columns are kept
by `dedupe`, those named as its results replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import WEIGHTS, byte_view, chunks, drop_shuffles, mix, parallelism, release, row_numbers, settle, table, texts_of
from penstroke.llm.suffixes import suffix_array

LENGTH, GRAM = 100, 32
WINDOWS = LENGTH - GRAM + 1
#: Bytes that can stand before an anchor in its windows.
LEFT = WINDOWS - 1
HOT, LISTED = 2_000, 1_000_000
BUCKET = 400_000
#: Level of compression of blobs.
LEVEL = 3
SCHEMA = "kind int, bucket long, of long, blob binary"

ANCHOR = np.dtype([("key", "<u8"), ("doc", "<i8"), ("of", "<i8"), ("at", "<u4"), ("back", "u1"), ("run", "u1"), ("many", "<u4")])
PLACE = np.dtype([("doc", "<i8"), ("of", "<i8"), ("at", "<u4"), ("back", "u1"), ("run", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("of", "<i8"), ("start", "<u4"), ("end", "<u4")])
AROUND = np.dtype([("key", "<u8"), ("doc", "<i8"), ("of", "<i8"), ("at", "<u4"), ("back", "u1"), ("run", "u1"), ("bytes", "u1", (LEFT + LENGTH,))])
WINDOW = np.dtype([("key", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("of", "<i8"), ("at", "<u4")])


def gram_hashes(flat: np.ndarray, width: int = GRAM, seed: int = 0) -> np.ndarray:
    """Hash of the `width` (a power of two) bytes from each position on."""
    out, k = mix(flat.astype(np.uint64) + WEIGHTS[seed]), 1
    with np.errstate(over="ignore"):
        while k < width:
            out = out[:-k] * WEIGHTS[seed + k.bit_length()] + out[k:] if len(out) > k else out[:0]
            k *= 2
    return mix(out)


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, row, position (in flat) of each anchor, and first and last window it stands for."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    none = np.zeros(0, np.int64)
    if len(flat) < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    hashes = gram_hashes(flat)
    least = (hashes >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    k = 1
    while 2 * k <= WINDOWS:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[: len(least) - (WINDOWS - k)], least[WINDOWS - k :])
    window = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= LENGTH)
    at = (np.uint64(0xFFFFFFFF) - (least[window] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return hashes[at[first]], row_numbers(offsets)[at[first]] if len(first) else none, at[first], window[first], window[last]


def packed(values: np.ndarray) -> bytes:
    """Structured values, compressed: what is shuffled or checkpointed is mostly such blobs. Columns of numbers go byte by byte, texts row by row."""
    flat = values.view(np.uint8).reshape(len(values), values.itemsize)
    numbers = _width(values.dtype)
    data = flat[:, :numbers].T.tobytes() + flat[:, numbers:].tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def unpacked(blob: bytes, shape: np.dtype) -> np.ndarray:
    n, numbers = int.from_bytes(blob[:8], "little"), _width(shape)
    data = np.frombuffer(pa.Codec("zstd").decompress(memoryview(blob)[8:], n * shape.itemsize), np.uint8)
    flat = np.empty((n, shape.itemsize), np.uint8)
    flat[:, :numbers] = data[: n * numbers].reshape(numbers, n).T
    flat[:, numbers:] = data[n * numbers :].reshape(n, shape.itemsize - numbers)
    return flat.view(shape).ravel()


def _width(shape: np.dtype) -> int:
    """Bytes of the columns of numbers, which stand before those of text."""
    return shape.fields["bytes"][1] if "bytes" in shape.names else shape.itemsize


def _deal(kind: int, values: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A packed blob of values for each bucket."""
    if not len(values):
        return
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    values, bucket = values[by], bucket[by]
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(start[1:], len(bucket))
    blobs = [packed(values[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(start), kind, np.int32)), "bucket": bucket[start], "of": np.zeros(len(start), np.int64), "blob": pa.array(blobs, pa.binary())})


def _document(values: np.ndarray) -> np.ndarray:
    """A hash of the document of each place."""
    return mix(values["doc"].astype(np.uint64)) ^ values["of"].astype(np.uint64)


def _read(group: pa.Table, kind: int, shape: np.dtype) -> np.ndarray:
    mine = group.filter(pa.compute.equal(group.column("kind"), kind)).column("blob").to_pylist()
    return np.concatenate([unpacked(b, shape) for b in mine]) if mine else np.zeros(0, shape)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _table(kind: int, values: np.ndarray) -> pa.Table:
    """Rows (kind, doc, of, blob), a blob for each document."""
    values = values[np.lexsort((values["of"], values["doc"]))]
    start = np.flatnonzero(_first_of(values["doc"], values["of"])) if len(values) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(values))
    blobs = [values[a:b].tobytes() for a, b in zip(start.tolist(), ends.tolist(), strict=False)]
    return pa.table({"kind": pa.array(np.full(len(start), kind, np.int32)), "bucket": values["doc"][start], "of": values["of"][start], "blob": pa.array(blobs, pa.binary())})


def repeated_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """kind 0: blobs of places of anchors whose gram occurs again, dealt by document; kind 1: grams with over HOT occurrences, their number in the place of the bucket."""

    def settle_batch(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(found)
        every = every[np.lexsort((every["at"], every["of"], every["doc"], every["key"]))]
        every = every[_first_of(every["key"], every["doc"], every["of"], every["at"])] if len(every) else every
        first = np.flatnonzero(_first_of(every["key"])) if len(every) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(every)))
        every["many"][first] = many
        yield from _deal(0, every[first], every["key"][first], buckets)
        others = np.ones(len(every), bool)
        others[first] = False
        places = np.empty(int(others.sum()), PLACE)
        for name in PLACE.names:
            places[name] = every[name][others]
        yield from _deal(1, places, _document(places), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in chunks(batches, 2):
            flat, offsets = byte_view(texts_of(batch.column(2)))
            key, row, at, low, high = anchors(flat, offsets)
            out = np.zeros(len(key), ANCHOR)
            out["key"], out["at"], out["back"], out["run"] = key, at - offsets[row], at - low, high - low
            out["doc"], out["of"] = (batch.column(k).to_numpy()[row] for k in (0, 1))
            found.append(out)
            held += len(out)
            if held >= 1 << 20:
                yield from settle_batch(found)
                found, held = [], 0
        if held:
            yield from settle_batch(found)

    def meet(group: pa.Table) -> pa.Table:
        every = _read(group, 0, ANCHOR)
        every = every[np.argsort(every["key"], kind="stable")]
        first = np.flatnonzero(_first_of(every["key"])) if len(every) else np.zeros(0, np.int64)
        total = np.add.reduceat(every["many"].astype(np.int64), first) if len(first) else first
        again = np.repeat(total > 1, np.diff(np.append(first, len(every))))
        places = np.empty(int(again.sum()), PLACE)
        for name in PLACE.names:
            places[name] = every[name][again]
        hot = total > HOT
        grams = every["key"][first][hot]
        listed = pa.table({"kind": pa.array([1] * len(grams), pa.int32()), "bucket": pa.array(total[hot], pa.int64()), "of": pa.array(np.zeros(len(grams), np.int64)), "blob": pa.array([g.tobytes() for g in grams], pa.binary())})
        return pa.concat_tables([_dealt(np.concatenate((places, _read(group, 1, PLACE))), buckets), listed])

    return docs.mapInArrow(run, SCHEMA).groupBy("bucket").applyInArrow(meet, SCHEMA)


def by_document(dealt: DataFrame, shape: np.dtype) -> DataFrame:
    """(kind, doc, of, blob): one row for each document, of blobs dealt by document."""

    def merge(group: pa.Table) -> pa.Table:
        return _table(0, np.concatenate([unpacked(b, shape) for b in group.column("blob").to_pylist()]))

    return dealt.groupBy("bucket").applyInArrow(merge, SCHEMA)


def _dealt(values: np.ndarray, buckets: int) -> pa.Table:
    """Packed blobs of values dealt by document."""
    kinds = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("of", pa.int64()), ("blob", pa.binary())])
    return pa.Table.from_batches(list(_deal(0, values, _document(values), buckets)), kinds)


def _window_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of the LENGTH bytes from each position on, of the grams that cover them."""
    grams, n = gram_hashes(flat, seed=20), len(flat) - LENGTH + 1
    out = [np.zeros(max(0, n), np.uint64) for _ in range(2)]
    with np.errstate(over="ignore"):
        for k, shift in enumerate([*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM]):
            for w, total in enumerate(out):
                total += grams[shift : shift + n] * WEIGHTS[40 + 8 * w + k]
    return mix(out[0]), mix(out[1])


def surroundings(held: DataFrame, at: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """Of rows with text in column `at` and places in the last: kind 0 surroundings of anchors, kind 1 spans already known to go, kind 2 windows of hot grams."""
    shared, column_ = held.sparkSession.sparkContext.broadcast(hot), at

    def settle_batch(around: list[np.ndarray], windows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, single = np.concatenate(around), np.concatenate(windows)
        rows = rows[np.lexsort((rows["at"], rows["of"], rows["doc"]))]
        known, other = _first_copies(rows)
        yield from _deal(0, rows[known], rows["key"][known], buckets)
        single = single[np.lexsort((single["at"], single["of"], single["doc"], single["more"], single["key"]))]
        first, later = _first_windows(single)
        yield from _deal(2, single[first], single["key"][first], buckets)
        spans = np.concatenate((_whole_spans(rows[other]), _spans(single[later], single["at"][later], single["at"][later].astype(np.int64) + LENGTH)))
        yield from _deal(1, spans, _document(spans), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around, windows, size = [np.zeros(0, AROUND)], [np.zeros(0, WINDOW)], 0
        for batch in chunks(batches, column_):
            flat, offsets = byte_view(texts_of(batch.column(column_)))
            places = [np.frombuffer(b"".join(x), PLACE) for x in batch.column(batch.num_columns - 1).to_pylist()]
            row = np.repeat(np.arange(len(places)), [len(p) for p in places])
            place = np.concatenate(places)
            at = place["at"] + offsets[row]
            inside = at + GRAM <= offsets[row + 1]  # always, unless hashes of texts collide
            row, place, at = row[inside], place[inside], at[inside]
            key = np.zeros(len(at), np.uint64)
            grams = gram_hashes(flat)
            key[:] = grams[at]
            wide = np.concatenate((np.zeros(LEFT, np.uint8), flat, np.zeros(LENGTH, np.uint8)))
            held_ = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot := shared.value) else np.zeros(len(key), bool)
            cold = np.flatnonzero(~held_)
            low = at - place["back"]
            for a in range(0, len(cold), 1 << 15):
                c = cold[a : a + (1 << 15)]
                out = np.zeros(len(c), AROUND)
                for name in PLACE.names:
                    out[name] = place[name][c]
                out["key"] = key[c]
                column = np.arange(LEFT + LENGTH)
                part = wide[at[c][:, None] + column]
                begin = LEFT - place["back"][c].astype(np.int64)
                part[(column < begin[:, None]) | (column >= (begin + place["run"][c] + LENGTH)[:, None])] = 0
                out["bytes"] = part
                around.append(out)
            warm = np.flatnonzero(held_)
            if len(warm):
                n = place["run"][warm].astype(np.int64) + 1
                start = np.repeat(low[warm], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                one, two = _window_hashes(flat)
                out = np.zeros(len(start), WINDOW)
                out["key"], out["more"], out["doc"], out["of"] = one[start], two[start], np.repeat(place["doc"][warm], n), np.repeat(place["of"][warm], n)
                out["at"] = start - np.repeat(offsets[row[warm]], n)
                windows.append(out)
            size += len(cold) * AROUND.itemsize + sum(len(w) for w in windows[-1:]) * WINDOW.itemsize
            if size >= 24 << 20:
                yield from settle_batch(around, windows)
                around, windows, size = [np.zeros(0, AROUND)], [np.zeros(0, WINDOW)], 0
        if size:
            yield from settle_batch(around, windows)

    return held.mapInArrow(run, SCHEMA)


def _later_places(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which of values, in runs of equals that start where `new`, stand at another place than the first of their run."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    return np.any([values[c] != values[c][first] for c in ("doc", "of", "at")], axis=0)


def _first_windows(single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal windows, and those at a later place."""
    if not len(single):
        return np.zeros(0, bool), np.zeros(0, bool)
    first = _first_of(single["key"], single["more"])
    return first, _later_places(single, first)


def _first_copies(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each group of rows with equal surroundings, by 128 bits of hash, ascending; and of those at a later place."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.ascontiguousarray(rows["bytes"]).view(np.uint64)
    shape = rows["back"].astype(np.uint64) << np.uint64(8) | rows["run"].astype(np.uint64)
    sums = []
    with np.errstate(over="ignore"):
        for seed in (0, 30):
            total = mix(rows["key"] + shape * WEIGHTS[seed])
            for k in range(words.shape[1]):
                total += mix(words[:, k] + WEIGHTS[seed + k + 1]) * WEIGHTS[seed + k + 2]
            sums.append(total)
    by = np.lexsort((sums[1], sums[0]))
    new = _first_of(sums[0][by], sums[1][by])
    return np.sort(by[new]), by[_later_places(rows[["doc", "of", "at"]][by], new)]


def _low(rows: np.ndarray) -> np.ndarray:
    return rows["at"].astype(np.int64) - rows["back"]


def _spans(places: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(places), SPAN)
    out["doc"], out["of"], out["start"], out["end"] = places["doc"], places["of"], start, end
    return out


def _whole_spans(rows: np.ndarray) -> np.ndarray:
    return _spans(rows, _low(rows), _low(rows) + rows["run"] + LENGTH)


def _ranked(rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal-length byte rows by their suffix array, and the common prefix of each with the one before."""
    n, width = rows.shape
    blocks = np.ascontiguousarray(rows).reshape(n * (width // block), block).view(f"V{block}").ravel()
    names = np.unique(blocks, return_inverse=True)[1] + 1
    text = np.zeros((n, width // block + 1), np.int64)  # each row ends with the least symbol
    text[:, :-1] = names.reshape(n, -1)
    found = suffix_array(text.ravel())
    order = found[found % text.shape[1] == 0] // text.shape[1]
    common = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 15):
        differ = rows[order[a : a + (1 << 15)]] != rows[order[a - 1 : a - 1 + len(order[a : a + (1 << 15)])]]
        common[a : a + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def repeats(rows: np.ndarray) -> np.ndarray:
    """Spans of the windows of rows (sorted by place) that an earlier row has too."""
    n = len(rows)
    right, right_common = _ranked(rows["bytes"][:, LEFT:], 20)
    left, left_common = _ranked(rows["bytes"][:, :LEFT][:, ::-1], 17)
    back, run = rows["back"].astype(np.int64), rows["run"].astype(np.int64)
    lowest, highest = np.full(n, 1 << 30), np.full(n, -1)
    right_class, left_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for before in range(WINDOWS):
        mine = np.flatnonzero((before <= back) & (before >= back - run))
        if len(mine) < 2:
            continue
        right_class[right] = np.cumsum(right_common < LENGTH - before)
        left_class[left] = np.cumsum(left_common < before)
        both = right_class[mine] * (n + 1) + left_class[mine]
        by = np.argsort(both, kind="stable")
        later = mine[by[_later_places(rows[["doc", "of", "at"]][mine[by]], _first_of(both[by]))]]
        lowest[later] = np.minimum(lowest[later], before)
        highest[later] = np.maximum(highest[later], before)
    gone = np.flatnonzero(highest >= 0)
    at = rows["at"][gone].astype(np.int64)
    return _spans(rows[gone], at - highest[gone], at - lowest[gone] + LENGTH)


def _meet_surroundings(group: pa.Table, buckets: int) -> pa.Table:
    rows = _read(group, 0, AROUND)
    rows = rows[np.lexsort((rows["at"], rows["of"], rows["doc"]))]
    out = [_read(group, 1, SPAN)]
    if len(rows):
        known, other = _first_copies(rows)
        out.append(_whole_spans(rows[other]))
        rows = rows[known]
        keys, count = np.unique(rows["key"], return_counts=True)
        rows = rows[count[np.searchsorted(keys, rows["key"])] > 1]
    if len(rows):
        out.append(repeats(rows))
    single = _read(group, 2, WINDOW)
    single = single[np.lexsort((single["at"], single["of"], single["doc"], single["more"], single["key"]))]
    if len(single):
        _, later = _first_windows(single)
        out.append(_spans(single[later], single["at"][later], single["at"][later].astype(np.int64) + LENGTH))
    release()
    return _dealt(np.concatenate(out), buckets)


def removed_spans(docs: DataFrame, key: tuple[str, str]) -> DataFrame:
    """(*key, __spans): blobs of SPAN of every document with a byte to remove; key are columns of docs (long, no null) beside text."""
    keyed = docs.select(*key, F.col("text").cast("string").alias("text"))
    total = keyed.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parallelism(docs), total // 30 // BUCKET)
    found = settle(repeated_anchors(keyed, buckets))
    listed = found.where("kind = 1").orderBy(F.desc("bucket"), "blob").limit(LISTED).select("blob")
    hot = np.sort(np.frombuffer(b"".join(r.blob for r in listed.toLocalIterator()), np.uint64))
    drop_shuffles(found)  # of the anchors, which are checkpointed
    places = by_document(found.where("kind = 0"), PLACE).select(F.col("bucket").alias(key[0]), F.col("of").alias(key[1]), F.array("blob").alias("__places"))
    # The join takes all columns of docs, so that the one which applies the spans reuses its exchange of the texts.
    around = surroundings(docs.join(places, [*key]).select(*docs.columns, "__places"), docs.columns.index("text"), hot, buckets)
    met = around.groupBy("bucket").applyInArrow(lambda group: _meet_surroundings(group, buckets), SCHEMA)
    return by_document(met, SPAN).select(F.col("bucket").alias(key[0]), F.col("of").alias(key[1]), F.array("blob").alias("__spans"))


def _keyed(docs: DataFrame, key: tuple[str, str]) -> DataFrame:
    """docs with the two columns that tell documents apart: a doc_id that one row has is enough, and compresses well beside places."""
    doc = F.col("doc_id").cast("long")
    shared = docs.where(doc.isNotNull()).groupBy(doc.alias(key[0])).agg(F.count("*").alias("__n")).where("__n > 1").select(key[0], F.lit(True).alias("__shared"))
    keyed = docs.withColumn(key[0], doc)
    keyed = keyed.join(shared, key[0], "left") if shared.head(1) else keyed.withColumn("__shared", F.lit(False))
    of = F.when(F.col(key[0]).isNull() | F.col("__shared"), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0).cast("long"))
    return keyed.withColumn(key[1], of).withColumn(key[0], F.coalesce(key[0], F.lit(-(2**63)))).select(*docs.columns, *key)


def dedupe(docs: DataFrame) -> DataFrame:
    """All columns of docs, then kept (bytes), n_bytes, n_removed and n_spans."""
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "__doc", "__of", "__shared", "__places", "__spans")
    key = ("__doc", "__of")
    keyed = _keyed(docs, key)
    joined = keyed.join(removed_spans(keyed, key), [*key], "left").select(*docs.columns, "__spans")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at):
            kept, sizes, removed, runs = [], [], [], []
            for text, blobs in zip(texts_of(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                if blobs:
                    spans_ = np.frombuffer(b"".join(blobs), SPAN)
                    np.add.at(edge, np.minimum(spans_["start"], len(data)), 1)
                    np.add.at(edge, np.minimum(spans_["end"], len(data)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(data[~gone].tobytes())
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(gone, prepend=False) & gone).sum()))
            extra = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], "kept", "n_bytes", "n_removed", "n_spans"])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes), "kept binary, n_bytes long, n_removed long, n_spans long"])
    return joined.mapInArrow(run, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
