"""Operator 1, benchmark decontamination: q-gram lemma filtering with banded verification.

Benchmark items are cut to segments of SEGMENT characters, half overlapping (items below that length are
one segment; those below WHOLE_WORDS characters must stand in the text without edits, and begin and end where a word does). A text that holds a segment of m characters with at most k = ERRORS * m edits shares at least
m + 1 - q - k q of its character q-grams, on diagonals (text position less segment position) that spread
over at most k. So q-grams of the text are looked up in the benchmark's; stretches with enough hits for the
least threshold are expanded to hits of single segments; hits are counted in overlapping diagonal bands, and
bands that reach the segment's threshold are verified by banded alignment. Characters are compared in lower
case, white space as a space; q-grams by a byte of each character, alignments by the characters themselves.

The benchmark is the query set: it is read in blocks of at most BLOCK characters, and each block's index
is broadcast and run against all documents.

Degenerate rows: null texts and those shorter than a segment match nothing; null items and items of less than Q
characters, which have no q-gram, are not searched; repeated rows are each reported, and items that share an id are reported as one; empty
tables give no rows; further columns are ignored (or kept by `clean`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import chunks, code_points, mix, row_numbers, table, texts_of

Q, SEGMENT, WHOLE_WORDS, ERRORS = 8, 128, 32, 0.08
BLOCK = 2_000_000
#: Places of q-grams in bands that are counted at once, and the most positions of a run of one q-gram that are counted together.
COUNTED, RUN = 2_000_000, 512


def _lower() -> np.ndarray:
    """Each code point below 0x10000 in lower case, white space as a space."""
    out = np.arange(0x10000, dtype=np.uint32)
    for point in range(0x10000):
        low = chr(point).lower()
        out[point] = 32 if chr(point).isspace() or not point else ord(low) if len(low) == 1 else point
    return out


LOWER = _lower()


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters with a zero after each text, and the start of each text (n + 1)."""
    points, offsets = code_points(texts)
    n = len(offsets) - 1
    out = np.zeros(len(points) + n, np.uint32)
    out[np.arange(len(points)) + row_numbers(offsets)] = np.where(points < 0x10000, LOWER[points & 0xFFFF], points)
    return out, offsets + np.arange(n + 1)


def as_bytes(chars: np.ndarray) -> np.ndarray:
    """One byte for each character: itself below 256, those beyond mixed into 128 to 255."""
    return np.where(chars < 0x100, chars, chars * np.uint32(40503) >> 7 & 0x7F | 0x80).astype(np.uint8)


def _word(chars: np.ndarray) -> np.ndarray:
    """Whether each character belongs to a word: no ASCII sign, space or gap."""
    return (chars >= 128) | ((chars >= 48) & (chars <= 57)) | ((chars >= 97) & (chars <= 122))


def grams(chars: np.ndarray) -> np.ndarray:
    """The Q characters from each position on, packed."""
    out = chars.astype(np.uint64)
    for k in (1, 2, 4):
        out = out[:-k] | out[k:] << np.uint64(8 * k) if len(out) > k else out[:0]
    return out


def segment_index(items: list[tuple[int, str]]) -> list[dict]:
    """One index for each class of segment lengths (8 to 15, 16 to 31, 32 to 63, 64 to 127, 128), with thresholds of its own."""
    classes: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for item, text in items:
        chars, _ = folded(pa.array([text], pa.large_string()))
        m = len(chars) - 1
        if m < Q:
            continue
        size = min(m, SEGMENT)
        for start in sorted({*range(0, m - size + 1, SEGMENT // 2), m - size}):
            classes.setdefault(size.bit_length(), []).append((item, start, chars[start : start + size]))
    out = []
    for segments in classes.values():
        sizes = np.array([len(s) for _, _, s in segments])
        edits = np.where(sizes < WHOLE_WORDS, 0, np.minimum((sizes * ERRORS).astype(np.int64), (sizes - Q) // Q))
        needed = sizes + 1 - Q - edits * Q
        every = np.concatenate([grams(as_bytes(s)) for _, _, s in segments])
        n_grams = sizes - Q + 1
        segment = np.repeat(np.arange(len(segments)), n_grams)
        place = np.arange(len(every)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
        by = np.argsort(every, kind="stable")
        # Consecutive places of one q-gram in a segment are one entry.
        begins, length = _runs(every[by], segment[by], place[by])
        keys, first, count = np.unique(every[by][begins], return_index=True, return_counts=True)
        bits = max(16, int(len(keys) * 32).bit_length())
        sieve = np.zeros(1 << bits, bool)
        sieve[_slot(keys, bits)] = True
        chars = np.zeros((len(segments), int(sizes.max())), np.uint32)
        for row, (_, _, s) in enumerate(segments):
            chars[row, : len(s)] = s
        out.append({
            "item": np.array([i for i, _, _ in segments]), "size": sizes, "edits": edits, "needed": needed, "chars": chars,
            "keys": keys, "first": first, "count": count, "segment": segment[by][begins], "place": place[by][begins], "length": length, "bits": bits, "sieve": sieve,
        })
    return out


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of rows whose last column rises by one while the others stay."""
    *same, counted = columns
    new = np.ones(len(counted), bool)
    new[1:] = (np.diff(counted) != 1) | np.any([c[1:] != c[:-1] for c in same], axis=0)
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, len(counted)))


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


_BASE = 0x9E3779B97F4A7C15


def hashed_windows(chars: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from begins and ends (cut to the text) to 64-bit hashes of the characters between."""
    powers = [np.full(len(chars) + 1, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    with np.errstate(over="ignore"):
        for x in powers:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(chars) * powers[0][:-1])))

    def of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        begin, end = np.clip(begin, 0, len(chars)), np.clip(end, 0, len(chars))
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[begin]) * powers[1][begin]) + (end - begin).astype(np.uint64)

    return of


def _aligned(chars: np.ndarray, begin: np.ndarray, width: int, patterns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Least edits of each pattern in the text from begin on, within `width` diagonals; text ends are free."""
    chars = np.concatenate((np.zeros(width, chars.dtype), chars, np.zeros(patterns.shape[1] + 2 * width, chars.dtype)))
    begin = begin + width
    lane = np.arange(width)
    cost = np.zeros((len(begin), width), np.int32)
    best = np.full(len(begin), 1 << 20, np.int32)
    for i in range(patterns.shape[1]):
        text = chars[np.minimum(begin[:, None] + i + lane, len(chars) - 1)]
        step = cost + (text != patterns[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - lane, axis=1) + lane
        done = sizes == i + 1
        best[done] = cost[done].min(axis=1)
    return best


def _stands_alone(chars: np.ndarray, pattern: np.ndarray, starts: range) -> bool:
    """Whether the pattern stands at one of the starts, and no word goes on at its ends."""
    word = lambda at: 0 <= at < len(chars) and bool(_word(chars[at : at + 1])[0])
    return any(
        np.array_equal(chars[p : p + len(pattern)], pattern) and not (word(p - 1) and word(p)) and not (word(p + len(pattern) - 1) and word(p + len(pattern))) for p in starts
    )


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n[k] rows of each k: k, and 0 to n[k] - 1."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _bands(hit: np.ndarray, at: np.ndarray, part: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Segments and first diagonals of the bands that hold enough of a segment's q-grams, in order of place within each yield.

    A run of one q-gram in the text meets a run of it in a segment on a stretch of diagonals; each band there gets an interval of
    the segment's places, and what counts is how many places the band's intervals cover. Runs are taken in pieces, and pieces
    in groups of bounded size; intervals of a band that goes on behind a group are carried on to the next."""
    step = int(part["edits"].max()) + 1
    begins, length = _runs(at, hit)
    piece, place = _spread(-(-length // RUN))
    position, key = hit[begins][piece] + place * RUN, at[begins][piece]
    length = np.minimum(length[piece] - place * RUN, RUN)
    # Bands of a piece: its diagonals over all entries of its q-gram, at most.
    size = part["count"][key] * ((length + SEGMENT) // step + 3)
    group = np.cumsum(size) // COUNTED
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(position)]
    carried = np.zeros((4, 0), np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own, entry = _spread(part["count"][key[a:b]])
        entry += part["first"][key[a:b]][own]
        p, n = position[a:b][own], length[a:b][own]
        segment, q, m = part["segment"][entry].astype(np.int64), part["place"][entry], part["length"][entry]
        # Diagonals are counted from 2 * SEGMENT on, so that they and their bands are over 0.
        low, high = (p - (q + m - 1) + 2 * SEGMENT) // step - 1, (p + n - 1 - q + 2 * SEGMENT) // step
        own, band = _spread(high - low + 1)
        band += low[own]
        first = band * step - 2 * SEGMENT
        from_ = np.maximum(q[own], p[own] - (first + 2 * step - 1))
        to = np.minimum((q + m - 1)[own], (p + n - 1)[own] - first)
        met = np.concatenate((carried, np.stack([segment[own], band, from_, to])[:, to >= from_]), axis=1)
        # Bands of a segment that end before the next piece begins are whole.
        following = position[b] if b < len(position) else 1 << 62
        whole = met[1] * step - 2 * SEGMENT + 2 * step + part["size"][met[0]] < following
        carried, met = met[:, ~whole], met[:, whole]
        if not met.shape[1]:
            continue
        met = met[:, np.lexsort((met[2], met[0], met[1]))]
        new = np.ones(met.shape[1], bool)
        new[1:] = np.any(met[:2, 1:] != met[:2, :-1], axis=0)
        rank = np.cumsum(new) * (2 * SEGMENT)
        reach = np.maximum.accumulate(met[3] + rank)
        before = np.concatenate(([-1], reach[:-1])) - rank
        fresh = np.maximum(0, met[3] - np.maximum(before, met[2] - 1))
        heads = np.flatnonzero(new)
        enough = np.add.reduceat(fresh, heads) >= part["needed"][met[0][heads]]
        if enough.any():
            segment, band = met[0][heads][enough], met[1][heads][enough]
            yield segment, band * step - 2 * SEGMENT - step


def _verify(
    chars: np.ndarray, starts: np.ndarray, windows: Callable[[np.ndarray, np.ndarray], np.ndarray], segment: np.ndarray, begin: np.ndarray, part: dict, best: dict[tuple[int, int], tuple[int, int]]
) -> None:
    """Align segments in their bands; best gets the least edits of each row and segment, and the first place that has them."""
    step = int(part["edits"].max()) + 1
    middle = np.maximum(begin + 2 * step, 0) + part["size"][segment] // 2
    row = np.searchsorted(starts, middle, "right") - 1
    # What stands around a band decides its alignment: of equal surroundings in a row, the first is enough.
    around = windows(begin - 1, begin + part["chars"].shape[1] + 4 * step + 1)
    _, first = np.unique(mix(around ^ mix(row.astype(np.uint64) << np.uint64(32) | segment.astype(np.uint64))), return_index=True)
    first.sort()
    segment, begin, row = segment[first], begin[first], row[first]
    for a in range(0, len(segment), 4096):
        s, b, r = segment[a : a + 4096], begin[a : a + 4096], row[a : a + 4096]
        # Bands come in order, so none after one without edits is better.
        open_ = np.array([best.get(x, (1, 0))[0] > 0 for x in zip(r.tolist(), s.tolist(), strict=True)], bool)
        s, b, r = s[open_], b[open_], r[open_]
        if not len(s):
            continue
        edits = _aligned(chars, b, 4 * step, part["chars"][s], part["size"][s])
        ok = edits <= part["edits"][s]
        for k in np.flatnonzero(ok & (part["size"][s] < WHOLE_WORDS)).tolist():
            ok[k] = _stands_alone(chars, part["chars"][s[k], : part["size"][s[k]]], range(max(0, int(b[k])), int(b[k]) + 4 * step))
        for x, g, e, p in zip(r[ok].tolist(), s[ok].tolist(), edits[ok].tolist(), b[ok].tolist(), strict=True):
            p = max(0, p + 2 * step - int(starts[x]))
            best[x, g] = min(best.get((x, g), (1 << 20, 0)), (e, p))


def find(texts: pa.Array, index: list[dict]) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) of each verified segment's best band, positions in characters of the row
    (within the band's width)."""
    chars, starts = folded(texts)
    gram, windows = grams(as_bytes(chars)), hashed_windows(chars)
    out = []
    for part in index:
        hit = np.flatnonzero(part["sieve"][_slot(gram, part["bits"])])
        at = np.minimum(np.searchsorted(part["keys"], gram[hit]), len(part["keys"]) - 1)
        real = part["keys"][at] == gram[hit]
        hit, at = hit[real], at[real]
        least, reach = int(part["needed"].min()), int(part["size"].max() + part["edits"].max())
        if len(hit) < least:
            continue
        dense = np.flatnonzero(hit[least - 1 :] - hit[: len(hit) - least + 1] < reach)
        edge = np.zeros(len(hit) + 1, np.int64)
        np.add.at(edge, dense, 1)
        np.add.at(edge, dense + least, -1)
        live = np.cumsum(edge[:-1]) > 0
        hit, at = hit[live], at[live]
        if not len(hit):
            continue
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for segment, begin in _bands(hit, at, part):
            _verify(chars, starts, windows, segment, begin, part, best)
        out += [(r, int(part["item"][g]), e, p, p + int(part["size"][g])) for (r, g), (e, p) in best.items()]
    return out


def indexes(benchmark: DataFrame, block: int = BLOCK) -> Iterator[Broadcast]:
    """Broadcast indexes of the benchmark's blocks, each of about `block` characters at most."""
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block)
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(segment_index([(r.item_id, r.text) for r in mine.collect()]))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_segments, edits, start, end): what a document holds of an item."""
    schema = "doc_id long, item_id long, n_segments long, edits long, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, 1):
                ids = batch.column(0).to_pylist()
                found: dict[tuple[int, int], list] = {}
                for row, item, edits, start, end in find(texts_of(batch.column(1)), shared.value):
                    found.setdefault((row, item), []).append((edits, start, end))
                rows = [(ids[r], i, len(v), min(x[0] for x in v), min(x[1] for x in v), max(x[2] for x in v)) for (r, i), v in found.items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_segments", "edits", "start", "end"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a segment of an item."""
    at = docs.columns.index("text")
    for shared in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, at):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in find(texts_of(batch.column(at)), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
