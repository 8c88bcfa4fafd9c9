"""Operator 7, n-gram Jaccard join by parity sketches.

A document is its set of word 5-grams. Sets A and B with a Jaccard similarity of 0.8 differ in at most
D = (|A| + |B|) / 9 elements. Each element flips one bit of a wide sketch that is cut into P parts, so
the sketches' Hamming distance, and with it the number of parts that differ, is at most |A - B| + |B - A|.
P is a power of two by the size band, from 0.3 of a band's size (from the whole size below 64, so that P falls once, at
64); a document emits its band's parts and, where a set a quarter larger falls into another band, that band's too. No more
than one edge lies within a quarter, so any set up to a quarter larger is in one of the two bands.

Of its parts that are not empty a document emits the first |A| / 4 + 1 (D is at most |A| / 4). Then the first
part in which both agree is emitted by both: all parts before it that either holds differ, so they are D at most.
Rare elements have a sketch of their own, whose parts come first, and frequent ones another, whose parts follow: an
element flips a bit in one of the two only, so the bound holds for both together, and passages common to many
documents make few keys. The proof needs |A| / 4 + 1 parts; a document with fewer emits those of further sketches of all
its elements, with other hashes, until one has enough.

Keys (hash of a part's bits) travel in blobs dealt by hash, with the hash of the document's set, so that copies meet as one.
Sets with equal keys become candidates: all pairs of a key with up to SMALL sets. In larger keys every set is only compared with
the key's centre (a star), the one with the fewest rare elements. Of each set there is also a parity sketch of two to four
bits an element; its Hamming distance is at most the difference of the sets (a longer sketch folds to a shorter one's length),
so candidates beyond D are dropped by it. The rest are verified on the whole sets.

Stars with a set that is not similar to the centre stay open; pairs within them are joined by what they differ in from
the centre. Let d(x) be the elements in which x and its centre c differ. If x isn't similar to c (9 |d(x)| > |x| + |c|)
but x and y are, then d(x) and d(y) share at least (9 |d(x)| + 9 |d(y)| - |x| - |y|) / 18 elements, and never none. So by the
principle of prefixes each emits only so many of its differing elements, those which few share first, as keys (c, element): of two open
sets each the first |d| + 1 - (9 |d| - |x| + |c|) / 18, rounded; the same number for a set close to c; and an open set, to meet
the close ones (which have 1.25 |x| and 1.25 |c| elements at most), the first |d| + 1 - (9 |d| - |x| - 1.25 min(|x|, |c|)) / 9. Two sets of
a key whose ranks leave too few elements to share are no candidates. Keys with many pairs become stars again, with their least
set as the centre; it comes after c in one order of all sets, so this ends.

Degenerate rows: null and empty texts, and those without words, have no shingle and link with nothing; repeated
rows of a doc_id are taken once (texts that differ under one doc_id: the first by text); rows with a null doc_id are each
returned, with their number of shingles and a null component, and link with nothing; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import SEPARATORS, WEIGHTS, chunks, mix, parallelism, release, settle, table, texts_of, windows_hash
from penstroke.llm.graph import components

WIDTH = 5
#: Least similarity in hundredths. The sketch bounds above hold for 80.
LEAST = 80
#: A shingle is frequent if batches in which more than RATE of the rows (two at least) have it add up to FREQUENT rows; the
#: FREQUENT_KEPT most frequent are kept (16 MB). This only decides what comes first, not what is found.
RATE, FREQUENT, FREQUENT_KEPT = 0.0004, 16, 2_000_000
#: Sets of a key that are all paired; and those of a key of differing elements that are all compared.
SMALL, MANY = 32, 512
#: Keys that one bucket aims to hold.
BUCKET = 400_000
#: Pairs of one document that are verified together.
TOGETHER = 64


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows in one array, and the row offsets into it."""
    n = len(texts)
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    at, words = np.repeat(np.arange(n), pc.list_value_length(pieces).to_numpy(zero_copy_only=False)), pieces.flatten().dictionary_encode()
    spelled = words.dictionary.to_numpy(zero_copy_only=False)
    hashed = pd.util.hash_array(spelled.astype(object), categorize=False) if len(spelled) else np.zeros(0, np.uint64)
    ids = words.indices.to_numpy()
    real = (spelled != "")[ids] if len(ids) else np.zeros(0, bool)
    at, ids = at[real], hashed[ids[real]]
    count = np.bincount(at, minlength=n)
    start = np.flatnonzero(at[: max(0, len(at) - WIDTH + 1)] == at[WIDTH - 1 :])
    rows, hashes = [at[start]], [windows_hash(ids, WIDTH)[start]]
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        for k in range(1, WIDTH):
            short = np.flatnonzero(count == k)
            total = np.full(len(short), k, np.uint64)
            for j in range(k):
                total += mix(ids[first[short] + j]) * WEIGHTS[WIDTH + j]
            rows.append(short)
            hashes.append(mix(total))
    row, found = np.concatenate(rows), np.concatenate(hashes)
    by = np.argsort(row, kind="stable")
    row, found = row[by], found[by]
    edges = np.searchsorted(row, np.arange(n + 1))
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=n))))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def measure(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, n, s1, s2, sketch), size, 128-bit hash and parity sketch of the set; kind 1: (n documents, s1) of a frequent shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen = []
            for batch in chunks([whole], 1):
                found, edges = shingles(texts_of(batch.column(1)))
                seen.append(found)
                row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
                sums = [np.zeros(batch.num_rows, np.uint64) for _ in range(2)]
                with np.errstate(over="ignore"):
                    for k, out in enumerate(sums):
                        np.add.at(out, row, mix(found + WEIGHTS[20 + k]))
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(batch.num_rows, np.int32)), "doc_id": batch.column(0), "n": np.diff(edges), "s1": _signed(sums[0]), "s2": _signed(sums[1]), "sketch": pa.array(sketches(found, edges), pa.binary())})
            every = np.concatenate(seen or [np.zeros(0, np.uint64)])
            every.sort()
            seen, least = None, max(2, int(np.ceil(RATE * whole.num_rows)))
            often = np.flatnonzero(every[least - 1 :] == every[: len(every) - least + 1]) if len(every) >= least else np.zeros(0, np.int64)
            hot = np.unique(every[often])
            n = np.searchsorted(every, hot, "right") - np.searchsorted(every, hot)
            zero = np.zeros(len(hot), np.int64)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(hot), np.int32)), "doc_id": zero, "n": n, "s1": _signed(hot), "s2": zero, "sketch": pa.nulls(len(hot), pa.binary())})

    return docs.mapInArrow(run, "kind int, doc_id long, n long, s1 long, s2 long, sketch binary")


def sketches(found: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: each element flips the bit of its hash modulo the sketch's length."""
    size = np.diff(edges)
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(1, 2 * size)))).astype(np.int64)
    base = np.cumsum(bits) - bits
    row = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        bit = (mix(found + WEIGHTS[28]) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(base[row] + bit, minlength=int(bits.sum())) & 1).astype(np.uint8))
    return [packed[a:b].tobytes() for a, b in zip((base // 8).tolist(), ((base + bits) // 8).tolist(), strict=True)]


def near_sketches(pairs: DataFrame, sets: DataFrame, by: str) -> DataFrame:
    """(kind, a, b, near) of pairs (kind, x, y) named by the column `by` of sets (s1, rep, n, sketch): a and b are reps, and near says
    whether sets of such sizes and sketches can be similar."""
    for side, out in (("x", "a"), ("y", "b")):
        pairs = pairs.join(sets.select(F.col(by).alias(side), F.col("rep").alias(out), F.col("n").alias(f"n_{out}"), F.col("sketch").alias(f"sketch_{out}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            near = (100 * n_a >= LEAST * n_b) & (100 * n_b >= LEAST * n_a)
            for k in np.flatnonzero(near).tolist():
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8) for c in (5, 6))
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                near[k] = int(np.bitwise_count(x ^ y).sum()) <= (n_a[k] + n_b[k]) // 9
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near)], names=["kind", "a", "b", "near"])

    return pairs.where("a != b").select("kind", "a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "kind int, a long, b long, near boolean")


def level(size: np.ndarray) -> np.ndarray:
    """Base-2 logarithm of the number of parts for sets of this size."""
    return np.ceil(np.log2(np.maximum(1, np.where(size < 64, size, 0.3 * size)))).astype(np.int64)


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted list."""
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _orders(found: np.ndarray, edges: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each set, and its place in the order of centres: few rare elements first."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    names = np.zeros(len(edges) - 1, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(names, row, mix(found + WEIGHTS[20]))
    rare = np.bincount(row[~_among(found, hot)], minlength=len(names))
    return names, np.minimum(rare, 0xFFFF).astype(np.uint64) << np.uint64(48) | names >> np.uint64(16)


def part_keys(found: np.ndarray, edges: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of what each set emits."""
    size = np.diff(edges)
    out_row, out_key = [], []
    near, far = level(size), level(size * 5 // 4)
    for rows, power in ((np.flatnonzero(size > 0), near), (np.flatnonzero((size > 0) & (far != near)), far)):
        family, so_far = 0, np.zeros(len(rows), np.int64)
        while len(rows):
            n = size[rows]
            of = np.repeat(np.arange(len(rows)), n)
            element = found[np.repeat(edges[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            if family < 2:  # of rare elements, then of frequent ones, then of all
                mine = _among(element, hot) == (family == 1)
                of, element = of[mine], element[mine]
            else:
                so_far[:] = 0
            parts = np.int64(1) << power[rows]
            base = np.cumsum(parts) - parts
            with np.errstate(over="ignore"):
                bit = mix(element + WEIGHTS[30 + family % 16] * np.uint64(family + 1))
            part = (bit >> np.uint64(40)).astype(np.int64) & (parts[of] - 1)
            slot = base[of] + part
            parity = np.zeros(int(parts.sum()), np.uint64)
            np.bitwise_xor.at(parity, slot, mix(bit))
            held = np.flatnonzero(np.bincount(slot, minlength=len(parity)))
            owner = np.searchsorted(base, held, "right") - 1
            rank = np.arange(len(held)) - np.searchsorted(owner, np.arange(len(rows)))[owner] + so_far[owner]
            first = rank <= n[owner] // 4
            held, owner = held[first], owner[first]
            with np.errstate(over="ignore"):
                name = (held - base[owner]).astype(np.uint64) | power[rows][owner].astype(np.uint64) << np.uint64(40) | np.uint64(family) << np.uint64(48)
                out_key.append(mix(parity[held] ^ mix(name)))
            out_row.append(rows[owner])
            so_far += np.bincount(owner, minlength=len(rows))
            short = so_far < n // 4 + 1
            rows, so_far = rows[short], so_far[short]
            family += 1
    return np.concatenate(out_row or [np.zeros(0, np.int64)]), np.concatenate(out_key or [np.zeros(0, np.uint64)])


KEY = np.dtype([("key", "<u8"), ("set", "<u8"), ("order", "<u8")])
#: An element in which a set (id, of n elements) and its centre differ, by rank of d in all; role: see `delta_keys`.
DELTA = np.dtype([("key", "<u8"), ("id", "<i8"), ("order", "<u8"), ("n", "<u4"), ("d", "<u4"), ("rank", "<u4"), ("role", "u1")])


def _blobs(values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, blob) of values with a key."""
    bucket = ((values["key"] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    values, bucket = values[by], bucket[by]
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(start[1:], len(bucket))
    return pa.RecordBatch.from_pydict({"bucket": bucket[start], "blob": pa.array([values[a:b].tobytes() for a, b in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary())})


def deal(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, blob of KEY): keys of all sets; a set that came before in the batch emits nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            known, rows, held = set(), [], 0
            for batch in chunks([whole], 1):
                found, edges = shingles(texts_of(batch.column(1)))
                row, key = part_keys(found, edges, shared.value)
                names, order = _orders(found, edges, shared.value)
                fresh = np.zeros(batch.num_rows, bool)
                for k, value in enumerate(names.tolist()):
                    if value not in known:
                        known.add(value)
                        fresh[k] = True
                row, key = row[fresh[row]], key[fresh[row]]
                out = np.empty(len(key), KEY)
                out["key"], out["set"], out["order"] = key, names[row], order[row]
                rows.append(out)
                held += len(out)
                if held >= 1 << 20:
                    yield _blobs(np.concatenate(rows), buckets)
                    rows, held = [], 0
            if held:
                yield _blobs(np.concatenate(rows), buckets)

    return docs.mapInArrow(run, "bucket long, blob binary")


def _grouped(group: pa.Table, shape: np.dtype, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of a bucket by key and order, the first of each key, and how many a key has."""
    values = np.concatenate([np.frombuffer(blob.as_buffer(), shape) for blob in group.column("blob")])
    values = values[np.lexsort((values[name], values["order"], values["key"]))]
    new = np.ones(len(values), bool)
    new[1:] = (values["key"][1:] != values["key"][:-1]) | (values[name][1:] != values[name][:-1])
    values = values[new]
    first = np.flatnonzero(np.concatenate(([True], values["key"][1:] != values["key"][:-1])))
    return values, first, np.diff(np.append(first, len(values)))


def _pairs(pairs: list[tuple[np.ndarray, np.ndarray]], stars: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """kind 0: distinct candidates (x, y), x < y; kind 1: distinct stars, of centre x and member y."""
    out = []
    for kind, found in enumerate((pairs, stars)):
        x, y = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in found)]) for k in (0, 1))
        x, y = (x, y) if kind else (np.minimum(x, y), np.maximum(x, y))
        both = np.unique(np.stack((x, y)), axis=1)
        out.append(pa.table({"kind": pa.array(np.full(both.shape[1], kind, np.int32)), "x": both[0], "y": both[1]}))
    release()
    return pa.concat_tables(out)


def meet(dealt: DataFrame, small: int = SMALL) -> DataFrame:
    """(kind, x, y): pairs and stars of the keys of each bucket, of sets named by their hash."""

    def run(group: pa.Table) -> pa.Table:
        values, first, n = _grouped(group, KEY, "set")
        few, names = np.repeat(n <= small, n), _signed(values["set"])
        pairs = []
        for step in range(1, min(small, int(n.max(initial=0)))):
            at = np.flatnonzero((values["key"][step:] == values["key"][:-step]) & few[step:])
            pairs.append((names[at], names[at + step]))
        centre = np.repeat(first, n)
        star = np.flatnonzero(~few & (np.arange(len(values)) != centre))
        return _pairs(pairs, [(names[centre[star]], names[star])])

    return dealt.groupBy("bucket").applyInArrow(run, "kind int, x long, y long")


def delta_keys(centre: np.ndarray, held: np.ndarray, name: int, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of the elements in which a set and its centre differ, with roles as bits: 1 for an open set that meets open ones,
    2 for one that meets close ones, 4 for a close set."""
    more, less = np.setdiff1d(held, centre, True), np.setdiff1d(centre, held, True)
    element = np.concatenate((more, less))
    frequent = _among(element, hot)
    # Elements that only this set has, or lacks, before those that most members differ from the centre in.
    kind = np.where(np.arange(len(element)) < len(more), 2 * frequent, 3 - 2 * frequent)
    element = element[np.lexsort((mix(element), kind))]
    d, n, c = len(element), len(held), len(centre)
    same = d + 1 - max(1, (9 * d - n + c) // 18 + 1)
    rank = np.arange(d)
    if 9 * d > n + c:
        close = d + 1 - max(1, -((n + 5 * min(n, c) // 4 - 9 * d) // 9))
        role = (rank < same) * 1 | (rank < close) * 2
    else:
        role = (rank < same) * 4
    out = np.empty(int((role > 0).sum()), DELTA)
    with np.errstate(over="ignore"):
        out["key"] = mix(element[role > 0] ^ mix(np.array([name], np.int64).view(np.uint64)))
    out["role"], out["rank"], out["n"], out["d"] = role[role > 0], rank[role > 0], n, d
    return out, d


def can_share(d: np.ndarray, n: np.ndarray, rank: np.ndarray, role: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether similar sets i and j, of roles that meet, can have these ranks for the first differing element that they share."""
    meets = (role[i] & role[j] & 1 > 0) | (role[i] & 2 > 0) & (role[j] & 4 > 0) | (role[i] & 4 > 0) & (role[j] & 2 > 0)
    return meets & (9 * (d[i] + d[j]) - n[i] - n[j] <= 18 * np.minimum(d[i] - rank[i], d[j] - rank[j]))


def meet_deltas(dealt: DataFrame, many: int = MANY) -> DataFrame:
    """(kind, x, y): pairs and stars of the keys of each bucket, of doc_ids. The sets of a key are compared if its open sets make no
    more than many / 2 pairs a member; otherwise the key is a star."""

    def run(group: pa.Table) -> pa.Table:
        values, first, n = _grouped(group, DELTA, "id")
        role, ids = values["role"], np.ascontiguousarray(values["id"])
        count = [np.add.reduceat((role & bit > 0).astype(np.int64), first) if len(first) else first for bit in (1, 2, 4)]
        few = count[0] * (count[0] - 1) // 2 + count[1] * count[2] <= many // 2 * n
        d, size, rank = (values[c].astype(np.int64) for c in ("d", "n", "rank"))
        pairs = []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            meets = can_share(d, size, rank, role, i, j)
            pairs.append((ids[i[meets]], ids[j[meets]]))

        after = np.repeat(first + n, n)  # where a key ends
        left = np.flatnonzero(np.repeat(few & (n <= many), n))
        for step in range(1, many):
            left = left[left + step < after[left]]
            if not len(left):
                break
            add(left, left + step)
        for g in np.flatnonzero(few & (n > many)).tolist():
            every = np.arange(first[g], first[g] + n[g])
            for i in every[role[every] & 3 > 0].tolist():
                others = every[every != i]
                add(np.full(len(others), i), others)
        centre = np.repeat(first, n)
        star = np.flatnonzero(~np.repeat(few, n) & (np.arange(len(values)) != centre))
        return _pairs(pairs, [(ids[centre[star]], ids[star])])

    return dealt.groupBy("bucket").applyInArrow(run, "kind int, x long, y long")


def side_by_side(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(bucket, a, salt, id, elements): the sets of pairs (a, b), where those of one `a` are dealt over groups (a, salt) of about TOGETHER,
    to each of which the set of `a` goes once; a bucket holds whole groups. Where an `a` has many groups, they are listed in rows of 256."""
    ways = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("ways"))
    dealt = pairs.join(ways, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("ways"))).drop("ways")
    buckets = max(parallelism(docs), pairs.count() // 1000)
    own = dealt.select(F.col("a").alias("doc_id"), "a", "salt").distinct()
    to = dealt.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(-1).cast("long").alias("part")).union(own.withColumn("part", F.floor(F.col("salt") / 256)))
    targets = to.groupBy("doc_id", "part").agg(F.collect_list(F.struct("a", "salt")).alias("targets"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, 1 << 19):
            found, edges = shingles(texts_of(batch.column(1)))
            target = batch.column(2)
            n = pc.list_value_length(target).to_numpy(zero_copy_only=False)
            a, salt = (target.flatten().field(k).to_numpy() for k in (0, 1))
            row = np.repeat(np.arange(batch.num_rows), n)
            blobs = pa.array([found[x:y].tobytes() for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False)], pa.binary())
            with np.errstate(over="ignore"):
                bucket = (mix(a.astype(np.uint64) + mix(salt.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            for at in range(0, len(row), 1 << 12):
                part = slice(at, at + (1 << 12))
                yield pa.RecordBatch.from_pydict({"bucket": bucket[part], "a": a[part], "salt": salt[part], "id": batch.column(0).take(pa.array(row[part])), "elements": blobs.take(pa.array(row[part]))})

    return docs.join(targets, "doc_id").select("doc_id", "text", "targets").mapInArrow(send, "bucket long, a long, salt long, id long, elements binary")


def _sets_of(group: pa.Table) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """(a, its set, b, its set) of each pair in a bucket."""
    a, salt, ids = (group.column(k).to_numpy() for k in ("a", "salt", "id"))
    elements = group.column("elements").combine_chunks()
    mine, of = None, None
    for k in np.lexsort((ids != a, salt, a)).tolist():
        held = np.frombuffer(elements[k].as_buffer(), np.uint64)
        if ids[k] == a[k]:
            mine, of = held, a[k]
        elif of == a[k]:
            yield int(of), mine, int(ids[k]), held


def verify(pairs: DataFrame, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def check(group: pa.Table) -> pa.Table:
        kept = []
        for a, mine, b, held in _sets_of(group):
            both = np.concatenate((mine, held))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= least * (len(both) - shared):
                kept.append((a, b))
        release()
        return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([y for _, y in kept], pa.int64())})

    return side_by_side(pairs, docs).groupBy("bucket").applyInArrow(check, "a long, b long")


def deltas(stars: DataFrame, docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(bucket, blob of DELTA): what the members b of stars differ in from their centres a."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    buckets = max(parallelism(docs), stars.count() * 64 // BUCKET)

    def emit(group: pa.Table) -> pa.Table:
        out, rows, held_ = [], [np.zeros(0, DELTA)], 0
        for a, mine, b, held in _sets_of(group):
            keys, _ = delta_keys(mine, held, a, shared.value)
            keys["id"], keys["order"] = b, _orders(held, np.array([0, len(held)]), shared.value)[1][0]
            rows.append(keys)
            held_ += len(keys)
            if held_ >= 1 << 20:
                out.append(_blobs(np.concatenate(rows), buckets))
                rows, held_ = [np.zeros(0, DELTA)], 0
        out.append(_blobs(np.concatenate(rows), buckets))
        release()
        return pa.Table.from_batches(out)

    return side_by_side(stars, docs).groupBy("bucket").applyInArrow(emit, "bucket long, blob binary")


def one_text(docs: DataFrame, measured: DataFrame) -> DataFrame | None:
    """docs with the first text by order of each doc_id that has several different sets; None if there is none such."""
    shape = F.struct("n", "s1", "s2")
    odd = measured.where("kind = 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(shape).alias("low"), F.max(shape).alias("high")).where("low != high").select("doc_id")
    if not odd.head(1):
        return None
    first = docs.join(odd, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(odd, "doc_id", "left_anti").select("doc_id", "text").unionByName(first)


def similar(docs: DataFrame, small: int = SMALL, many: int = MANY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; docs has doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = settle(measure(docs))
    if (single := one_text(docs, measured)) is not None:
        return similar(single, small, many)
    nameless, docs = measured.where("kind = 0 AND doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    frequent = measured.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s1").limit(FREQUENT_KEPT)
    hot = np.sort(np.array([r.s1 for r in frequent.select("s1").toLocalIterator()], np.int64).view(np.uint64))
    sizes = measured.where("kind = 0 AND doc_id IS NOT NULL").select("doc_id", "n", "s1", "s2", "sketch").dropDuplicates(["doc_id"])
    sets = settle(sizes.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "sketch")).alias("least")).select("n", "s1", "s2", F.col("least.doc_id").alias("rep"), F.col("least.sketch").alias("sketch")))
    total = measured.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    buckets = max(parallelism(docs), total // 3 // BUCKET)

    met = meet(deal(docs, hot, buckets), small).distinct()
    now = settle(near_sketches(met, sets, "s1"))
    links = settle(verify(now.where("near").select("a", "b").distinct(), docs))
    stars = settle(now.where("kind = 1").select("a", "b").distinct())
    fresh = stars
    while True:
        # Centres with open members; those without a fresh one have been through this.
        open_ = stars.join(links, ["a", "b"], "left_anti").select("a").distinct().join(fresh.select("a").distinct(), "a", "left_semi")
        group = settle(stars.join(open_, "a", "left_semi"))
        if not group.head(1):
            break
        met = meet_deltas(deltas(group, docs, hot), many).distinct()
        now = settle(near_sketches(met, sets, "rep"))
        fresh = settle(now.where("kind = 1").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"))
        links = settle(links.union(verify(now.where("near").select("a", "b").distinct().join(links, ["a", "b"], "left_anti"), docs)))
        stars = settle(stars.union(fresh))

    reps = sizes.join(sets.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    placed = reps.join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    return placed.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).union(nameless.select("doc_id", "n", F.lit(None).cast("long")))


def op7_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
