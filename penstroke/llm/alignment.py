"""Operator 11, cross-tokenizer alignment: two tokenizers' tokens over the same bytes.

A text with a space before it is encoded by A (a byte-level BPE, built from its JSON vocabulary) and B (a piece model, which adds
the space itself). np.repeat spreads token numbers over the bytes they own, for A and for B: a byte where either owner changes begins another
overlapping pair, one where both change is a cut. Cuts divide a text into groups of tokens that cover the same bytes, and
the pair of tokens that end at a cut is a link. Links are counted over all documents; a pair of ids is its B id's best where no other pair of
that B id has more.

Tokens are made once: each document's measures and its pairs go to the shared folder, the counts are added up from there, and a
document's sums are looked up in the HEAD most frequent pairs (a table of bounded size, broadcast) or, beyond those, joined pair by pair.
Pairs outside the head are rare by definition, so no key of the join is hot.

Degenerate rows: null and empty texts, and those whose tokens don't spell their bytes again (a text with U+2581, say), have no tokens
and no links: zeros, and an empty `groups_sha256`; null and repeated doc_ids each get their row, and each repeated text counts; an empty table
gives no rows; long texts are encoded whole; further columns are kept by `align`, those named as its results replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import byte_view, chunks, shared_folder, table, texts_of

#: Pairs that a broadcast holds, 17 bytes each.
HEAD = 1 << 20
#: Distinct pairs that a task adds up before it sends them on.
COUNTED = 1 << 18
#: Bytes of text that a task works on at once (it takes about a hundred times that), and characters that B encodes at once.
CHUNK, PART = 1 << 18, 1 << 16
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
RESULTS = (*MEASURES, "n_best", "count_sum", "groups_sha256")
TOKENIZERS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
#: Splits a text before byte pairs are merged: the rule that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Spelling:
    """The bytes of each id, laid end to end."""

    def __init__(self, spelled: list[bytes | None]) -> None:
        self.size = np.array([len(s or b"") for s in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(s or b"" for s in spelled), np.uint8)
        self.known = np.array([s is not None for s in spelled])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on in order."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@cache
def encoder_a(path: str) -> tuple[Any, Spelling]:
    """An encoder of the JSON file's vocabulary, and its spelling. Ids must be in the order of the merges, as they are where a vocabulary is listed
    as it grew; then the id of a token is its rank."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model, special, letters = found["model"], {t["content"] for t in found["added_tokens"]}, byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
        raise ValueError(f"{path}: ids are not in the order of merges")
    spelled: list[bytes | None] = [None] * (max(model["vocab"].values()) + 1)
    for token, i in ranks.items():
        spelled[i] = token
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), Spelling(spelled)


@cache
def encoder_b(path: str) -> tuple[Any, Spelling]:
    """The piece model, and its spelling; control and unknown pieces have none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(None)
        else:
            spelled.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, Spelling(spelled)


@cache
def can_part(path: str) -> bool:
    """Whether no piece holds a space behind another character: then no token of B spans the begin of a run of spaces."""
    model = encoder_b(path)[0]
    return not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))


_BEHIND = re.compile(r"[^ ▁] ")


def parts_of(text: str, size: int) -> list[str]:
    """The text in parts of about `size` characters that B encodes to the same tokens: each begins behind the first of a run of spaces, which B adds again."""
    out, at = [], 0
    while len(text) - at > size and (found := _BEHIND.search(text, at + size)):
        out.append(text[at : found.end() - 1])
        at = found.end()
    return [*out, text[at:]]


def encode_b(strings: list[str], path: str, size: int = PART) -> list[list[int]]:
    model = encoder_b(path)[0]
    parts = [parts_of(s, size) if len(s) > size and can_part(path) else [s] if s else [] for s in strings]
    found = iter(model.encode([p for x in parts for p in x], num_threads=1))
    return [[i for _ in x for i in next(found)] for x in parts]


@cache
def written(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id below n in decimal behind it a comma, then with a bar, then with a semicolon, filled up to one width; and which bytes count."""
    rows = [f"{i}{end}".encode() for end in ",|;" for i in range(n)]
    width = max(map(len, rows))
    shown = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
    return shown, shown > 0


def _rows(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in ids], np.int64)
    return np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum())), np.concatenate(([0], np.cumsum(sizes)))


def spelled_rows(texts: pa.Array, ids: np.ndarray, edges: np.ndarray, spelling: Spelling) -> np.ndarray:
    """Whether the tokens of each row spell a space and its text."""
    flat, offsets = byte_view(texts)
    n = len(offsets) - 1
    expected = np.full(len(flat) + n, 32, np.uint8)
    starts = offsets + np.arange(n + 1)
    keep = np.ones(len(expected), bool)
    keep[starts[:-1]] = False
    expected[keep] = flat
    sizes = spelling.size[ids]
    ends = np.concatenate(([0], np.cumsum(sizes)))[edges]
    # Rows of another length than expected are told apart before bytes are compared.
    good = np.diff(ends) == np.diff(starts)
    good &= np.diff(np.concatenate(([0], np.cumsum(~spelling.known[ids])))[edges]) == 0
    joined = spelling.joined(ids)
    at = np.repeat(ends[:-1] - starts[:-1], np.diff(starts)) + np.arange(len(expected))
    same = joined[np.minimum(np.maximum(at, 0), len(joined) - 1)] == expected if len(joined) else np.zeros(len(expected), bool)
    return good & (np.diff(np.concatenate(([0], np.cumsum(~same)))[starts]) == 0)


def owners(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens over the same bytes: A and B tokens of each overlapping pair, in order, and A and B tokens that end at each cut."""
    a, b = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
    if not len(a):
        return a, b, a, b
    a_new, b_new = np.diff(a) > 0, np.diff(b) > 0
    begins = np.concatenate(([0], np.flatnonzero(a_new | b_new) + 1))
    ends = np.append(np.flatnonzero(a_new & b_new), len(a) - 1)
    return a[begins], b[begins], a[ends], b[ends]


def encode(texts: pa.Array, paths: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A ids, edges of rows in them, and the same of B; rows that tokens don't spell have none."""
    (a_model, a_spelling), (_, b_spelling) = encoder_a(paths[0]), encoder_b(paths[1])
    strings = texts.to_pylist()
    found = []
    for ids, spelling in (
        ([a_model.encode_ordinary(f" {s}") if s else [] for s in strings], a_spelling), (encode_b(strings, paths[1]), b_spelling),
    ):
        flat, edges = _rows(ids)
        found.append((flat, edges, spelled_rows(texts, flat, edges, spelling)))
    good = found[0][2] & found[1][2] & np.array([bool(s) for s in strings], bool)
    out = []
    for flat, edges, _ in found:
        sizes = np.diff(edges)
        out += [flat[np.repeat(good, sizes)], np.concatenate(([0], np.cumsum(np.where(good, sizes, 0))))]
    return tuple(out)


def aligned(texts: pa.Array, paths: tuple[str, str]) -> dict[str, pa.Array]:
    """Measures of each row, and its linked pairs in order of their numbers, as bytes."""
    a_ids, a_edges, b_ids, b_edges = encode(texts, paths)
    a_size, b_size = encoder_a(paths[0])[1].size, encoder_b(paths[1])[1].size
    _, _, a_cut, b_cut = owners(a_size[a_ids], b_size[b_ids])
    # Rows end at cuts: both have the same bytes. Edges of rows in groups:
    edges = np.searchsorted(a_cut, a_edges)
    # Groups in writing: A tokens, a bar, B tokens, a semicolon. Sort keys put each token at its place.
    group_a, group_b = np.searchsorted(a_cut, np.arange(len(a_ids))), np.searchsorted(b_cut, np.arange(len(b_ids)))
    a_first, b_first = np.concatenate(([0], a_cut + 1))[:-1], np.concatenate(([0], b_cut + 1))[:-1]
    place_a, place_b = np.arange(len(a_ids)) + b_first[group_a], np.arange(len(b_ids)) + (a_cut + 1)[group_b]
    n = max(len(a_size), len(b_size))
    token = np.zeros(len(a_ids) + len(b_ids), np.int64)
    token[place_a], token[place_b] = a_ids, b_ids
    token[place_a[a_cut]] += n
    token[place_b[b_cut]] += 2 * n
    shown, counts = written(n)
    lengths = np.concatenate(([0], np.cumsum(counts.sum(axis=1)[token])))
    line = shown[token][counts[token]]
    begin = lengths[a_edges + b_edges]
    digests = [hashlib.sha256(line[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    rows = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    pair = a_ids[a_cut] * len(b_size) + b_ids[b_cut]
    pair = pair[np.lexsort((pair, rows))].astype(pair_kind(len(a_size), len(b_size)))
    groups = np.diff(edges)
    return {
        "n_a": pa.array(np.diff(a_edges)), "n_b": pa.array(np.diff(b_edges)), "n_groups": pa.array(groups), "n_links": pa.array(groups), "groups_sha256": pa.array(digests, pa.string()),
        "__pairs": pa.array([pair[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()),
    }


def pair_kind(n_a: int, n_b: int) -> np.dtype:
    """Type of a pair's number, A id * n_b + B id."""
    return np.dtype(np.uint32 if n_a * n_b < 1 << 32 else np.int64)


def pairs_in(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all rows, and edges of the rows in them."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind), np.concatenate(([0], np.cumsum([len(b) // kind.itemsize for b in blobs], dtype=np.int64)))


def local_paths(names: tuple[str, str]) -> tuple[str, str]:
    """Paths on this executor: files that Spark has distributed, by their name, or the path as it is."""
    return tuple(SparkFiles.get(n[6:]) if n.startswith("files:") else n for n in names)


def measured(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """All columns of docs but text, then the measures of its alignment, its pairs, and a key for each row."""
    at, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, __pairs binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at, CHUNK):
            found = aligned(texts_of(batch.column(at)), local_paths(paths))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found.values()], names=[*kept, *found])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id())


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(pairs, kind="stable")
    pairs, times = pairs[by], times[by]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


def count_pairs(rows: DataFrame, n_b: int, kind: np.dtype) -> DataFrame:
    """(pair, count, best): links of each pair over all rows, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0
        for batch in chunks(batches, 0):
            found, _ = pairs_in(batch.column(0), kind)
            held.append(found.astype(np.int64))
            counts.append(np.ones(len(found), np.int64))
            size += len(found)
            if size > 2 * COUNTED:
                pairs, times = _summed(np.concatenate(held), np.concatenate(counts))
                held, counts, size = [pairs], [times], len(pairs)
                if size > COUNTED:
                    yield pa.RecordBatch.from_pydict({"pair": pairs, "count": times})
                    held, counts, size = [], [], 0
        if held:
            pairs, times = _summed(np.concatenate(held), np.concatenate(counts))
            yield pa.RecordBatch.from_pydict({"pair": pairs, "count": times})

    counted = rows.select("__pairs").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    # At most one row a pair is left here, so a B id has no more rows than A has ids; the largest count joins back by id.
    most = counted.groupBy((F.col("pair") % n_b).alias("__b")).agg(F.max("count").alias("__most"))
    return counted.join(most, F.col("pair") % n_b == F.col("__b")).select("pair", "count", (F.col("count") == F.col("__most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, kind: np.dtype, head: int = HEAD) -> DataFrame:
    """rows with n_best and count_sum in the place of its pairs."""
    n = counts.count()
    frequent = counts.orderBy(F.desc("count"), "pair").limit(head).orderBy("pair").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("pair", "count", "best")))
    kept, kinds = [c for c in rows.columns if c != "__pairs"], dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in chunks(batches, len(kept)):
            mine, edges = pairs_in(batch.column(len(kept)), kind)
            at = np.searchsorted(pair, mine)
            known = np.append(pair, -1)[at] == mine
            by_row = lambda values: np.diff(np.concatenate(([0], np.cumsum(np.where(known, np.append(values, 0)[at], 0))))[edges])
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(~known)))[edges].astype(np.int32)), pa.array(mine[~known].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(by_row(best.astype(np.int64))), pa.array(by_row(count)), rare], names=[*kept, "n_best", "count_sum", "__rare"])

    looked = rows.select(*kept, "__pairs").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "n_best long, count_sum long, __rare array<long>"]))
    if n <= head:
        return looked.drop("__rare", "__row")
    rare = looked.select("__row", F.explode("__rare").alias("pair")).join(counts, "pair")
    rare = rare.groupBy("__row").agg(F.count_if("best").alias("__best"), F.sum("count").alias("__sum"))
    both = looked.drop("__rare").join(rare, "__row", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("__best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("__sum", F.lit(0))).drop("__row", "__best", "__sum")


def align(docs: DataFrame, paths: tuple[str, str] = TOKENIZERS, head: int = HEAD) -> DataFrame:
    """All columns of docs but text, then RESULTS."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{spark.sparkContext.applicationId}-{uuid.uuid4()}"
    measured(docs.drop(*RESULTS, "__pairs", "__row"), paths).write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    n_a, n_b = (len(spelling.size) for _, spelling in (encoder_a(local_paths(paths)[0]), encoder_b(local_paths(paths)[1])))
    kind = pair_kind(n_a, n_b)
    count_pairs(rows, n_b, kind).write.parquet(f"{folder}/counts")
    return scored(rows, spark.read.parquet(f"{folder}/counts"), kind, head)


def op11_byte_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *RESULTS)
