"""Operator 2, substring dedup: sliding spans of sentences.

A text is cut without loss into sentences (a sentence ends after its full stops, question and exclamation marks or line
breaks, and the white space behind them), and those further into pieces after each word that ends with one of CUT: a passage that
begins or ends within a sentence is then seen but for a few words. From each piece on, RUN consecutive pieces, and as
many more as it takes to reach SHORTEST characters, are a run; a text too short for one is a run as a whole. Runs, trimmed piece by
piece, are hashed to 96 bits. The hashes are joined globally, and a piece goes if a run that covers it also starts
earlier: in a smaller doc_id, or earlier in the same document.

Degenerate rows: null and empty texts have no sentence and stay as they are; rows that share a doc_id are one place,
so they remove nothing from each other; an empty table gives no rows; further columns are ignored (or kept by
`dedupe`, which replaces those named as its results). A null doc_id comes before all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import chunks, mix, table, texts_of

RUN, SHORTEST, CUT = 3, 150, "dglmt"
PIECE = rf"[^.!?\n]*?(?:[{CUT}][\x20\x09\x0B-\x0D]+|[.!?\n]+[\x20\x09-\x0D]*)|[^.!?\n]+"
_PIECE = re.compile(PIECE)
_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_UNDO = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)


def pieces(texts: pa.Array) -> tuple[list[list[str]], np.ndarray]:
    """Pieces of each text, and the offsets of the texts in a list of all pieces."""
    cut = [_PIECE.findall(t) for t in texts.to_pylist()]
    return cut, np.concatenate(([0], np.cumsum([len(c) for c in cut], dtype=np.int64)))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def runs_of(texts: pa.Array, run: int = RUN, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each run of a batch: row, first piece and end (numbers within the row), and two 64-bit hashes."""
    cut, offsets = pieces(texts)
    flat = pc.utf8_trim(pa.array([p for c in cut for p in c], pa.large_string()), " \t\n\v\f\r")
    n = len(flat)
    coded = flat.dictionary_encode()
    spelled, at = coded.dictionary.to_numpy(zero_copy_only=False).astype(object), coded.indices.to_numpy()
    ends = np.concatenate(([0], np.cumsum(pc.utf8_length(flat).to_numpy().astype(np.int64) + 1)))
    row = np.repeat(np.arange(len(cut)), np.diff(offsets))
    start = np.arange(n)
    end = np.maximum(start + run, np.searchsorted(ends, ends[:-1] + shortest + 1))
    first = start == offsets[row]
    fits = end <= offsets[row + 1]
    end = np.where(fits, end, offsets[row + 1])
    start, end, row = (x[fits | first] for x in (start, end, row))
    hashes = []
    with np.errstate(over="ignore"):
        for k in range(2):
            named = pd.util.hash_array(spelled, hash_key=f"{k:016d}", categorize=False) if n else np.zeros(0, np.uint64)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(named)[at] * _powers(_BASE[k], n))))
            hashes.append(mix((total[end] - total[start]) * _powers(_UNDO[k], n + 1)[start]).view(np.int64))
    return row, start - offsets[row], end - offsets[row], hashes


def runs(docs: DataFrame, run: int = RUN, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, at, h1, h2) of each run of pieces; `at` is -1 - at where the same row has the run earlier too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            row, at, _, (h1, h2) = runs_of(texts_of(batch.column(1)), run, shortest)
            ids = batch.column(0).to_numpy()[row]
            by = np.lexsort((at, h2, h1, row))
            same = (row[by][1:] == row[by][:-1]) & (h1[by][1:] == h1[by][:-1]) & (h2[by][1:] == h2[by][:-1])
            again = by[1:][same]
            at[again] = -1 - at[again]
            for a in range(0, len(row), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_pydict({"doc_id": ids[b], "at": at[b].astype(np.int32), "h1": h1[b], "h2": h2[b].astype(np.int32)})

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(cut, "doc_id long, at int, h1 long, h2 int")


def repeated_runs(docs: DataFrame, run: int = RUN, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, at, h1) of each run that also starts earlier."""
    every = runs(docs, run, shortest)
    twice = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    held = every.join(twice, ["h1", "h2"])
    at = F.col("at")
    return held.where("doc_id > first OR at < 0").select("doc_id", F.when(at < 0, -1 - at).otherwise(at).alias("at"), "h1")


def dedupe(docs: DataFrame, run: int = RUN, shortest: int = SHORTEST) -> DataFrame:
    """All columns of docs with the covered pieces taken out of text, then n_sentences (pieces) and n_removed."""
    docs = docs.drop("n_sentences", "n_removed", "__doc", "__runs")
    gone = repeated_runs(docs, run, shortest).groupBy("doc_id").agg(F.collect_list(F.struct("at", "h1")).alias("__runs")).withColumnRenamed("doc_id", "__doc")
    joined = docs.join(gone, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) == F.col("__doc"), "left").withColumn("text", F.col("text").cast("string")).select(*docs.columns, "__runs")
    column = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column):
            texts, gone_runs = batch.column(column), batch.column(batch.num_columns - 1)
            cut, offsets = pieces(texts_of(texts))
            listed = np.flatnonzero(pc.list_value_length(gone_runs).fill_null(0).to_numpy())
            edge = np.zeros(int(offsets[-1]) + 1, np.int64)
            if len(listed):
                row, at, end, (h1, _) = runs_of(texts_of(texts.take(pa.array(listed))), run, shortest)
                # Rows of one doc_id share a list; a run counts where its hash is the row's own at that place.
                known = {(k, r["at"], r["h1"]) for k, runs_ in enumerate(gone_runs.take(pa.array(listed)).to_pylist()) for r in runs_}
                hit = np.array([x in known for x in zip(row.tolist(), at.tolist(), h1.tolist(), strict=True)], bool)
                base = offsets[listed[row[hit]]]
                np.add.at(edge, base + at[hit], 1)
                np.add.at(edge, base + end[hit], -1)
            out = np.cumsum(edge[:-1]) > 0
            n = np.diff(np.concatenate(([0], np.cumsum(out)))[offsets])
            kept = texts.to_pylist()
            for k in np.flatnonzero(n).tolist():
                kept[k] = "".join(p for p, gone_ in zip(cut[k], out[offsets[k] : offsets[k + 1]].tolist(), strict=True) if not gone_)
            columns = [*batch.columns[:-1], pa.array(np.diff(offsets)), pa.array(n.astype(np.int64))]
            columns[column] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_sentences", "n_removed"])

    kinds = [f"`{c}` {'string' if c == 'text' else kind}" for c, kind in docs.dtypes]
    return joined.mapInArrow(apply, ", ".join([*kinds, "n_sentences long, n_removed long"]))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
ORACLE = rf"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PIECE}') AS parts FROM documents
), trimmed AS (
  SELECT doc_id, list_transform(parts, lambda s: regexp_replace(s, '{_EDGES}', '', 'g')) AS parts FROM cut WHERE len(parts) > 0
), each AS (
  SELECT doc_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS part FROM trimmed
), summed AS (
  SELECT doc_id, i, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, length(part) + 1 AS size FROM each
), ended AS (
  SELECT s.doc_id, s.i, greatest(s.i + {RUN}, coalesce(e.i, 1000000000) + 1) AS reach
  FROM (SELECT doc_id, i, upto - size + {SHORTEST} + 1 AS target FROM summed) s ASOF LEFT JOIN summed e ON s.doc_id = e.doc_id AND s.target <= e.upto
), runs AS (
  SELECT doc_id, i, least(reach, len(parts)) AS reach, array_to_string(parts[i + 1 : reach], ' ') AS run
  FROM ended JOIN trimmed USING (doc_id) WHERE reach <= len(parts) OR i = 0
), placed AS (
  SELECT doc_id, i, reach, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS place FROM runs
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(i, reach)) AS i FROM placed WHERE place > 1) GROUP BY doc_id
)
SELECT doc_id, len(parts)::BIGINT AS n_sentences, coalesce(len(gone), 0)::BIGINT AS n_removed,
       md5(array_to_string(list_filter(parts, lambda s, i: NOT list_contains(coalesce(gone, []), i - 1)), '')) AS kept_md5
FROM cut LEFT JOIN gone USING (doc_id)
"""
