"""Operator 13, embedding whitening: exact covariance by digit-slice products, then one eigendecomposition.

An entry c becomes the integer floor(64 c) + 1000000. The fit list holds each distinct vector once; it is written to the shared
folder and read three times: tasks sum its dimensions; tasks split the centred integers n x - S into limbs, multiply limb by
limb in float64 without rounding (see `limbs`), and emit the sums, which Spark adds up as integers; and tasks measure the
covariance of the whitened vectors. The driver gets one matrix of integers, whose size depends on the number of dimensions alone,
and finds its eigenvectors to double precision, however far apart the eigenvalues.

Degenerate rows: a null vector, and one that holds a null, NaN or infinite entry, is dropped, and so is a vector whose number of dimensions
is not the table's most frequent one (of ties the larger; vectors without dimensions give no row); 64 c beyond +-2**60 counts as
+-2**60; null, repeated and tied ids each get their rows; without a vector left there are no rows. A component without variance
(fewer independent vectors than components) has null in `whitened`, and where no component has variance (one distinct vector)
`explained` and `identity_error` are null too. Equal eigenvalues leave their components free: any orthonormal choice, the same for
all rows. Further columns are kept by `whiten`, those named as its results replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import shared_folder, table
from penstroke.llm.limbs import BITS, BLOCKS, ROWS, combined, combined_floats, eigen, weighted_products

SCALE, SHIFT, FARTHEST = 64, 1_000_000, 1 << 60
COMPONENTS = 16
#: Entries of vectors that a task works on at once, and fractional bits of the components it projects them on.
ENTRIES, DIGITS = 1 << 20, 100
SUMS = "i int, j int, k int, part long"


class Whitening(NamedTuple):
    """Fitted over `n` distinct vectors: sums of each dimension, unit components as columns (integers with DIGITS fractional bits),
    standard deviations along them (0 for none), shares of the variance, and the error of the whitened covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    spread: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with `__x`, its integer vector, in the place of column; rows that have none are dropped."""
    c = F.col(f"`{column}`").cast("array<double>")
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = vectors.where(F.coalesce(fine, F.lit(False)))
    sizes = held.groupBy(F.size(c).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head(1)
    far = float(FARTHEST)
    x = F.transform(c, lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(far)), F.lit(-far))).cast("long") + SHIFT)
    return held.where(F.size(c) == (sizes[0]["size"] if sizes else 0)).withColumn("__x", x).drop(column)


def blocks_of(column: pa.ListArray, entries: int = ENTRIES) -> Iterator[tuple[int, np.ndarray]]:
    """First row, and rows of a matrix, of at most `entries` entries and ROWS rows."""
    if len(column):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        rows = flat.reshape(len(column), -1)
        step = max(1, min(ROWS, entries // rows.shape[1]))
        for a in range(0, len(rows), step):
            yield a, rows[a : a + step]


def _parts(values: np.ndarray, name: int | None = None) -> Iterator[pa.RecordBatch]:
    """Limbs other than 0 of a matrix of integers (its upper triangle), or of a vector named by i."""
    k, values = 0, values.astype(object)
    j = np.arange(values.shape[-1])
    i = np.full(len(j), name) if name is not None else None
    while np.any(values):
        low = ((values + (1 << 29)) & ((1 << 30) - 1)) - (1 << 29)
        row, at = (i, j) if i is not None else np.triu_indices(len(j))
        part = (low if i is not None else low[row, at]).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"i": row.astype(np.int32), "j": at.astype(np.int32), "k": np.full(len(at), k, np.int32), "part": part})
        values, k = (values - low) >> 30, k + 1


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Integers by (i, j), added up over all tasks: at most a matrix of the dimensions."""
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "k").agg(F.sum("part").alias("part")).collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (r.part << (30 * r.k))
    return out


def dimension_sums(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors, and sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            for _, rows in blocks_of(batch.column(0)):
                n += len(rows)
                # Halves, so that no sum of a block overflows.
                total = total + (rows >> 31).sum(axis=0).astype(object) * (1 << 31) + (rows & ((1 << 31) - 1)).sum(axis=0).astype(object)
        if n:
            yield from _parts(np.array([n], object), 0)
            yield from _parts(total, 1)

    found = _added(fit_list.select("__x").mapInArrow(run, SUMS))
    d = len(fit_list.select("__x").head(1)[0][0]) if found else 0
    return found.get((0, 0), 0), [found.get((1, j), 0) for j in range(d)]


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, in int64 where it fits, else in Python integers."""
    if not len(rows) or n * (int(np.abs(rows).max())) + max(map(abs, sums)) < 1 << 61:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def gram(fit_list: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sum over the fit list of the centred vectors' outer products, exact: n**3 times their covariance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, open_, held = 0, [], 0
        for batch in batches:
            for _, rows in blocks_of(batch.column(0)):
                x = centred(rows, n, sums)
                for k, part in enumerate(weighted_products(x, x)):
                    if k == len(open_):
                        open_.append(np.zeros_like(part))
                    open_[k] += part
                held += 1
                if held == BLOCKS - 1:
                    total, open_, held = total + combined(open_), [], 0
        total = total + combined(open_) if open_ else total
        if isinstance(total, np.ndarray):
            yield from _parts(total)

    out = np.zeros((len(sums),) * 2, object)
    for (i, j), value in _added(fit_list.select("__x").mapInArrow(run, SUMS)).items():
        out[i, j] = out[j, i] = value
    return out


def projected(x: np.ndarray, n: int, components: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Centred vectors along the components, in units of their spread; where that is 0, 0. The products are exact: a vector may be
    very long beside its part along a component."""
    return combined_floats(weighted_products(np.ascontiguousarray(x.T), components)) / (n * 2.0**DIGITS * np.where(spread > 0, spread, np.inf))


def identity_error(fit_list: DataFrame, n: int, sums: list[int], components: np.ndarray, spread: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""
    use = np.flatnonzero(spread > 0)
    if not len(use):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = np.zeros((len(use) + 1, len(use)))
        for batch in batches:
            for _, rows in blocks_of(batch.column(0)):
                z = projected(centred(rows, n, sums), n, components[:, use], spread[use])
                moments[:-1] += z.T @ z
                moments[-1] += z.sum(axis=0)
        i, j = np.indices(moments.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "value": moments.ravel()})

    parts = fit_list.select("__x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    moments = np.zeros((len(use) + 1, len(use)))
    for r in parts.collect():
        moments[r.i, r.j] = r.value / n
    return float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(len(use))).max())


def fit(rows: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """A whitening of rows of `integers`; none without a row."""
    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/whitening-{spark.sparkContext.applicationId}-{uuid.uuid4()}"
    rows.select("__x").distinct().write.parquet(at)
    fit_list = spark.read.parquet(at)
    n, sums = dimension_sums(fit_list)
    if not n:
        return None
    scatter = gram(fit_list, n, sums)
    values, vectors = eigen(scatter)
    total = sum(values)
    # The trace of the matrix itself, at the scale of the values.
    trace = sum(int(scatter[k, k]) for k in range(len(scatter)))
    unit = n**3
    spread = np.sqrt(np.array([v / (unit << (2 * BITS)) for v in values[:count]]))
    explained = [v / (trace << (2 * BITS)) if total else None for v in values[:count]]
    vectors = vectors[:, :count] >> (BITS - DIGITS)
    return Whitening(n, sums, vectors, spread, explained, identity_error(fit_list, n, sums, vectors, spread))


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each row of `integers` and component: its columns (without the vector), then component, n, deviation (decimal),
    whitened, explained and identity_error. A deviation of over 38 digits is null."""
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = [c for c in rows.columns if c not in (*names, "__x")]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, components, spread, explained, error = shared.value
        width = len(spread)
        for batch in batches:
            for a, block in blocks_of(batch.column(batch.num_columns - 1), ENTRIES // 16):
                x, m = centred(block, n, sums), len(block)
                # Squares in int64 where their sum fits.
                small = x.dtype != object and len(sums) * int(np.abs(x).max()) ** 2 < 1 << 62
                deviation = (np.square(x if small else x.astype(object)).sum(axis=1)).tolist()
                z = projected(x, n, components, spread)
                z[:, spread == 0] = np.nan
                repeated = np.repeat(np.arange(m), width)
                columns = [c.take(pa.array(repeated + a)) for c in batch.columns[:-1]]
                decimals = pa.array([v if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
                columns += [
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)), pa.array(np.full(m * width, n)), decimals.take(pa.array(repeated)), pa.array(z.ravel(), from_pandas=True),
                    pa.array(explained * m, pa.float64()), pa.array([error] * (m * width), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return rows.select(*kept, "__x").mapInArrow(run, schema)


def op13_digit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it exceeds a long."""
    rows = integers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whiten(rows, fit(rows)).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
