"""Shared helpers: whole-batch views of text columns and the checkpoint folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Word separators of every contract: space and the controls 9 to 13.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where all runs on one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="penstroke-")


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder.

    Shuffle files of what was cut are deleted once the driver has collected its garbage, so that is asked for."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    del df
    drop_shuffles(out)
    return out


def drop_shuffles(df: DataFrame) -> None:
    """Have the driver collect its garbage, and with it delete the shuffle files that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def parallelism(df: DataFrame, at_least: int = 1) -> int:
    """Shuffle partitions of the session, the knob a deployment sizes to its input."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array that starts at offset 0, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.cast(pa.large_string()).fill_null("")
    if texts.buffers()[2] is None:
        return pa.array([""] * len(texts), pa.large_string())
    # Some kernels misread arrays whose first offset isn't 0.
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), data)


def release() -> None:
    """Give freed memory back to the system: Python workers live on from stage to stage, beside the heap of their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: int | str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to runs of rows of about `size` bytes of a text column: bounds the working arrays."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(lengths) // size
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
        release()


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the n + 1 row offsets into it."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array, and the row offsets into it."""
    flat, offsets = byte_view(texts)
    starts = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))
    points = np.frombuffer(flat.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, starts[offsets]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags within each row."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def row_numbers(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: close integers get unrelated values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


#: Odd multipliers of the positions of a window, of a fixed seed.
WEIGHTS = np.random.default_rng(20240517).integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def windows_hash(ids: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Multilinear 64-bit hash of every run of `width` consecutive ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ids = mix(ids.astype(np.uint64) + np.uint64(seed * 0x632BE5AB + 1))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += ids[k : k + n] * WEIGHTS[k]
    return mix(out)
