"""Batches of texts in Arrow stages: runs of rows of a bounded size, and their characters as arrays of code points."""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, or tokens, that are looked at together; a longer text is a run of its own.
RUN = 1 << 22


def runs(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = RUN) -> Iterator[pa.RecordBatch]:
    """The batches cut to runs of rows with about `size` bytes of a string column, or elements of a list column."""
    for batch in batches:
        held = batch.column(column)
        sizes = pc.binary_length(held) if pa.types.is_string(held.type) or pa.types.is_large_string(held.type) else pc.list_value_length(held)
        at = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(batch)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, with a line end before, between and behind them, and where each text begins."""
    joined = "\n" + "\n".join(texts.to_pylist()) + "\n"
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(joined.encode("utf-32-le"), np.int32), np.concatenate([[0], np.cumsum(sizes + 1)]) + 1


def spaced(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """code_points with one space in the place of each run of white space; line ends only stand between texts."""
    white = (points == 32) | ((points >= 9) & (points <= 13))
    between = np.zeros(len(points), bool)
    between[begins - 1] = True
    inner = white & ~between
    keep = ~inner
    keep[1:] |= ~inner[:-1]
    out = np.where(inner, np.int32(32), points)[keep]
    return out, np.cumsum(keep)[begins - 1]


def tokens_of(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lexical tokens (W.TOKEN) of code_points: where each begins and ends, and how many each text has.

    A run of letters, digits and underscores begins a token, unless a mark that joins it stands between it and the run before. A run that is
    joined belongs to that token as far as it is letters and underscores only, or digits only, as its first character; its rest is a token."""
    kind = character_kinds()[points]
    inside = (kind & 3) > 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8)))  # texts begin and end with a line end
    first, last = edges[::2] + 1, edges[1::2] + 1
    if not len(first):
        return first, last, np.zeros(len(begins) - 1, np.int64)
    mark, digit = kind[first - 1], (kind[first] & 3) == 2
    joined = np.concatenate([[False], first[1:] == last[:-1] + 1]) & np.where(digit, mark & 8, mark & 4).astype(bool)
    change = np.flatnonzero(np.diff(((kind & 3) == 2).view(np.int8))) + 1  # where digits begin or end
    after = np.append(change, len(points))[np.searchsorted(change, first, side="right")]
    rest = joined & (after < last)
    starts = np.sort(np.concatenate([first[~joined], after[rest]]))
    stops = np.sort(np.concatenate([last[:-1][~joined[1:]], last[-1:], after[rest]]))
    return starts, stops, np.diff(np.searchsorted(starts, begins))


def words_of(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The strings between places of code_points."""
    sizes = stops - starts
    at = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else starts, sizes)
    held = points[at]
    width = 1 + (held > 0x7F).astype(np.int32) + (held > 0x7FF) + (held > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(held.tobytes().decode("utf-32-le").encode()))


def different(columns: list[np.ndarray], widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of some columns of numbers below widths, and how often each is there."""
    if math.prod(widths) >= 1 << 62:
        return np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    keys = columns[0].astype(np.int32 if math.prod(widths) < 1 << 31 else np.int64)
    for column, width in zip(columns[1:], widths[1:]):
        keys *= width
        keys += column
    keys.sort()
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    rest, rows = keys[edges].astype(np.int64), []
    for width in reversed(widths):
        rows.append(rest % width)
        rest = rest // width
    return np.stack(rows[::-1], axis=1), np.diff(np.append(edges, len(keys)))


def number_of(known: np.ndarray, most: int = 1 << 24) -> Callable[[np.ndarray], np.ndarray]:
    """The places of numbers in a sorted array that has them all, by a table where that has at most so many entries."""
    if len(known) and known[-1] < most:
        table = np.zeros(int(known[-1]) + 1, np.int32)
        table[known] = np.arange(len(known))
        return lambda x: table[x].astype(np.int64)
    return lambda x: np.searchsorted(known, x)


def strings(points: np.ndarray) -> list[str]:
    """The strings of a matrix with a row of code points for each."""
    n = points.shape[1]
    joined = points.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + n] for i in range(0, len(joined), n)]


def elements(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of all lists in a row, and where each list begins and ends in them; a null list is empty."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(lists), np.concatenate([[0], np.cumsum(sizes)])


@cache
def word_characters() -> np.ndarray:
    """For each code point whether it is a letter or a decimal digit."""
    return (character_kinds() & 16) > 0


@cache
def character_kinds() -> np.ndarray:
    """For each code point 1 of letters and underscore, 2 of decimal digits, 4 of marks that join letters to a token and 8 of those that join digits; 16 more
    of letters and digits. At line ends, which code_points puts between texts, all is 0."""
    kinds = [unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)]
    out = np.array([17 if k[0] == "L" else 18 if k == "Nd" else 0 for k in kinds], np.uint8)
    out[ord("_")] = 1
    for c in "'\u2019.:\u00b7":
        out[ord(c)] |= 4
    for c in ",.;'":
        out[ord(c)] |= 8
    return out
