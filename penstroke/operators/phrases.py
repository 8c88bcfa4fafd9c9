"""Phrases of packs, all found in one pass: patterns become one trie over tokens, and each token of a text is a place to start from.

A pattern is words, with `*` for one to four tokens, `#` for a number and `{a|b|c d}` for a choice. Patterns that begin alike share the
trie's edges, so the cost of a token is one lookup however many patterns there are, and the depth of what begins there."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstroke.functions.text import token_array

#: Most tokens that `*` stands for.
GAP = 4
#: Digits with separators and one of a few units, or with letters behind them: 3, 40,000, 1.5, 3rd, 20k.
NUMBER = re.compile(r"[0-9](?:[0-9,.%kmb]*|[0-9,.]*[a-z]*)")
ANY, DIGITS = "*", "#"


def elements(pattern: str) -> list[list[list[str]]]:
    """For each element of a pattern, its choices, each a list of words."""
    out = []
    for word in re.findall(r"\{[^}]*\}|\S+", pattern):
        choices = word[1:-1].split("|") if word.startswith("{") else [word]
        out.append([choice.split() for choice in choices])
    if not out or any(not choice for choices in out for choice in choices):
        raise ValueError(f"empty phrase or choice: {pattern!r}")
    return out


def trie(patterns: dict[str, str]) -> dict[str, Any]:
    """Nested dictionaries by token, `*` and `#`; under None the ids of the patterns that end there."""
    root: dict[str, Any] = {}
    for name, pattern in patterns.items():
        ends = [root]
        for choices in elements(pattern):
            reached = []
            for node in ends:
                for choice in choices:
                    at = node
                    for word in choice:
                        at = at.setdefault(word.lower(), {})
                    reached.append(at)
            ends = reached
        for node in ends:
            node.setdefault(None, []).append(name)
    return root


def starting_at(root: dict[str, Any], forms: list[str], start: int) -> dict[str, int]:
    """The patterns that match from a token on, each with its first end."""
    found: dict[str, int] = {}
    open_ = [(start, root)]
    while open_:
        at, node = open_.pop()
        for name in node.get(None, ()):
            found[name] = min(at, found.get(name, at))
        if at < len(forms):
            if forms[at] in node:
                open_.append((at + 1, node[forms[at]]))
            if DIGITS in node and NUMBER.fullmatch(forms[at]):
                open_.append((at + 1, node[DIGITS]))
            if ANY in node:
                open_.extend((k, node[ANY]) for k in range(at + 1, min(at + GAP, len(forms)) + 1))
    return found


def matches(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc_id, id, first, last): tokens at which a pattern begins and first ends, once for each token it can begin at."""
    kind = dict(docs.dtypes)["doc_id"]
    root = trie(patterns)
    shared = docs.sparkSession.sparkContext.broadcast(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value
        begins = None if ANY in root or DIGITS in root else root.keys()
        for batch in batches:
            rows: list[int] = []
            hits: list[tuple[str, int, int]] = []
            for row, forms in enumerate(batch.column(1).to_pylist()):
                for i, form in enumerate(forms):
                    if begins is None or form in begins:
                        for name, end in starting_at(root, forms, i).items():
                            rows.append(row)
                            hits.append((name, i, end - 1))
            names, first, last = zip(*hits, strict=True) if hits else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["doc_id", "id", "first", "last"])

    return docs.select("doc_id", token_array(F.col("text")).alias("forms")).mapInArrow(run, f"doc_id {kind}, id string, first int, last int")
