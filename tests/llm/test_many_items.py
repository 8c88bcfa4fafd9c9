"""A block of more short benchmark items than 16 bits number."""

import random

import pyarrow as pa
from penstroke.llm import decontaminate


def short_items(n):
    rng = random.Random(4)
    return [(k, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(34)).replace("  ", "xy").strip().ljust(34, "z")) for k in range(n)]


def test_over_32768_short_items(spark):
    items = short_items(40_000)
    assert sum(len(t) for _, t in items) < decontaminate.BLOCK
    asked = [0, 1, 20_000, 32_767, 32_768, 32_769, 36_000, 39_999]
    texts = [f"Before it 12345. {items[k][1]} And 67890 after it." for k in asked]
    index = decontaminate.segment_index(items)
    assert [len(part["item"]) for part in index] == [40_000]
    found = decontaminate.find(pa.array(texts, pa.large_string()), index)
    assert {(row, item, edits) for row, item, edits, _, _ in found} == {(row, k, 0) for row, k in enumerate(asked)}
    docs = spark.createDataFrame([*enumerate(texts), (100, "nothing of any item 12345 67890 stands in this one")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, bench).collect()} == {(row, k, 0) for row, k in enumerate(asked)}
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [100]
