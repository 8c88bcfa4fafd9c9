"""Blobs of places and surroundings: compressed wherever they are shuffled or checkpointed, and read back as they were."""

import random

import numpy as np
import pyarrow as pa
import pytest

from penstroke.llm import substrings
from penstroke.llm.common import byte_view


def anchors_of(n):
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(4000)]
    texts = pa.array([" ".join(rng.choices(words, k=150)) for _ in range(n)], pa.large_string())
    flat, offsets = byte_view(texts)
    key, row, at, low, high = substrings.anchors(flat, offsets)
    out = np.zeros(len(key), substrings.ANCHOR)
    out["key"], out["doc"], out["at"], out["back"], out["run"], out["many"] = key, row, at - offsets[row], at - low, high - low, 1
    return out


@pytest.mark.parametrize("shape", [substrings.ANCHOR, substrings.PLACE, substrings.SPAN, substrings.AROUND, substrings.WINDOW])
@pytest.mark.parametrize("n", [0, 1, 1000])
def test_blobs_are_read_back(shape, n):
    values = np.frombuffer(np.random.default_rng(n).bytes(n * shape.itemsize), shape)
    assert substrings.unpacked(substrings.packed(values), shape).tobytes() == values.tobytes()


def test_dealt_blobs_are_small():
    """Anchors took 16 bytes each after the shuffle's own compression, places 22 in a checkpoint, which has none."""
    every = anchors_of(400)
    places = np.empty(len(every), substrings.PLACE)
    for name in substrings.PLACE.names:
        places[name] = every[name]
    for values, keys, most in ((every, every["key"], 12), (places, substrings._document(places), 7)):
        dealt = pa.Table.from_batches(substrings._deal(0, values, keys, 4))
        assert dealt.num_rows == 4
        assert sum(len(b) for b in dealt.column("blob").to_pylist()) < most * len(values)
