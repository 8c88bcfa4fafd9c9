"""Alignment against byte sets of tokens, with the tokenizers' own libraries; counts by hand."""

import hashlib
import json
import os
from collections import Counter, defaultdict

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from penstroke.llm import alignment

A, B = alignment.TOKENIZERS
TEXTS = [
    "The quick brown fox", "The quick brown fox", None, "", " ", "  two  spaces\n\n\nand\tlines ", "a", "▁under", "x▁y", "naïve café — “quoted” …", "日本語のテキスト🙂👩‍👩‍👧", "<|endoftext|> </s><s> <unk> <0x41>",
    "don't we'll I'd", "\x00\x01 \x7f", "é" * 400, " " * 50 + "x", "123456 7,890.12", "Ölschü enbe keit. Die ungheit lichst! " * 200, "word " * 3000, "\r\n\r\n", "  wide", "İstanbul ẞ ﬁ ﷺ",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    with open(A, encoding="utf-8") as file:
        spelled = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    return a, spelled, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    a, spelled, b = libraries
    letters = alignment.byte_letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in spelled[i]) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    whole = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if text and b"".join(bytes_a) == whole == b"".join(bytes_b) else ([], [], [], [])


def ends(parts):
    at, out = 0, []
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def expected(libraries, texts):
    links, measured = Counter(), []
    for text in texts:
        ids_a, bytes_a, ids_b, bytes_b = tokens(libraries, text or "")
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        mine = [(i, j) for i, x in zip(ids_a, ends_a, strict=True) for j, y in zip(ids_b, ends_b, strict=True) if x == y] if len(ids_a) < 400 else [(i, dict(zip(ends_b, ids_b, strict=True))[x]) for i, x in zip(ids_a, ends_a, strict=True) if x in set(ends_b)]
        links.update(mine)
        groups, last = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            sides = [[str(i) for i, e in zip(ids, edge, strict=True) if last < e <= cut] for ids, edge in ((ids_a, ends_a), (ids_b, ends_b))]
            groups.append("|".join(map(",".join, sides)))
            last = cut
        measured.append((len(ids_a), len(ids_b), len(groups), mine, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""))
    most = defaultdict(int)
    for (_, j), n in links.items():
        most[j] = max(most[j], n)
    return [(a, b, g, len(m), sum(links[p] == most[p[1]] for p in m), sum(links[p] for p in m), digest) for a, b, g, m, digest in measured]


@pytest.mark.parametrize("head", [alignment.HEAD, 7, 0])
def test_all_columns(spark, libraries, head):
    rows = [(k if k % 5 else None, t, k) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long").withColumnRenamed("n_a", "place").selectExpr("*", "'x' AS n_best", "1 AS pair").repartition(3)
    got = {r.place: r for r in alignment.align(docs, head=head).collect()}
    want = expected(libraries, TEXTS)
    assert len(got) == len(TEXTS) and any(w[0] == 0 for w in want) and any(w[4] < w[3] for w in want)
    for place, row in enumerate(want):
        assert tuple(got[place][c] for c in alignment.RESULTS) == row, TEXTS[place]
        assert got[place].pair == 1 and got[place].doc_id == rows[place][0]


def test_counted_in_pieces(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "COUNTED", 3)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    assert {r.doc_id: tuple(r[c] for c in alignment.RESULTS) for r in alignment.align(docs).collect()} == dict(enumerate(expected(libraries, TEXTS)))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, "", 0, 0)]


def test_long_texts_in_parts(libraries):
    text = " ".join(["", *TEXTS[3:13], "  x", "a  ", *TEXTS[13:], "z  "] * 3).replace("▁", "_")
    whole = libraries[2].encode(text)
    for size in (1, 5, 40):
        assert len(alignment.parts_of(text, size)) > 3 and alignment.encode_b([text], B, size) == [whole]
    marked = "a▁ b ▁c▁▁ d" * 9
    assert alignment.encode_b([marked], B, 2) == [libraries[2].encode(marked)]


def test_overlaps_and_cuts():
    import numpy as np

    a, b, cut_a, cut_b = alignment.owners(np.array([2, 3, 1]), np.array([1, 4, 1]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    assert list(zip(cut_a.tolist(), cut_b.tolist(), strict=True)) == [(1, 1), (2, 2)]


def test_encoder_is_the_file(libraries):
    """Every token spelled by itself, and a sample of all code points, as the JSON's own library has them."""
    a, spelled, _ = libraries
    encoder, spelling = alignment.encoder_a(A)
    letters = alignment.byte_letters()
    for i in range(0, len(spelled), 7):
        word = bytes(letters[c] for c in spelled[i]) if spelled[i] != "<|endoftext|>" else b""
        assert bytes(spelling.joined([i])) == word
    for point in [*range(0x3000), *range(0x3000, 0x110000, 97)]:
        if not 0xD800 <= point < 0xE000:
            text = f"a{chr(point)}b 1{chr(point)}2  {chr(point)} !{chr(point)}\n  {chr(point)}x"
            assert a.encode(text, add_special_tokens=False).ids == encoder.encode_ordinary(text), hex(point)
