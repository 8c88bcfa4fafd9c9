"""Corpora of folders, and books from file to chapter files and records."""

import json

import pytest
from pyspark.sql import functions as F

from penstroke.sources import books

BOOK = "junk\n*** START OF THE BOOK ***\nPreface here\n\nCHAPTER I\n\nIt began. [Transcriber's Note: no.]\n\nCHAPTER II\n\nIt went on for some more words.\n\nEnd of Project Gutenberg's Book\n*** END OF THE BOOK ***\nmore junk\n"


def put(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_layouts_of_a_corpus(spark, tmp_path):
    record = lambda text, **more: json.dumps({"text": text, "source": "s"} | more)
    put(tmp_path / "c", {"ann/b.txt": "2", "ann/a.md": "1", "bob.text": "3", "ann.txt": "4", "skip.bin": "x", "more/r.jsonl": record("5", author="bob") + "\n" + record("6", model="m", author="x") + "\n{broken"})
    rows = books.load_corpus(spark, str(tmp_path / "c"), private=True).orderBy("author", "ord").collect()
    assert [(r.author, r.ord, r.text) for r in rows] == [("ann", 1, "1"), ("ann", 2, "2"), ("ann", 3, "4"), ("bob", 1, "3"), ("bob", 2, "5"), ("m", 1, "6")]
    assert all(r.private for r in rows)
    assert [(r.author, r.text) for r in books.load_corpus(spark, str(tmp_path / "c/bob.text")).collect()] == [("bob", "3")]
    assert {r.author for r in books.load_corpus(spark, str(tmp_path / "c/more/r.jsonl")).collect()} == {"bob", "m"}
    put(tmp_path / "e", {"none.bin": "x"})
    for bad in ("e", "e/none.bin"):
        with pytest.raises(ValueError, match="none.bin|nothing to read"):
            books.load_corpus(spark, str(tmp_path / bad))


def test_books_to_files_and_records(spark, tmp_path):
    shelf = spark.createDataFrame([("mark", "/x/The Frog!.txt", BOOK), ("mark", "/x/pg12.txt", "No headings at all."), ("ann", "/y/_.txt", BOOK)], "author string, path string, text string")
    prepared = books.prepare(shelf).orderBy("author", "book", "chapter").collect()
    assert [(r.author, r.book, r.chapter, r.heading, r.text) for r in prepared if r.author == "mark"] == [
        ("mark", "pg12", 1, None, "No headings at all."), ("mark", "the-frog", 1, "CHAPTER I", "It began."), ("mark", "the-frog", 2, "CHAPTER II", "It went on for some more words.")]
    records = books.to_records(books.prepare(shelf)).where("author = 'mark'").orderBy("source", F.col("meta")["chapter"]).collect()
    assert [(r.source, r.register, r.meta) for r in records] == [
        ("gutenberg:mark/pg12", "article", {"book": "pg12", "chapter": "1"}), ("gutenberg:mark/the-frog", "article", {"book": "the-frog", "chapter": "1", "heading": "CHAPTER I"}),
        ("gutenberg:mark/the-frog", "article", {"book": "the-frog", "chapter": "2", "heading": "CHAPTER II"})]
    written = {r.path: r.bytes for r in books.write_chapters(books.prepare(shelf), str(tmp_path / "out")).collect()}
    files = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert set(files) == set(written) == {"mark/pg12-ch01.md", "mark/the-frog-ch01.md", "mark/the-frog-ch02.md", "ann/untitled-ch01.md", "ann/untitled-ch02.md"}
    assert files["mark/the-frog-ch01.md"] == "It began.\n" and all(len(files[p].encode()) == n for p, n in written.items())
    merged = books.prepare(shelf, min_words=4).where("book = 'the-frog'").collect()
    assert [r.chapter for r in merged] == [1] and "It went on" in merged[0].text
