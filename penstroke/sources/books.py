"""Corpora of folders, and books: read, prepared, cut to chapters, and kept as records or as a file a chapter."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstroke.functions.clean import EDGES, strip_licence
from penstroke.functions.ingest import strip_editorial
from penstroke.sources.records import chapters, read_records, split_bad, to_corpus

TEXTS = ("txt", "md", "text")


def slug(path: Column) -> Column:
    """A file's name without folder and ending, in lower case, with dashes for all that is no letter or digit."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    dashed = F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", "untitled").otherwise(dashed)


def load_corpus(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """(author, ord, path, text, private) of a file or folder. In a folder, an author is a folder below it, whose texts come first, else a text's own
    name; JSON lines (*.jsonl) anywhere add their records by author. ord numbers an author's texts by path. Nothing to read is an error."""
    root = path.rstrip("/")
    single = "." in root.rsplit("/", 1)[-1]
    wants = lambda ending: (root.rsplit(".", 1)[-1] in ending) if single else True
    parts = []
    if wants(TEXTS):
        options = {} if single else {"recursiveFileLookup": True, "pathGlobFilter": "*.{" + ",".join(TEXTS) + "}"}
        files = spark.read.text(root, wholetext=True, **options).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        inner = F.col("path") if single else F.substring_index(F.col("path"), f"/{root.rsplit('/', 1)[-1]}/", -1)
        folder = F.lit(False) if single else F.contains(inner, F.lit("/"))
        own = F.regexp_replace(F.substring_index(inner, "/", -1), r"(?<=.)\.[^.]*$", "")
        parts.append(files.select(F.when(folder, F.substring_index(inner, "/", 1)).otherwise(own).alias("author"), (~folder).alias("loose"), "path", F.lit(0).cast("long").alias("line"), "text"))
    if wants(("jsonl",)):
        good, _ = split_bad(read_records(spark, root, "" if single else "*.jsonl"))
        lined = to_corpus(good).select("author", F.lit(True).alias("loose"), F.coalesce("source", F.lit("")).alias("path"), F.monotonically_increasing_id().alias("line"), "text")
        parts.append(lined)
    if not parts:
        raise ValueError(f"{path}: neither text nor JSON lines")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not every.head(1):
        raise ValueError(f"{path}: nothing to read")
    order = Window.partitionBy("author").orderBy("loose", "path", "line")
    return every.withColumn("ord", F.row_number().over(order)).select("author", "ord", "path", "text", F.lit(private).alias("private"))


def prepare(books: DataFrame, min_words: int = 0) -> DataFrame:
    """(author, book, chapter, heading, text) of books (author, path, text): licence and editorial notes taken out, cut at headings, short chapters
    merged."""
    named = books.select("author", F.concat_ws("/", "author", slug(F.col("path"))).alias("book"), F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"))
    bare, _ = strip_licence(F.col("text"))
    clean = named.withColumn("text", bare).withColumn("text", strip_editorial(F.col("text"))["text"])
    cut = chapters(clean.select("book", "text"), min_words)
    return cut.select(F.substring_index("book", "/", 1).alias("author"), F.substring_index("book", "/", -1).alias("book"), "chapter", "heading", F.regexp_replace("text", EDGES, "").alias("text"))


def to_records(prepared: DataFrame, source: str = "gutenberg") -> DataFrame:
    """A record (text, author, source, register, meta) for each chapter."""
    meta = F.map_filter(F.create_map(F.lit("book"), F.col("book"), F.lit("chapter"), F.col("chapter").cast("string"), F.lit("heading"), F.col("heading")), lambda _, v: v.isNotNull())
    return prepared.select("text", "author", F.concat(F.lit(f"{source}:"), "author", F.lit("/"), "book").alias("source"), F.lit("article").alias("register"), meta.alias("meta"))


def write_chapters(prepared: DataFrame, folder: str) -> DataFrame:
    """Write folder/author/book-chNN.md for each chapter, and return (path, bytes) of the files. The folder is one that all executors share; a task that runs again
    writes the same files."""
    rows = prepared.select(F.concat("author", F.lit("/"), "book", F.lit("-ch"), F.lpad(F.col("chapter").cast("string"), F.greatest(F.lit(2), F.length(F.col("chapter").cast("string"))), F.lit("0")), F.lit(".md")).alias("path"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = Path(folder) / name
                at.parent.mkdir(parents=True, exist_ok=True)
                part = at.with_name(f".{at.name}.{uuid.uuid4().hex}")
                part.write_text(text + "\n", encoding="utf-8")
                os.replace(part, at)
                sizes.append(len(text.encode()) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.mapInArrow(write, "path string, bytes long")
