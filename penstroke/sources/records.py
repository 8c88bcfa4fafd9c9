"""Where text comes from: files of authors, records in JSON lines, transcripts, forum pages and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstroke.functions.clean import clean_html, code_share, is_chapter_heading, keep, strip_code, strip_licence
from penstroke.functions.text import whitespace_words

RECORD = "text string, author string, model string, source string, ts string, register string, license string, meta map<string,string>, _bad string"
#: The time before which forum comments are taken: 1 November 2022, in seconds.
CUTOFF = 1_667_260_800


def read_records(spark: SparkSession, path: str, names: str = "") -> DataFrame:
    """JSON lines, in all folders below path (of files that names fit, as `*.jsonl`); a line that can't be read keeps its text in `_bad`."""
    reader = spark.read.option("pathGlobFilter", names) if names else spark.read
    return reader.schema(RECORD).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def split_bad(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records read, and those that were not."""
    return records.where("_bad IS NULL AND text IS NOT NULL").drop("_bad"), records.where("_bad IS NOT NULL OR text IS NULL").select("_bad")


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("errorifexists").json(path)


def to_corpus(records: DataFrame) -> DataFrame:
    """Records with their author: the model, else the author, else `unknown`."""
    return records.withColumn("author", F.coalesce("model", "author", F.lit("unknown")))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(author, path, text) of text files: the author is the folder below path, or the file's own name where there is none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md,text}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    inner = F.regexp_replace(F.substring_index(F.col("path"), f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1), r"\.(txt|md|text)$", "")
    return files.select(F.substring_index(inner, "/", 1).alias("author"), "path", "text")


def carry_forward(turns: DataFrame, value: F.Column, *by: str, order: str) -> F.Column:
    """The latest value at or before each row of its group."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


_BLOCK = "array<struct<type:string,text:string,thinking:string>>"


def message_transcripts(lines: DataFrame, reasoning: bool = False) -> DataFrame:
    """(session, ord, model, register, ts, text) of the assistant's blocks in lines (session, ord, value) of the first format:
    an object with type, timestamp and message {model, content: blocks}."""
    shape = f"type string, timestamp string, message struct<model:string,content:{_BLOCK}>"
    parsed = lines.select("session", "ord", F.from_json("value", shape).alias("r")).where("r.type = 'assistant'")
    blocks = parsed.select("session", "ord", F.coalesce("r.message.model", F.lit("unknown")).alias("model"), F.col("r.timestamp").alias("ts"), F.explode("r.message.content").alias("b"))
    kind = F.when(F.col("b.type") == "text", "agent_prose").when(F.lit(reasoning) & (F.col("b.type") == "thinking"), "reasoning")
    return blocks.withColumn("register", kind).where("register IS NOT NULL").select("session", "ord", "model", "register", "ts", F.coalesce("b.text", "b.thinking").alias("text"))


def turn_transcripts(lines: DataFrame, reasoning: bool = False) -> DataFrame:
    """The same of the second format, where the model is that of the latest context line before a response."""
    shape = f"type string, timestamp string, payload struct<type:string,role:string,model:string,content:{_BLOCK},summary:{_BLOCK}>"
    parsed = lines.select("session", "ord", F.from_json("value", shape).alias("r")).select("session", "ord", "r.*")
    context = F.when(F.col("type") == "turn_context", F.col("payload.model"))
    named = parsed.withColumn("model", F.coalesce(carry_forward(parsed, context, "session", order="ord"), F.lit("unknown"))).where("type = 'response_item'")
    kind = F.when((F.col("payload.type") == "message") & (F.col("payload.role") == "assistant"), "agent_prose").when(F.lit(reasoning) & (F.col("payload.type") == "reasoning"), "reasoning")
    blocks = named.withColumn("register", kind).where("register IS NOT NULL").select("session", "ord", "model", "register", F.col("timestamp").alias("ts"), F.explode(F.coalesce("payload.content", "payload.summary")).alias("b"))
    return blocks.select("session", "ord", "model", "register", "ts", F.col("b.text").alias("text")).where("text IS NOT NULL")


def prose_of(blocks: DataFrame) -> DataFrame:
    """Blocks with code stripped from text, and kept (false for code or for too few words); a job may count kept by df.observe."""
    stripped = blocks.withColumn("clean", strip_code(F.col("text"))).withColumn("code_share", F.round(code_share(F.col("text"), F.col("clean")), 3))
    return stripped.withColumn("kept", keep(F.col("clean"), F.col("code_share"))).withColumn("text", F.col("clean")).drop("clean")


_PAGE = "hits array<struct<comment_text:string,created_at_i:long,created_at:string,author:string,objectID:string,story_id:long>>, page int, nbPages int"


def forum_comments(pages: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """(author, ts, id, story, text) of the comments before the cutoff in pages (value) of a forum's search results; a page without hits is an error."""
    parsed = pages.select(F.from_json("value", _PAGE).alias("p")).select(F.when(F.col("p.hits").isNull(), F.raise_error(F.lit("a page without hits"))).otherwise(F.col("p.hits")).alias("hits"))
    hits = parsed.select(F.explode("hits").alias("h")).where(F.col("h.comment_text").isNotNull() & (F.col("h.created_at_i").isNull() | (F.col("h.created_at_i") < cutoff)))
    return hits.select(F.coalesce("h.author", F.lit("unknown")).alias("author"), F.col("h.created_at").alias("ts"), F.col("h.objectID").alias("id"), F.col("h.story_id").alias("story"), clean_html(F.col("h.comment_text")).alias("text"))


def chapters(books: DataFrame, min_words: int = 0) -> DataFrame:
    """(book, chapter, heading, text): books (book, text) cut at headings, what stands before the first left out; one chapter
    where there is no heading. Chapters below min_words join the one before."""
    body, _ = strip_licence(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")))
    lines = books.select("book", F.posexplode(F.split(body, "\n")).alias("i", "line")).withColumn("head", is_chapter_heading(F.col("line")) & (F.trim("line") != ""))
    order, whole = Window.partitionBy("book").orderBy("i"), Window.partitionBy("book")
    numbered = lines.withColumn("k", F.sum(F.col("head").cast("int")).over(order)).withColumn("heads", F.sum(F.col("head").cast("int")).over(whole)).where("k > 0 OR heads = 0")
    parts = numbered.groupBy("book", "k").agg(F.max(F.when(F.col("head"), F.trim("line"))).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))), lambda x: x["line"]), "\n").alias("text"))
    sized = parts.withColumn("text", F.trim("text")).withColumn("n", whitespace_words(F.col("text")))
    by = Window.partitionBy("book").orderBy("k")
    grouped = sized.withColumn("chapter", F.greatest(F.lit(1), F.sum((F.col("n") >= min_words).cast("int")).over(by)))
    merged = grouped.groupBy("book", "chapter").agg(F.min_by("heading", "k").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return merged


def comments_url(base: F.Column, user: F.Column, page: F.Column, per_page: int = 1000) -> F.Column:
    """Address of a page of a user's comments, newest first."""
    return F.concat(base, F.lit("/search_by_date?tags=comment,author_"), user, F.lit("&page="), page.cast("string"), F.lit(f"&hitsPerPage={per_page}"))


def merge_extractions(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Extractions of (records, counters with one row of files, bad and dropped) as one: all records, and the sums."""
    records, counters = parts[0]
    for more, counted in parts[1:]:
        records, counters = records.unionByName(more, allowMissingColumns=True), counters.unionByName(counted)
    return records, counters.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "bad", "dropped")))
