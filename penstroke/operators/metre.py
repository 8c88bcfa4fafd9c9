"""Metre and archaism of verse, by a table of pronunciations where it knows a word and by rules of spelling where it doesn't.

A table is (w, syllables, stress, rhyme): stress has a figure for each syllable, 0 for an unstressed one, rhyme is the same for words that
rhyme. Tables are data with a version (`load`), and what was measured with one is never compared with what another gives (`check`)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstroke.functions.text import per_1k, ratio, syllables, token_array, unpivot

#: Words that end no clause; forms of the old and the new second person; verbs of the old inflections that are short.
FUNCTION_FINAL = (
    "the a an and or but of to in on at by for with as that which who whose when where while if than from into upon my thy his her its their our your this these no not "
    "is was are were be been have has had shall will would should may might must can could do does did"
).split()
THOU, YOU = "thou thee thy thine ye".split(), "you your yours yourself yourselves".split()
ETH, EST = "doth hath saith goeth cometh maketh taketh".split(), "dost hast art wilt shalt canst wert".split()
#: Places of a line whose stress is measured, and what a line of verse may have: least lines of a text, most tokens, least share of such lines.
POSITIONS, LINES, SHORT, SHARE = 10, 6, 14, 0.5
TABLE = "w string, syllables int, stress string, rhyme string"
VOWEL_GROUPS = "vowel-groups"


@dataclass(frozen=True)
class Pronunciations:
    """A named version of a table; without entries, the rules of spelling alone."""

    name: str = VOWEL_GROUPS
    version: str = "1"
    entries: tuple[tuple[str, int, str, str | None], ...] = ()

    @property
    def method(self) -> str:
        return f"{self.name}@{self.version}"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.entries), TABLE)


def load(path: str) -> Pronunciations:
    """From a JSON file: name, version, entries [{word, syllables, stress, rhyme?}]. Stress must have a figure for each syllable."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    if not found.get("name") or not found.get("version") or found["name"] == VOWEL_GROUPS:
        raise ValueError(f"{path}: a table needs a name of its own and a version")
    entries = tuple((e["word"], int(e["syllables"]), e["stress"], e.get("rhyme")) for e in found["entries"])
    for word, n, stress, _ in entries:
        if word != word.lower() or len(stress) != n or {*stress} - {*"012"}:
            raise ValueError(f"{path}: {word!r} has {n} syllables and stress {stress!r}")
    if len({e[0] for e in entries}) < len(entries):
        raise ValueError(f"{path}: a word is there twice")
    return Pronunciations(found["name"], found["version"], entries)


def check(fitted: str, given: Pronunciations) -> None:
    """Refuse to measure by another method than the one a reference was fitted with; nothing is measured by rules in the place of a table."""
    if fitted != given.method:
        raise ValueError(f"fitted with {fitted}, given {given.method}: fit again, or give the table it was fitted with")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, l, line, ws, k) of texts that read as verse: lines with a word, and their number."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), token_array(x).alias("ws"))), lambda x: F.size(x["ws"]) > 0)
    held = docs.select("doc_id", lines.alias("lines")).withColumn("k", F.size("lines"))
    gated = held.where((F.col("k") >= LINES) & (F.size(F.filter("lines", lambda x: F.size(x["ws"]) <= SHORT)) >= SHARE * F.col("k")))
    return gated.select("doc_id", "k", F.posexplode("lines").alias("l", "x")).select("doc_id", "k", "l", "x.line", "x.ws")


def stresses(words: DataFrame, table: DataFrame) -> DataFrame:
    """words (w and more) with n, their syllables, and stress: the table's where it has one for each syllable; else a word of one is stressed
    unless it ends no clause, and a longer one on the first."""
    known = table.select("w", F.col("syllables").alias("listed"), F.col("stress").alias("figures"))
    n = F.coalesce("listed", syllables(F.col("w")))
    rule = F.when(F.col("n") <= 1, F.when(F.col("w").isin(FUNCTION_FINAL), "0").otherwise("1")).otherwise(F.rpad(F.lit("1"), F.col("n"), F.lit("0")))
    return words.join(known, "w", "left").withColumn("n", n).withColumn("stress", F.when(F.length("figures") == F.col("n"), F.col("figures")).otherwise(rule)).drop("listed", "figures")


def metre(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Of texts that read as verse: lines that end unstressed, that pause within, that run on behind a function word, and that end with a mark, per 100 lines;
    the share of stressed syllables at each of ten places; and the share of syllables that alternate from an unstressed one."""
    lines = _lines(docs)
    words = stresses(lines.select("doc_id", "l", F.posexplode("ws").alias("i", "w")), table)
    by_line = words.groupBy("doc_id", "l").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "stress"))), lambda x: x["stress"]), "").alias("figures"))  # words of a line
    trimmed = F.regexp_replace("line", r"[\x20\x09-\x0D]+$", "")
    ends = F.regexp(trimmed, F.lit("[.,;:?!—]$"))
    read = lines.join(by_line, ["doc_id", "l"]).select(
        "doc_id", "k", "figures", ends.alias("stopped"), F.regexp(trimmed, F.lit(r"[,;:.?!](?=.)")).alias("paused"), (~ends & F.element_at("ws", -1).isin(FUNCTION_FINAL)).alias("run_on"))
    digit = lambda i: F.substring("figures", i, 1)
    places = range(1, POSITIONS + 1)
    hit = sum((F.when((digit(i) != "") & ((digit(i) != "0") == F.lit(i % 2 == 0)), 1).otherwise(0) for i in places), F.lit(0))
    counted = read.groupBy("doc_id").agg(
        F.first("k").alias("k"), F.count_if((F.length("figures") > 1) & (F.right("figures", F.lit(1)) == "0")).alias("feminine"), F.count_if("paused").alias("paused"), F.count_if("run_on").alias("run_on"), F.count_if("stopped").alias("stopped"),
        *(F.count_if(digit(i) != "").alias(f"all_{i}") for i in places), *(F.count_if((digit(i) != "") & (digit(i) != "0")).alias(f"up_{i}") for i in places),
        F.sum(hit).alias("hits"), F.sum(F.least(F.length("figures"), F.lit(POSITIONS))).alias("total"),
    )
    rate = lambda c: 100.0 * F.col(c) / F.col("k")
    return unpivot(counted, "doc_id", {
        "verse:feminine_ending_rate": rate("feminine"), "verse:midline_pause_rate": rate("paused"), "verse:run_on_rate": rate("run_on"), "verse:stopped_rate": rate("stopped"),
        **{f"verse:stress:{i}": F.when(F.col(f"all_{i}") > 0, F.col(f"up_{i}") / F.col(f"all_{i}")) for i in places}, "verse:iambic_share": ratio(F.col("hits"), F.col("total")),
    })


def archaism(docs: DataFrame) -> DataFrame:
    """Of texts that read as verse: the old second person over the new, and the old inflections per 1,000 tokens."""
    verse = docs.join(_lines(docs).select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", token_array(F.col("text")).alias("ws"))
    among = lambda test: F.size(F.filter("ws", test))
    eth = among(lambda w: w.isin(ETH) | ((F.octet_length(w) > 4) & w.endswith("eth")))
    est = among(lambda w: w.isin(EST) | ((F.octet_length(w) > 4) & w.endswith("est") & ~w.endswith("iest")))
    thou, you = among(lambda w: w.isin(THOU)), among(lambda w: w.isin(YOU))
    counted = verse.select("doc_id", F.size("ws").alias("n"), thou.alias("thou"), you.alias("you"), eth.alias("eth"), est.alias("est"))
    balance: Column = F.when(F.col("you") == 0, F.col("thou").cast("double")).otherwise(F.col("thou") / F.col("you"))
    return unpivot(counted, "doc_id", {"verse:thou_you": balance, "verse:eth_rate": per_1k(F.col("eth"), F.col("n")), "verse:est_rate": per_1k(F.col("est"), F.col("n"))})


def rhymes(docs: DataFrame, table: DataFrame, within: int = 2) -> DataFrame:
    """(doc_id, dim, value): lines of verse whose last word rhymes with that of one of the `within` lines before, per 100; a word that the table has no rhyme
    for rhymes with none, nor a word with itself."""
    last = _lines(docs).select("doc_id", "k", "l", F.element_at("ws", -1).alias("w")).join(table.where("rhyme IS NOT NULL").select("w", "rhyme"), "w", "left")
    order = Window.partitionBy("doc_id").orderBy("l").rowsBetween(-within, -1)
    before = last.withColumn("before", F.collect_list(F.struct("rhyme", "w")).over(order))
    hit = F.coalesce(F.exists("before", lambda x: (x["rhyme"] == F.col("rhyme")) & (x["w"] != F.col("w"))), F.lit(False))
    return before.groupBy("doc_id").agg((100.0 * F.count_if(hit) / F.first("k")).alias("value")).select("doc_id", F.lit("verse:rhyme_rate").alias("dim"), "value")
