"""Rhetorical devices and syntax by pattern: rates per 1,000 tokens or per 100 sentences, their spacing, and pairs by table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.functions.text import per_1k, ratio, sentences, token_array, tokens, unpivot

#: Fixed lists.
BE = "am is are was were be been being".split()
SUBORDINATORS = "because although though while whereas unless until since if when after before that which who".split()
COORDINATORS = "and but or nor so yet".split()
INTERJECTIONS = "oh ah wow hey ugh alas well hmm oops yay ouch".split()
PERSONS = {"p1s": "i me my mine myself", "p2": "you your yours yourself yourselves", "p1p": "we us our ours ourselves"}
IMPERATIVES = (
    "get buy try start stop join call click visit download discover explore find learn see look read check book order shop save grab take make build create sign "
    "subscribe register contact ask request schedule claim unlock boost transform upgrade switch choose pick compare share follow watch listen imagine consider "
    "remember forget meet let give add keep put send bring come go do be have use enjoy experience act hurry"
).split()
DEMONSTRATIVES = "this these that those".split()
FROZEN = ("as good as gold", "as clear as day", "as old as time", "like a charm", "like a dream")


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), token_array(F.col("text")).alias("forms")).where(F.regexp("text", F.lit(r"[\p{L}\p{Nd}_]"))).withColumn("n", F.size("forms")).withColumn("line", F.concat(F.lit(" "), F.array_join("forms", " "), F.lit(" ")))


def _hits(pattern: str, column: str = "line") -> Column:
    return F.regexp_count(column, F.lit(pattern))


def texture(docs: DataFrame) -> DataFrame:
    """Adverbs in -ly, intensifiers, interjections and persons per 1,000 tokens, and words in capitals before an exclamation mark."""
    among = lambda items: F.size(F.filter("forms", lambda w: w.isin(items)))
    counts = {
        "ly_adverb_rate": F.size(F.filter("forms", lambda w: (F.length(w) > 4) & w.endswith("ly"))), "intensifier_rate": among(W.REGISTER["amplifier_rate"].split()), "interjection_rate": among(INTERJECTIONS),
        **{f"person:{k}": among(v.split()) for k, v in PERSONS.items()}, "allcaps_exclaim_rate": _hits(r"\p{Lu}{2,}!", "text"),
    }
    return unpivot(_sized(docs), "doc_id", {f"syn:{k}": per_1k(c, F.col("n")) for k, c in counts.items()})


def clause_shape(docs: DataFrame) -> DataFrame:
    """Sentences that begin with a conjunction, per 100, and subordinators over coordinators."""
    each = sentences(docs).select("doc_id", token_array(F.col("sentence")).alias("ws")).where(F.size("ws") > 0)
    among = lambda items: F.size(F.filter("ws", lambda w: w.isin(items)))
    grouped = each.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.get("ws", F.lit(0)).isin(COORDINATORS)).alias("first"), F.sum(among(SUBORDINATORS)).alias("sub"), F.sum(among(COORDINATORS)).alias("co"))
    return unpivot(grouped, "doc_id", {"syn:initial_conj_rate": 100.0 * F.col("first") / F.col("n"), "syn:sub_coord_ratio": ratio(F.col("sub"), F.col("co"))})


def marketing(docs: DataFrame) -> DataFrame:
    """Imperatives and four shapes of headlines per 100 sentences, and triplets `a, b, and c` per 1,000 tokens."""
    each = sentences(docs).select("doc_id", "sentence", token_array(F.col("sentence")).alias("ws")).where(F.size("ws") > 0)
    first, second = F.get("ws", F.lit(0)), F.coalesce(F.get("ws", F.lit(1)), F.lit(""))
    short = F.size("ws") <= 12
    shapes = {
        "imperative_rate": first.isin(IMPERATIVES) & (second != "not"), "headline:number_initial": F.regexp(first, F.lit("^[0-9]+$")), "headline:listicle": short & F.regexp(first, F.lit("^[0-9]+$")) & second.isin("ways", "things", "reasons", "tips", "steps"),
        "headline:question": short & F.regexp("sentence", F.lit(r"\?$")), "headline:demonstrative": short & first.isin(DEMONSTRATIVES),
    }
    grouped = each.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.count_if(v).alias(k) for k, v in shapes.items()))
    rates = unpivot(grouped, "doc_id", {f"dev:{k}": 100.0 * F.col(f"`{k}`") / F.col("n") for k in shapes})
    triplets = _sized(docs).select("doc_id", F.lit("dev:triplet_rate").alias("dim"), per_1k(_hits(r"[\p{L}]+, [\p{L}]+,? (?:and|or) [\p{L}]+", "text"), F.col("n")).alias("value"))
    return rates.unionByName(triplets)


def passives(docs: DataFrame) -> DataFrame:
    """Forms of `be` with a participle among the next three tokens per 100 sentences (a search goes on after what it found), and
    acronyms per 1,000 tokens."""
    count = F.size(F.filter(F.regexp_extract_all("text", F.lit(f"({W.SENTENCE})"), 1), lambda s: F.regexp(s, F.lit(r"[\p{L}\p{Nd}_]"))))
    passive = _hits(rf"(?<= )(?:{'|'.join(BE)}) (?:[^ ]+ ){{0,2}}?[^ ]{{2,}}(?:ed|en|wn|ught) ")
    acronym = _hits(r"(?<![\p{L}\p{Nd}])(?=[\p{Lu}\p{Nd}]*\p{Lu}[\p{Lu}\p{Nd}]*\p{Lu})[\p{Lu}\p{Nd}]{2,8}(?![\p{L}\p{Nd}])", "text")
    sized = _sized(docs).select("doc_id", "n", count.alias("s"), passive.alias("p"), acronym.alias("a"))
    return unpivot(sized, "doc_id", {"read:passive_rate": 100 * ratio(F.col("p"), F.col("s")), "read:acronym_rate": per_1k(F.col("a"), F.col("n"))})


def frames(docs: DataFrame) -> DataFrame:
    """Comparison frames (`as x as`, `like a x`, `much the same way`) per 1,000 tokens, those negated, the frozen ones' share, and the
    burstiness of the gaps between them in tokens (null below four)."""
    pattern = r"(?: as (?:[^ ]+ ){1,3}?as | like an? | much the same way )"
    sized = _sized(docs).withColumn("parts", F.split("line", pattern)).withColumn("k", F.size("parts") - 1)
    gaps = F.transform(F.slice("parts", 2, F.greatest(F.lit(0), F.size("parts") - 2)), lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != "")).cast("double"))
    frozen = sum((_hits(rf"(?<= ){x} ") for x in FROZEN), F.lit(0))
    measured = sized.select("doc_id", "n", "k", _hits(rf" (?:not|never|hardly){pattern}").alias("negated"), frozen.alias("frozen"), gaps.alias("gaps"))
    return unpivot(measured, "doc_id", {
        "frame:simile_rate": per_1k(F.col("k"), F.col("n")), "frame:negated_vehicle_rate": per_1k(F.col("negated"), F.col("n")), "frame:frozen_share": F.least(F.lit(1.0), ratio(F.col("frozen"), F.col("k"))),
        "frame:figure_burstiness": F.when(F.col("k") >= 4, burstiness("gaps")),
    })


def burstiness(gaps: str) -> Column:
    """(sd - mean) / (sd + mean) of an array, by the population deviation; null below two gaps or where both are 0."""
    n = F.size(gaps)
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / n
    sd = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.when((n >= 2) & (sd + mean > 0), (sd - mean) / (sd + mean))


def links(docs: DataFrame) -> DataFrame:
    """Markdown links and bare addresses, and footnote marks per 1,000 tokens; questions not put to the reader per 100 sentences."""
    asked = F.filter(F.regexp_extract_all("text", F.lit(f"({W.SENTENCE})"), 1), lambda s: F.regexp(s, F.lit(r"[\p{L}\p{Nd}_]")))
    rhetorical = F.filter(asked, lambda s: F.regexp(s, F.lit(r"\?$")) & ~F.regexp(F.lower(F.trim(s)), F.lit(r"^(do|did|can|could|will|would|are|have|may|should) you\b")))
    sized = _sized(docs).select("doc_id", "n", _hits(r"\]\([^)]*\)|(?<!\()https?://", "text").alias("l"), _hits(r"\[\^[^\]]+\]", "text").alias("f"), F.size(rhetorical).alias("q"), F.size(asked).alias("s"))
    return unpivot(sized, "doc_id", {"md:link_rate": per_1k(F.col("l"), F.col("n")), "md:footnote_rate": per_1k(F.col("f"), F.col("n")), "sent:rhetorical_question_rate": 100 * ratio(F.col("q"), F.col("s"))})


def asides(docs: DataFrame) -> DataFrame:
    """Asides in brackets or between dashes per 100 sentences, their mean length in tokens and their share of tokens."""
    found = F.regexp_extract_all("text", F.lit(r"(\([^()\n]+\)|—[^—\n]+—)"), 1)
    sized = _sized(docs).select("doc_id", "n", F.size(found).alias("k"), F.aggregate(found, F.lit(0), lambda a, x: a + F.size(token_array(x))).alias("t"), F.size(F.filter(F.regexp_extract_all("text", F.lit(f"({W.SENTENCE})"), 1), lambda s: F.regexp(s, F.lit(r"[\p{L}\p{Nd}_]")))).alias("s"))
    return unpivot(sized, "doc_id", {"sent:aside_rate": 100 * ratio(F.col("k"), F.col("s")), "sent:aside_len_mean": ratio(F.col("t"), F.col("k")), "sent:aside_share": ratio(F.col("t"), F.col("n"))})


def paired_words(docs: DataFrame, pairs: DataFrame, dim: str = "dev:antonym_pair_rate") -> DataFrame:
    """Sentences that hold both words of a pair of a table (a, b), per 1,000 tokens: an equi-join on the words of each sentence."""
    each = sentences(docs).select("doc_id", "s", F.explode(F.array_distinct(token_array(F.col("sentence")))).alias("w"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    found = each.join(both.withColumnRenamed("a", "w"), "w").select("doc_id", "s", F.col("b").alias("w")).join(each, ["doc_id", "s", "w"], "left_semi").select("doc_id", "s").distinct().groupBy("doc_id").agg(F.count("*").alias("c"))
    size = docs.select("doc_id", F.size(token_array(F.col("text"))).alias("n")).where("n > 0")
    return size.join(found, "doc_id", "left").select("doc_id", F.lit(dim).alias("dim"), per_1k(F.coalesce("c", F.lit(0)), F.col("n")).alias("value"))


def near_keys(docs: DataFrame, keys: DataFrame, within: int = 12, dim: str = "dev:rhyme_chain_rate") -> DataFrame:
    """Tokens with the key of another token at most `within` before them, per 1,000; keys is a table (w, key), such as rhymes. The
    nearest earlier token of a key is all that matters, so a window finds it and no pairs are made."""
    order = Window.partitionBy("doc_id", "key").orderBy("i")
    each = tokens(docs).join(keys, "w", "left")
    keyed = each.where("key IS NOT NULL").withColumn("gap", F.col("i") - F.lag("i").over(order)).groupBy("doc_id").agg(F.count_if(F.col("gap") <= within).alias("c"))
    size = docs.select("doc_id", F.size(token_array(F.col("text"))).alias("n")).where("n > 0")
    return size.join(keyed, "doc_id", "left").select("doc_id", F.lit(dim).alias("dim"), per_1k(F.coalesce("c", F.lit(0)), F.col("n")).alias("value"))


def clashes(docs: DataFrame, norms: DataFrame, within: int = 12) -> DataFrame:
    """Sentences in which a word of the upper quarter of norms (term, score) stands within `within` tokens of one of the lower, per 100."""
    low, high = norms.agg(F.percentile("score", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    each = sentences(docs).select("doc_id", "s", F.posexplode(token_array(F.col("sentence"))).alias("i", "w"))
    scored = each.join(norms.withColumnRenamed("term", "w"), "w", "left").withColumn("side", F.when(F.col("score") >= high, 1).when(F.col("score") <= low, 0))
    order = Window.partitionBy("doc_id", "s").orderBy("i").rowsBetween(-within, -1)
    met = scored.withColumn("other", F.max(F.when(F.col("side") == 0, 1)).over(order)).withColumn("same", F.max(F.when(F.col("side") == 1, 1)).over(order))
    hit = ((F.col("side") == 1) & (F.col("other") == 1)) | ((F.col("side") == 0) & (F.col("same") == 1))
    per = met.groupBy("doc_id", "s").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("c"))
    return per.select("doc_id", F.lit("form:clash_rate").alias("dim"), (100.0 * F.col("c") / F.col("n")).alias("value"))


def punchlines(scored: DataFrame, sentence_of: DataFrame, least: int = 4) -> DataFrame:
    """Of sentences split at their last inner comma or dash: mean ratio of the tail's bits to the body's, and the share over 1.5; null
    below `least` splits. scored (doc_id, i, bits) by token; sentence_of (doc_id, i, s, tail boolean)."""
    joined = scored.join(sentence_of, ["doc_id", "i"]).groupBy("doc_id", "s").agg(F.avg(F.when(F.col("tail"), F.col("bits"))).alias("t"), F.avg(F.when(~F.col("tail"), F.col("bits"))).alias("b")).where("t IS NOT NULL AND b > 0")
    grouped = joined.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.col("t") / F.col("b")).alias("r"), F.avg((F.col("t") / F.col("b") > 1.5).cast("double")).alias("k"))
    enough = lambda c: F.when(F.col("n") >= least, F.col(c))
    return unpivot(grouped, "doc_id", {"surp:punch_ratio_mean": enough("r"), "surp:punch_spike_rate": enough("k")})

