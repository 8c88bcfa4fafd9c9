"""Spans against the text they are cut from, the rates they add up to, and phrases against a matcher by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from penstroke.operators import features, lexicon, phrases, spans, surprisal

TEXTS = [
    "Teh cat — it SAT, and i said 'don''t' -- dont!!  Then: 1,000 (or 2,000) however… \n# A Heading Here\n* one\n2. two\n> quoted\n**bold** `code` [x](y)",
    "", None, "...", "Moreover, sooo many wierd WORDS; I’ve 3.5 [a] {b} <i> i", "é, ü; ö: “q” ‘s’ ’tis\n\n- item\n- item two", "  space , before ;twice  . lower after. Upper, and more", "i",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def test_spans_add_up_to_rates(docs):
    found = spans.pattern_spans(docs).unionByName(spans.token_spans(spans.located_tokens(docs)))
    counts = {(r.doc_id, r.dim): r.n for r in found.groupBy("doc_id", "dim").agg(F.count("*").alias("n")).collect()}
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(features.W.TOKEN)).alias("n")).collect()}
    rates = features.mark_rates(docs).unionByName(features.informality(docs)).unionByName(features.kinds(docs)).unionByName(features.markers(docs)).collect()
    checked = 0
    for r in rates:
        if not r.dim.endswith(":total"):
            assert round(r.value * sizes[r.doc_id] / 1000) == counts.get((r.doc_id, r.dim), 0), (r.doc_id, r.dim)
            checked += counts.get((r.doc_id, r.dim), 0)
    assert checked > 50


def test_spans_hold_what_they_name(docs):
    found = spans.pattern_spans(docs).collect()
    held = {(r.dim, TEXTS[r.doc_id][r.start : r.end]) for r in found}
    assert {("punct:em_dash_rate", "—"), ("md:heading_rate", "# A Heading Here"), ("md:bold_rate", "**bold**"), ("punct:informal:elongated_punct", "!!"), ("punct:style:space_before_punct", " ;"), ("punct:informal:lowercase_i", "i")} <= held
    assert all(text and len(text) == 1 for dim, text in held if dim in ("punct:comma_rate", "punct:quote_double_curly_rate"))
    located = spans.located_tokens(docs).collect()
    assert all(TEXTS[r.doc_id][r.start : r.end] == r.raw for r in located) and ("teh" in {r.w for r in located})


def test_other_kinds(spark, docs):
    located = spans.located_tokens(docs)
    words = spark.createDataFrame([("however", "word:however"), ("words", "word:words")], "w string, dim string")
    assert {(r.dim, TEXTS[r.doc_id][r.start : r.end]) for r in spans.word_spans(located, words).collect()} == {("word:however", "however"), ("word:words", "WORDS")}
    found = spans.phrase_spans(docs, located, {"said": "i said *", "n": "# or #"}).collect()
    assert {(r.dim, TEXTS[r.doc_id][r.start : r.end]) for r in found} == {("said", "i said 'don"), ("n", "1,000 (or 2,000")}
    grams = spark.createDataFrame([("gram:any", "e c", "multi_word"), ("gram:h", "h c", "multi_word"), ("gram:p", " — ", "mid_punct")], "dim string, gram string, type string")
    assert {(r.dim, TEXTS[r.doc_id][r.start : r.end]) for r in spans.gram_spans(docs, grams, 3).collect()} == {("gram:h", "h c"), ("gram:p", " — ")}
    run = spark.createDataFrame([(1, "one \n\t two")], "doc_id long, text string")
    gram = spark.createDataFrame([("g", "e t", "multi_word")], "dim string, gram string, type string")
    assert [(r.start, r.end) for r in spans.gram_spans(run, gram, 3).collect()] == [(2, 8)]
    units = surprisal.word_units(docs)
    scored = surprisal.score(units, surprisal.fit(units))
    peaks = spans.peak_spans(located, scored, 0.0).collect()
    assert len(peaks) == units.count() and all(TEXTS[r.doc_id][r.start : r.end] for r in peaks)
    second = spark.createDataFrame([(6, 1, "sent:second")], "doc_id long, s int, dim string")
    assert [TEXTS[6][r.start : r.end] for r in spans.sentence_spans(docs, second).collect()] == [" lower after."]


def test_sweep_and_limits(spark):
    rows = [(1, "a", 0, 5), (1, "b", 3, 8), (1, "c", 5, 6), (1, "d", 5, 9), (1, "e", 20, 21), (2, "a", 1, 2)]
    found = spark.createDataFrame(rows, "doc_id long, dim string, start int, end int")
    weights = spark.createDataFrame([("a", 0.5), ("b", -3.0), ("c", 1.0), ("d", -2.0), ("e", 0.1)], "dim string, weight double")
    swept = {r.doc_id: [(s.start, s.end, s.dim) for s in r.spans] for r in spans.apart(spans.highlights(found, weights, 5)).collect()}
    assert swept == {1: [(0, 5, "a"), (5, 9, "d"), (20, 21, "e")], 2: [(1, 2, "a")]}
    heaviest = spans.apart(spans.highlights(found, weights, 2)).where("doc_id = 1").first().spans
    assert [(s.start, s.end, s.dim) for s in heaviest] == [(3, 8, "b")]
    own = weights.select(F.lit(1).cast("long").alias("doc_id"), "dim", "weight")
    assert [r.doc_id for r in spans.apart(spans.highlights(found, own, 5)).collect()] == [1]


def test_rendering(spark):
    text = 'a <b> & "c" é🙂 end'
    marked = [(2, 5, 'x"y', 1.5), (12, 13, "e", -0.25)]
    row = spark.createDataFrame([(text, marked), ("plain <", None), ("short", [(3, 99, "z", 1.0)]), ("abc", [(0, 2, "p", 1.0), (1, 3, "q", 1.0)])], "text string, spans array<struct<start:int,end:int,dim:string,weight:double>>")
    html, ansi = (row.select(f(F.col("text"), F.col("spans")).alias("r")).toPandas().r.tolist() for f in (spans.render_html, spans.render_ansi))
    assert html == [
        'a <mark class="penstroke" title="x&quot;y (+1.5000)">&lt;b&gt;</mark> &amp; &quot;c&quot; <mark class="penstroke" title="e (-0.2500)">é</mark>🙂 end', "plain &lt;", "short", '<mark class="penstroke" title="p (+1.0000)">ab</mark>c',
    ]
    assert ansi[0] == 'a \x1b[43m\x1b[30m<b>\x1b[0m & "c" \x1b[43m\x1b[30mé\x1b[0m🙂 end'


def by_hand(pattern, forms):
    """Starts of a pattern: every choice and every length of each gap, written out and compared."""
    written = [[]]
    for choices in phrases.elements(pattern):
        longer = []
        for choice in choices:
            ways = [[]]
            for w in choice:
                ways = [x + ["?"] * n for x in ways for n in range(1, 5)] if w == "*" else [[*x, w] for x in ways]
            longer += [x + y for x in written for y in ways]
        written = longer
    same = lambda w, form: w == "?" or (phrases.NUMBER.fullmatch(form) is not None if w == "#" else w == form)
    return [i for i in range(len(forms)) if any(i + len(x) <= len(forms) and all(map(same, x, forms[i:])) for x in written)]


def test_phrases_by_hand(spark):
    rng = random.Random(2)
    patterns = {"p0": "a * b", "p1": "{a|b c} a", "p2": "# b", "p3": "a a a", "p4": "a", "p5": "* c", "p6": "{a b|a} {b|c} # *", "p7": "c # {a|*} b"}
    texts = [" ".join(rng.choice(["a", "b", "c", "7", "3rd", "v2"]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = sorted((k, name, i) for k, t in enumerate(texts) for name, p in patterns.items() for i in by_hand(p, t.split()))
    assert sorted((r.doc_id, r.id, r["first"]) for r in phrases.matches(docs, patterns).collect()) == expected
    ends = {(r.id, r["last"]) for r in phrases.matches(spark.createDataFrame([(1, "a x b x b")], "doc_id long, text string"), {"p": "a * b"}).collect()}
    assert ends == {("p", 2)}


def test_thousands_of_phrases_in_one_trie(spark):
    patterns = {f"p{i}": f"w{i} * w{i + 1} {{x|y}}" for i in range(5000)} | {"both": "w1 w2"}
    docs = spark.createDataFrame([(1, "w7 and w8 y then w1 w2 x w3 x"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.id, r["first"], r["last"]) for r in phrases.matches(docs, patterns).collect()} == {(1, "p7", 0, 3), (1, "both", 5, 6), (1, "p2", 6, 9)}


def test_folder_of_packs(tmp_path):
    for k in range(10):
        pack = {"name": f"pack-{k}", "version": "1", "license": "CC0-1.0", "terms": [{"id": "t", "word": "very", "category": "c"}], "phrases": [{"id": "p", "pattern": f"word {k} *", "category": "c"}]}
        (tmp_path / f"{k}.json").write_text(json.dumps(pack))
    packs = lexicon.load_packs(str(tmp_path))
    assert sorted(packs) == [f"pack-{k}" for k in range(10)]
    (tmp_path / "again.json").write_text(json.dumps(packs["pack-1"]))
    with pytest.raises(ValueError, match="two packs"):
        lexicon.load_packs(str(tmp_path))
    (tmp_path / "again.json").write_text(json.dumps(packs["pack-1"] | {"name": "x", "phrases": [{"id": "p", "pattern": "a {|b}", "category": "c"}]}))
    with pytest.raises(ValueError, match="empty phrase"):
        lexicon.load_packs(str(tmp_path))
