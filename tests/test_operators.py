import json
import math
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from penstroke.functions import clean
from penstroke.operators import calibrate, contrast, critique, distance, features, lexicon, surprisal, verify, vocabulary
from penstroke.sources import records
from penstroke.streaming import events
from penstroke.text import analyzer


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def value(df, dim, doc=0):
    return df.where((F.col("dim") == dim) & (F.col("doc_id") == doc)).first().value


def test_mtld_by_hand(spark):
    def one_way(words, threshold=0.72):
        factors, seen, n = 0.0, set(), 0
        for w in words:
            seen.add(w)
            n += 1
            if len(seen) / n <= threshold:
                factors, seen, n = factors + 1, set(), 0
        return factors + ((1 - len(seen) / n) / (1 - threshold) if n else 0)

    words = ("the cat sat on the mat and the dog ran to the cat and sat down on a mat with the dog " * 4).split()
    ahead, back = one_way(words), one_way(words[::-1])
    expected = (len(words) / ahead + len(words) / back) / 2
    assert math.isclose(value(features.mtld(docs(spark, " ".join(words))), "rich:mtld"), expected)
    assert value(features.mtld(docs(spark, "one two")), "rich:mtld") is None


def test_degenerate_documents(spark):
    rows = docs(spark, None, "", " \n ", "word", "x " * 3000)
    for family in (features.mark_rates, features.style_ratios, features.letters, features.word_lengths, features.sentence_dispersion, features.sentence_counts, features.openers, features.markers, features.markdown,
                   features.punch_rate, features.richness, features.mattr, features.readability, features.register, features.alliteration, features.escalation, features.catalogues, features.artifacts, features.confidence):
        family(rows).collect()
        assert family(rows.limit(0)).count() == 0


def test_decompositions_add_up(spark):
    vectors = spark.createDataFrame([("a", "p", 1.0), ("a", "q", -2.0), ("a", "r", 0.5), ("b", "p", 0.0), ("b", "q", 1.5), ("b", "r", 2.0)], "id string, dim string, v double")
    rank = spark.createDataFrame([("p", 0), ("q", 1), ("r", 2)], "dim string, idx int")
    paired = distance.pairs(vectors.where("id = 'a'"), vectors.where("id = 'b'"), "v")
    for metric in distance.METRICS:
        total = distance.contributions(paired, metric, rank).agg(F.sum("contribution")).first()[0]
        whole = distance.distances(paired, metric, rank).first().distance
        assert math.isclose(total + (metric == "cosine"), whole), metric
    assert math.isclose(distance.distances(paired, "burrows").first().distance, (1 + 3.5 + 1.5) / 3)
    with pytest.raises(ValueError):
        distance.contributions(paired, "none")


def test_contrast_by_hand(spark):
    side = lambda *words: spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, term string")
    found = {r.term: r for r in contrast.log_odds(side(*"aaab"), side(*"abbb"), min_count=1).collect()}
    alpha = 4 * 4.5 / 9
    delta = math.log((3 + alpha) / (4 + 4 - 3 - alpha)) - math.log((1 + alpha) / (4 + 4 - 1 - alpha))
    assert math.isclose(found["a"].delta, delta) and math.isclose(found["a"].z, delta / math.sqrt(1 / (3 + alpha) + 1 / (1 + alpha)))
    assert math.isclose(found["a"].z, -found["b"].z)
    many = contrast.ranked({"word": contrast.log_odds(side(*"aaab"), side(*"abbb"), 1), "other": contrast.log_odds(side(*"cd"), side(*"cc"), 1)}, 1).collect()
    assert [(r.rank, r.universe) for r in many] == [(1, "other"), (1, "word")]


def test_lexicon_phrases(spark):
    pack = lexicon.check_pack({"name": "p", "version": "1", "license": "CC0", "terms": [{"id": "t", "word": "very", "category": "c"}], "phrases": [
        {"id": "gap", "pattern": "not * but", "category": "c"}, {"id": "num", "pattern": "# ways", "category": "d"}, {"id": "alt", "pattern": "{at the end|in the end} of", "category": "d"}]})
    found = lexicon.lexicon_rates(docs(spark, "Not only this but that. 10 ways, at the end of the very very day. not not here but there"), pack)
    n = 20
    assert {r.dim: round(r.value * n / 1000) for r in found.collect()} == {"lex:p:gap": 3, "lex:p:num": 1, "lex:p:alt": 1, "lex:p:t": 2, "lex:p:cat:c": 5, "lex:p:cat:d": 2, "lex:p:total": 7}
    with pytest.raises(ValueError):
        lexicon.check_pin(pack, "p", "2")
    with pytest.raises(ValueError):
        lexicon.check_pack(pack | {"license": ""})


def test_density_and_quantiles(spark):
    sample = [0.1, 0.4, 0.5, 0.9, 1.7]
    row = spark.createDataFrame([(sample, 0.6)], "s array<double>, x double").select(calibrate.density(F.col("s"), F.col("x")).alias("d"), calibrate.quantile(F.col("s"), 0.75).alias("q"), calibrate.ecdf(F.col("s"), F.col("x")).alias("e")).first()
    h = 0.9 * min(statistics.stdev(sample), (0.9 - 0.4) / 1.34) * 5**-0.2
    assert math.isclose(row.d, sum(math.exp(-0.5 * ((0.6 - x) / h) ** 2) for x in sample) / (5 * h * math.sqrt(2 * math.pi)))
    assert row.q == 0.9 and row.e == 0.6


def test_assessment_blends_lengths(spark):
    bins = spark.createDataFrame([(100, [0.1, 0.2], [0.8, 0.9]), (400, [0.3, 0.4], [0.6, 0.7])], "tokens int, same array<double>, different array<double>")
    asked = spark.createDataFrame([(1, 2, 0.35, 200, 200), (1, 3, 0.35, 10, 10)], "a long, b long, distance double, tokens_a int, tokens_b int")
    found = {r.b: r for r in calibrate.assess(asked, bins).collect()}
    assert math.isclose(found[2].p_same, 0.5 * 0 + 0.5 * 0.5) and not found[2].extrapolated
    assert found[3].p_same == 0 and found[3].extrapolated


def test_thresholds_prefer_abstaining(spark):
    rows = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True)], "score double, same boolean")
    best = verify.optimize_thresholds(rows).first()
    assert best.c_at_1 == 1 and 0.2 < best.p1 <= best.p2 < 0.8 and math.isclose(best.p1, 0.225) and math.isclose(best.p2, 0.775)


def test_findings_and_reports(spark):
    rows = spark.createDataFrame([(k, "d:x", 1.0 + 0.01 * k) for k in range(20)] + [(99, "d:x", 9.0)], "doc_id long, dim string, value double")
    stats = distance.dim_stats(rows.where("doc_id < 20"), 0.5)
    found = critique.findings(rows.where("doc_id = 99"), stats).first()
    assert (found.severity, found.direction, found.id) == ("high", "reduce", "d.x") and "reduce ~87%" in found.message
    report = json.loads(critique.report(critique.findings(rows.where("doc_id = 99"), stats)).first().report)
    assert report["version"] == "1" and report["findings"][0]["severity"] == "high"


def test_overlap_of_empty_contents(spark):
    row = spark.range(1).select(critique.overlap(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("x"), critique.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("y")).first()
    assert (row.x, row.y) == (1, 0.5)


def test_analyzer():
    found = analyzer.analyze_text("# Title\n\nMr. Smith paid 3.14 in 2020. Next! “Really?” he said.\n\n```\ncode. here.\n```\n- item one\n")
    text = "# Title\n\nMr. Smith paid 3.14 in 2020. Next! “Really?” he said.\n\n```\ncode. here.\n```\n- item one\n".encode()
    cut = lambda x: text[x["start"] : x["end"]].decode()
    assert [cut(s) for s in found["sentences"]] == ["# Title", "Mr. Smith paid 3.14 in 2020. Next!", "“Really?”", "he said.", "- item one"]
    assert [b["kind"] for b in found["blocks"]] == ["heading", "paragraph", "fence", "list"]
    assert [t["form"] for t in found["tokens"] if t["kind"] == "number"] == ["3.14", "2020"]
    folded = analyzer.analyze_text("pаypal​ don’t naïve")
    assert [t["form"] for t in folded["tokens"]] == ["paypal", "don't", "naïve"]
    assert {a["kind"] for a in folded["artifacts"]} == {"confusable", "zero_width", "mixed_script"}
    assert [t[3] for t in analyzer.tokenize("don’t", clitics=True)] == ["don", "'t"]
    assert unicodedata.normalize("NFC", "é") in [t["form"] for t in analyzer.analyze_text("é")["tokens"]]
    assert not any(analyzer.analyze_text("")[k] for k in ("tokens", "sentences", "blocks", "lines"))
    assert [x["blank_before"] for x in analyzer.analyze_text("a\n\nb\nc")["lines"]] == [False, True, False]


def test_cleaning(spark):
    def of(expression, text):
        return docs(spark, text).select(expression(F.col("text")).alias("x")).first().x

    assert of(clean.clean_html, "<p>One &amp; two<br>three<p><a href='x'>four</a>") == "One & two\n\nthree\n\nfour"
    assert of(clean.strip_code, "see `x` and/or http://a.b/c now\n```py\ncode\n```\n+added\nin src/main.rs end") == "see `` and/or now\n```\n```\nin end"
    assert of(clean.strip_code, "open\n```\nnever closed") == "open\n```\n```"
    repaired, count = clean.repair_typography(F.col("text"))
    texts = {
        "It is n't so , is it ?": ("It is n't so, is it?", 2), " I don 't know; it ' s\t95 %  . ": ("I don't know; it's\t95%.", 4), "“ quoted ” ( round ) [ x ]  and l 'ete": ("“quoted” (round) [x] and l 'ete", 7), "we ’ ve 's": ("we’ve 's", 1), "": ("", 0),
        "the boys ' dog": ("the boys ' dog", 0),
    }
    assert {r.text: tuple(r)[1:] for r in docs(spark, *texts).select("text", repaired, count).collect()} == texts
    body, found = clean.strip_licence(F.col("text"))
    assert tuple(docs(spark, "x\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ny").select(body, found).first()) == ("body", True)
    heads = docs(spark, "CHAPTER I", "XIV.", "Part of it was", "MIX", "# Any", "iv")
    assert [r.x for r in heads.select(clean.is_chapter_heading(F.col("text")).alias("x"), "doc_id").orderBy("doc_id").collect()] == [True, True, True, False, True, False]


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one", "author": "x", "meta": {"k": "v"}}\n\n{"text": "two", "mod')
    good, bad = records.split_bad(records.read_records(spark, str(tmp_path)).cache())
    assert [(r.text, r.author) for r in records.to_corpus(good).collect()] == [("one", "x")] and bad.count() == 1
    records.write_records(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_transcripts(spark):
    def line(session, n, value):
        return (session, n, json.dumps(value))

    shape = "session string, ord int, value string"
    first = spark.createDataFrame([line("s", 0, {"type": "user"}), line("s", 1, {"type": "assistant", "timestamp": "t", "message": {"model": "m", "content": [{"type": "text", "text": "hello"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use"}]}}), ("s", 2, '{"type": "assis')], shape)
    assert [(r.model, r.register, r.text) for r in records.message_transcripts(first).collect()] == [("m", "agent_prose", "hello")]
    assert records.message_transcripts(first, reasoning=True).count() == 2
    reply = {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "text", "text": "hi"}]}}
    second = spark.createDataFrame([line("s", 0, reply), line("s", 1, {"type": "turn_context", "payload": {"model": "m1"}}), line("s", 2, reply), line("s", 3, {"type": "turn_context", "payload": {"model": "m2"}}), line("s", 4, reply)], shape)
    assert [r.model for r in records.turn_transcripts(second).orderBy("ord").collect()] == ["unknown", "m1", "m2"]


def test_forum_and_books(spark):
    page = json.dumps({"hits": [{"comment_text": "<p>Old &quot;one&quot;", "created_at_i": 5, "author": "a", "objectID": "1"}, {"comment_text": "new", "created_at_i": records.CUTOFF}, {"author": "b"}]})
    assert [(r.author, r.text) for r in records.forum_comments(spark.createDataFrame([(page,)], "value string")).collect()] == [("a", 'Old "one"')]
    with pytest.raises(Exception, match="without hits"):
        records.forum_comments(spark.createDataFrame([("{}",)], "value string")).collect()
    book = "front\nCHAPTER I\none two three\nCHAPTER II\nfour\nCHAPTER III\nfive six seven"
    cut = records.chapters(spark.createDataFrame([("b", book), ("c", "no heading")], "book string, text string"), 2).orderBy("book", "chapter").collect()
    assert [(r.book, r.heading, r.text) for r in cut] == [("b", "CHAPTER I", "one two three\n\nfour"), ("b", "CHAPTER III", "five six seven"), ("c", None, "no heading")]


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value", "user_id")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("counts")) == key(events.windowed_counts(table))


def test_vocabulary_ties_and_culling(spark):
    rows = docs(spark, "b a c", "a b", "a d")
    assert [r.term for r in vocabulary.frequent_words(rows, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.term for r in vocabulary.frequent_words(rows, 9, 0.6).orderBy("rank").collect()] == ["a", "b"]


@pytest.mark.parametrize("head", [0, 3, 1 << 16])
def test_bits_do_not_depend_on_what_is_broadcast(spark, head):
    held = docs(spark, "the cat sat on the mat and the cat sat", "a dog sat on the cat", "", None)
    units = surprisal.word_units(held)
    model = surprisal.fit(units)
    counts, contexts = {(r.context, r.unit): r.j for r in model[0].collect()}, {r.context: r.m for r in model[1].collect()}
    other = surprisal.word_units(docs(spark, "the cat ran on the mat"))
    for asked in (units, other):
        want = sorted((r.doc_id, r.i, -math.log2((counts.get((r.context, r.unit), 0) + 0.5) / (contexts.get(r.context, 0) + 0.5 * model[2]))) for r in asked.collect())
        got = sorted((r.doc_id, r.i, r.bits) for r in surprisal.score(asked, model, head=head).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(math.isclose(g[2], w[2]) for g, w in zip(got, want, strict=True))
