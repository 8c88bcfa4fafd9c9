"""The operators against brute force, on small tables with every odd row."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from penstroke.llm import decontaminate, jaccard, language, packing, quality, secrets, sentence_spans, sharding, substrings, urls
from penstroke.llm.suffixes import suffix_array

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("aeioustrnlé") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def corpus():
    rng, texts = random.Random(3), []
    passage = prose(60, rng)
    for k in range(12):
        base = prose(40 + 30 * k, rng).split(" ")
        texts.append(" ".join(base))
        for _ in range(3):
            copy = base[:]
            for _ in range(1 + k // 4):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            texts.append(" ".join(copy))
        texts.append(prose(20, rng) + " " + passage + " " + prose(30, rng))
    texts += [None, "", " \t\n", "one", "one", "Two words", "two  words", "é" * 300, "ab " * 400, texts[0], texts[0], prose(6000, rng), texts[20] + " " + prose(400, rng)]
    return pd.DataFrame({"doc_id": range(len(texts)), "text": texts})


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS.astype(object).where(DOCS.notna(), None), "doc_id long, text string").repartition(3).cache()


def shingle_sets():
    out = {}
    for doc, text in zip(DOCS.doc_id, DOCS.text, strict=True):
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        out[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def test_jaccard_components(docs, monkeypatch):
    sets = shingle_sets()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    expected = {(d, len(sets[d]), root(d)) for d in sets}
    assert {tuple(r) for r in jaccard.similar(docs).collect()} == expected
    # Large keys are joined by stars and then across components, with the same result.
    monkeypatch.setattr(jaccard, "TOGETHER", 2)
    assert {tuple(r) for r in jaccard.similar(docs.withColumnRenamed("doc_id", "x").selectExpr("x AS doc_id", "text", "'n' AS n", "1 AS key"), 2).collect()} == expected


def test_jaccard_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (2, None), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(rows).collect()), key=str) == [(1, 2, 1), (2, 0, 2), (3, 2, 1), (None, 1, None)]


def removed_by_brute_force():
    seen, out = set(), []
    for doc, text in zip(DOCS.doc_id, DOCS.text, strict=True):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffix_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    found = substrings.dedupe(docs.selectExpr("*", "'x' AS spans", "1 AS n_bytes", "2 AS bucket")).orderBy("doc_id")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect()]
    assert got == removed_by_brute_force()
    assert "bucket" in found.columns


def test_suffix_dedup_odd_tables(spark):
    assert substrings.dedupe(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = prose(80)
    rows = spark.createDataFrame([(None, text), (4, text), (4, text), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed == r.n_bytes) for r in substrings.dedupe(rows).collect()) == [(-1, False), (4, True), (4, True), (5, True)]


@pytest.mark.parametrize("hot", [2000, 0])
def test_suffix_dedup_keeps_repeated_rows(spark, monkeypatch, hot):
    """Rows of one document remove nothing from each other at one place, in one batch or in several; what repeats within it goes from both."""
    monkeypatch.setattr(substrings, "HOT", hot)
    text, other = prose(80), prose(60)
    inside = other + " " + other
    rows = [(4, text)] * 3 + [(6, inside), (6, inside)]
    for parts in (1, 5):
        found = substrings.dedupe(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert {(r.doc_id, r.n_removed) for r in found} == {(4, 0), (6, len(other.encode()))}, parts


@pytest.mark.parametrize("hot", [2000, 0])
def test_suffix_dedup_of_shared_and_absent_ids(spark, monkeypatch, hot):
    """Rows that share a doc_id, or have none, and differ in text are documents of their own: none loses what stands nowhere else."""
    monkeypatch.setattr(substrings, "HOT", hot)
    x, y, z = prose(30), prose(40), prose(40)
    for doc in (7, None):
        for texts in ([f"{x} {z}", f"{y} {x}"], [x, f"{y} {x}"], [f"{x} {z}", f"{y} {x}", f"{x} {z}", f"{z} {y}"]):
            rows = spark.createDataFrame([(doc, t) for t in texts], "doc_id long, text string")
            order = {r.text: r.h for r in rows.selectExpr("text", "xxhash64(text) AS h").collect()}
            seen, want = set(), {}
            for t in sorted(set(texts), key=order.get):
                data = t.encode()
                gone = bytearray(len(data))
                for p in range(len(data) - 99):
                    if data[p : p + 100] in seen:
                        gone[p : p + 100] = b"\1" * 100
                    seen.add(data[p : p + 100])
                want[t] = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            for parts in (1, 3):
                found = substrings.dedupe(rows.repartition(parts)).collect()
                assert sorted((r.text, bytes(r.kept)) for r in found) == sorted((t, want[t]) for t in texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_sentence_spans_equal_their_sql(docs, spark):
    frame = DOCS.copy()
    line = "A sentence of some length is here, first of four. Another one follows it. And there is a third that has a few more words. The fourth sentence ends the line here."
    frame = pd.concat([frame, pd.DataFrame({"doc_id": [900, 901, 902], "text": [line + " Own end.", "Own start. " + line, line + "\n" + line]})])
    duck = duckdb.connect()
    duck.register("documents", frame)
    columns = ["doc_id", "n_sentences", "n_removed", "kept_md5"]
    expected = sorted(duck.sql(sentence_spans.ORACLE).df()[columns].itertuples(index=False, name=None))
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "doc_id long, text string")
    found = sentence_spans.dedupe(rows).selectExpr("doc_id", "n_sentences", "n_removed", "md5(coalesce(text, '')) AS kept_md5").toPandas()
    assert sorted(found[columns].itertuples(index=False, name=None)) == expected
    assert dict(zip(found.doc_id, found.n_removed, strict=True))[902] == 2 * len(re.findall(sentence_spans.PIECE, line))
    assert sentence_spans.dedupe(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(k, prose(n, rng)) for k, n in enumerate((8, 20, 40, 80))]
    items = [(k, t) for k, t in items if len(t) >= 32]

    def edited(text, times):
        chars = list(text)
        for _ in range(times):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "z"]])
        return "".join(chars)

    rows, expected = [], set()
    for n, (k, text) in enumerate(itertools.product(items, range(4))):
        k, body = k
        held = (body, body.upper(), edited(body, max(0, int(min(128, len(body)) * 0.08) - 2) if len(body) < 128 else 4), body.replace(" ", "\n"))[text]
        rows.append((n, prose(30, rng) + " " + held + " " + prose(25, rng)))
        expected.add((n, k))
    clean = [(100 + n, prose(200, rng)) for n in range(20)] + [(200, None), (201, ""), (202, "short"), (203, prose(4000, rng))]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS start")
    bench = spark.createDataFrame([*items, (50, None), (51, "tiny")], "item_id long, text string")
    found = decontaminate.matches(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {r[0] for r in clean}
    # Blocks of the benchmark give the same.
    blocks = list(decontaminate.indexes(bench, block=200))
    assert len(blocks) > 2
    texts = pa.array([t for _, t in rows], pa.large_string())
    assert {(r, x[1]) for b in blocks for x in decontaminate.find(texts, b.value) for r in [x[0]]} == expected
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_alignment():
    rng = random.Random(2)
    for _ in range(30):
        pattern = [rng.randrange(3) + 1 for _ in range(40)]
        text = [rng.randrange(3) + 1 for _ in range(30)] + pattern[:]
        for _ in range(3):
            text[rng.randrange(30, len(text))] = 9
        del text[rng.randrange(35, 60)]
        got = decontaminate._aligned(np.array(text, np.uint8), np.array([24]), 12, np.array([pattern], np.uint8), np.array([40]))[0]
        assert got == edit_distance_within(pattern, text)


def test_language_mixture(spark):
    rng = random.Random(4)
    letters = {"aa": "abcdef", "bb": "ghijkl", "cc": "uvwxyzé"}
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(5))
    rows = [(n, " ".join(word(k) for _ in range(60)), k) for n, k in enumerate(list(letters) * 20)]
    names, model = language.fit(spark.createDataFrame([*rows, (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string"))
    assert names == ["aa", "bb", "cc"]
    mixed = " ".join(word("aa") for _ in range(30)) + " " + " ".join(word("bb") for _ in range(70))
    tests = [(1, " ".join(word("bb") for _ in range(9))), (2, None), (3, "123 !?"), (4, ""), (5, mixed), (5, mixed), (6, "日本")]
    found = language.predict(spark.createDataFrame(tests, "doc_id long, text string").selectExpr("*", "0 AS score"), names, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found[:4]] == ["bb", "und", "und", "und"]
    assert found[0].score == 1 and found[1].score == 0
    assert [(r.lang_pred, r.n_languages) for r in found[4:6]] == [("bb", 2)] * 2
    assert abs(found[4].score - 0.7) < 0.05 and found[6].lang_pred in names
    none, empty = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.predict(spark.createDataFrame(tests, "doc_id long, text string"), none, empty).collect()} == {"und"}


def test_more_languages_than_a_task_holds_at_once(spark):
    """Forty invented languages, learned and told apart."""
    rng, rows = random.Random(12), []
    for lang in range(40):
        letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 8))
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(60)]
        rows += [(len(rows) + k, " ".join(rng.choice(words) for _ in range(40)), f"l{lang:02d}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    names, model = language.fit(docs.where("doc_id % 6 < 4"))
    assert names == [f"l{k:02d}" for k in range(40)]
    held = language.predict(docs.where("doc_id % 6 >= 4"), names, model).collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 76


def test_language_held_out_accuracy(spark):
    found = language.op3_language_mixture(spark, "/root/testdata/sf0.001").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    both = found.merge(truth, on="doc_id")
    both = both[both.held_out]
    assert len(both) > 20 and (both.lang == both.lang_pred).mean() > 0.95
    assert list(found.columns[:4]) == ["doc_id", "held_out", "lang_pred", "score"]


def test_url_rules(spark):
    given_urls = [
        None, "", "no scheme.com/", "http://", "http://a.com", "http://A.COM/x", "http://example.com/en/1", "https://www.example.com/en/1?x#y", "http://sub.www.example.com/en/",
        "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/1", "http://x.net/es", "http://y.org/casino/1", "ftp://é.org/ÀB?casino", "http://x.net/ES/1", "a://b://c.com/", "http://x.com:80/",
        "http://a.net/fr/\nb", "http://example.com/en/" + "x" * 5000,
    ]
    frame = pd.DataFrame({"page_id": [*range(len(given_urls)), 0, 4], "url": [*given_urls, None, "http://a.com"]})
    duck = duckdb.connect()
    duck.register("pages", frame)
    columns = ["page_id", "host", "path", "rule", "verdict"]
    expected = duck.sql(urls.ORACLE).df()[columns]
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "page_id long, url string").selectExpr("*", "'z' AS token", "'h' AS host")
    found = urls.judge(rows, urls.HOST_RULES + urls.PATTERNS).toPandas()[columns]
    tidy = lambda f: sorted({tuple(str(x) for x in r) for r in f.fillna("-").itertuples(index=False)})
    assert tidy(found) == tidy(expected) and len(found) == len(frame)
    assert urls.judge(rows.limit(0), urls.HOST_RULES).count() == 0


def test_secret_spans(spark):
    ratio = secrets.train(secrets.random_strings()) - secrets.train(secrets.identifiers(["value", "number", "thing", "record", "stone", "garden"]))
    key = "Zx81kQpL0vR7tYb3WmN5sHd2"
    texts = [
        "password = 'hunter22!' and TOKEN:abc", "api_key=abcdef123 Api-Key: zzzzzz", "AKIA" + "A1" * 8 + " AKIA12", "x " + "0123456789abcdef" * 2 + " deadbeef", f"see {key} there",
        "garden_stone_record_number is the thing", None, "", "ſecret=abcdef1", "token=abcde", "é" * 50 + f" secret:{key}", "counterrevolutionaries internationalization",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS secrets")
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.secrets] for r in secrets.scan(docs, ratio).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, text in enumerate(texts):
        base = [(m.start(), m.end(), "assign") for m in assign.finditer(text or "") if len(m[2]) >= 6]
        base += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        base += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        assert [s for s in found[k] if s[2] != "random"] == sorted(base, key=lambda s: (s[0], secrets.KINDS.index(s[2]))), k
    assert found[4] == [(4, 4 + len(key), "random")] and not found[5] and not found[11]
    clean = {r.doc_id: r.text for r in secrets.redact(docs, ratio).collect()}
    assert clean[4] == "see [secret] there" and clean[5] == texts[5] and clean[6] is None
    assert secrets.scan(docs.limit(0), ratio).count() == 0


def test_secret_models_on_held_out_samples():
    ratio = secrets.train(secrets.random_strings()) - secrets.train(secrets.identifiers(VOCABULARY))
    hits = sum(any(s[2] == "random" for s in secrets.spans_of(x, ratio)) for x in secrets.random_strings(800, seed=99))
    misses = sum(bool(secrets.spans_of(x, ratio)) for x in secrets.identifiers([v for v in VOCABULARY if v.isascii()], 800, seed=98))
    assert hits > 0.85 * 800 and misses < 0.02 * 1000


def test_lookup_table(spark):
    shards, slots = ("a", "b", "c", "d", "e"), 251
    owners = sharding.fill(shards, slots)
    order = {s: [(sharding._number(s, "offset") + i * (sharding._number(s, "skip") % (slots - 1) + 1)) % slots for i in range(slots)] for s in shards}
    expected, todo = {}, {s: iter(order[s]) for s in shards}
    while len(expected) < slots:
        for k, s in enumerate(shards):
            if len(expected) < slots:
                expected[next(x for x in todo[s] if x not in expected)] = k
    assert owners == [expected[i] for i in range(slots)]
    assert max(Counter(owners).values()) - min(Counter(owners).values()) <= 1
    fewer = sharding.fill(shards[:-1], slots)
    assert sum(a != b for a, b in zip(owners, fewer, strict=True)) < 0.45 * slots
    rows = spark.createDataFrame([(1, "k"), (1, "k"), (None, "k"), (2, None)], "doc_id long, shard string")
    found = sharding.place(rows, "doc_id", shards, slots)
    assert found.where("shard IS NULL").count() == 0 and found.count() == 4 and found.where("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.place(rows.limit(0), "doc_id", shards, slots).count() == 0
    hot = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id)) AS source")
    counts = [r["count"] for r in sharding.place(hot, "source", shards, slots, spread=0.2).groupBy("shard").count().collect()]
    assert max(counts) < 1.35 * 600


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, buckets):
    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())

    lengths = sorted(histogram)
    best = min(padding((*chosen, lengths[-1])) for k in range(min(buckets, len(lengths))) for chosen in itertools.combinations(lengths[:-1], k))
    bounds = packing.boundaries(histogram, buckets)
    assert len(bounds) <= buckets and padding(bounds) == best


def test_packing(docs, spark):
    found = packing.pack(docs.selectExpr("*", "1 AS bucket"), max_tokens=100, buckets=4, budget=300, group=8).toPandas()
    words = {d: len(WORDS.findall(t or "")) for d, t in zip(DOCS.doc_id, DOCS.text, strict=True)}
    assert found.groupby("doc_id").n_tokens.sum().to_dict() == {d: n for d, n in words.items() if n}
    assert (found.n_tokens <= found.bucket).all() and (found.padding == found.bucket - found.n_tokens).all()
    batches = found.groupby(["bucket", "batch_group", "batch"]).size().reset_index(name="n")
    assert (batches.n * batches.bucket <= 300).all()
    for (bucket, _), part in batches.groupby(["bucket", "batch_group"]):
        assert (part.sort_values("batch").n.iloc[:-1] == 300 // bucket).all()
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def surface(text):
    w = WORDS.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_rules(docs, spark):
    found = quality.judge(docs.selectExpr("*", "IF(doc_id % 5 = 0, NULL, IF(doc_id % 2 = 0, 'en', 'xx')) AS lang", "1 AS n_words")).toPandas().set_index("doc_id")
    for doc, text in zip(DOCS.doc_id, DOCS.text, strict=True):
        row = found.loc[doc]
        figures = surface(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == figures
        assert row.base_failed == (figures[0] < 20 or 100 * figures[4] > 30 * figures[0])
        assert not (row.base_failed and row.kept)
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def kneser_ney(codes, counts):
    """The textbook recursion over dictionaries."""
    raw = {4: Counter()}
    for code, n in zip(codes.tolist(), counts.tolist(), strict=True):
        raw[4][tuple(code >> 5 * k & 31 for k in (3, 2, 1, 0))] += n
    for order in (3, 2, 1):
        raw[order] = Counter(g[1:] for g in raw[order + 1])
    discount = {}
    for order, c in raw.items():
        n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        discount[order] = [0, *(min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.9, 2.9), strict=True))]
    total, kinds = defaultdict(int), defaultdict(list)
    for c in raw.values():
        for g, v in c.items():
            total[len(g), g[:-1]] += v
            kinds[len(g), g[:-1]].append(v)

    def p(gram):
        order = len(gram)
        if not order:
            return 1 / 32
        lower = p(gram[1:])
        if not total[order, gram[:-1]]:
            return lower
        d = discount[order]
        c = raw[order][gram]
        gamma = sum(d[min(v, 3)] for v in kinds[order, gram[:-1]])
        return (max(c - d[min(c, 3)], 0) + gamma * lower) / total[order, gram[:-1]]

    return p


def test_kneser_ney_equals_the_textbook():
    code, _ = quality.grams(pa.array([t for t in DOCS.text[:30] if t], pa.large_string()))
    codes, counts = np.unique(code, return_counts=True)
    model, p = quality.KneserNey.fit(codes, counts), kneser_ney(codes, counts)
    tried = np.concatenate((codes[::7], np.random.default_rng(1).integers(0, 2**20, 500)))
    got = model.lookup(tried)
    for x, value in zip(tried.tolist(), got.tolist(), strict=True):
        assert math.isclose(value, math.log(p(tuple(x >> 5 * k & 31 for k in (3, 2, 1, 0)))), abs_tol=1e-4)
    assert math.isclose(sum(math.exp(v) for v in model.lookup((codes[5] >> 5 << 5) + np.arange(32))), 1, abs_tol=1e-4)
