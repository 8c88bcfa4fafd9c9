"""The loop around a critique: guards by hand, the stream against the table, and scores of drafts against a fitted reference."""

import random

import pytest
from pyspark.sql import functions as F

from penstroke.operators import critic, critique, reference

SCHEMA = "session long, at long, doc_id long, reported double, canary double, p_same double, words array<string>, grams array<string>"


def drafts():
    rng, out = random.Random(3), []
    for session in range(6):
        for at in range(rng.randrange(1, 7)):
            words = [w for w in "one two three four five six".split() if rng.random() < 0.6]
            p = rng.choice([None, 0.05, 0.1, 0.5])
            out.append((session, at, len(out), round(rng.random(), 2), round(rng.random(), 2), p, words, [w[:2] for w in words]))
    return out


def by_hand(rows, has_canary=True):
    share = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if {*a} | {*b} else 1.0
    out = []
    for session in sorted({r[0] for r in rows}):
        mine = sorted(r for r in rows if r[0] == session)
        for k, (_, _, doc, reported, canary, p, words, grams) in enumerate(mine):
            before = mine[k - 1] if k else None
            tripped = before is not None and has_canary and reported < before[3] * 0.99 and canary > before[4] * 1.01
            kept = (share(words, mine[0][6]) + share(grams, mine[0][7])) / 2 if k else None
            out.append((session, doc, k + 1, None if p is None else p >= 0.1, not tripped, kept is None or kept >= 0.5, kept, 2 if p is None else int(p < 0.1)))
    return out


def rows_of(frame):
    return sorted((r.session, r.doc_id, r.iteration, r.passed, r.canary_ok, r.drift_ok, None if r.content_overlap is None else round(r.content_overlap, 9), r.exit_code) for r in frame.collect())


def rounded(rows):
    return sorted((*r[:6], None if r[6] is None else round(r[6], 9), r[7]) for r in rows)


@pytest.mark.parametrize("has_canary", [True, False])
def test_table_by_hand(spark, has_canary):
    rows = drafts()
    got = rows_of(critic.advance(spark.createDataFrame(rows, SCHEMA).repartition(3), has_canary))
    assert got == rounded(by_hand(rows, has_canary)) and (not has_canary or any(not r[4] for r in got)) and any(not r[5] for r in got)


def test_stream_equals_table(spark, tmp_path):
    """Sessions that go on over three batches, each in any order."""
    rows = drafts()
    for batch in range(3):
        mine = [r for r in rows if min(r[1] // 2, 2) == batch]
        random.Random(batch).shuffle(mine)
        spark.createDataFrame(mine, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = critic.advance_stream(stream).writeStream.format("memory").queryName("loops").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert rows_of(spark.table("loops")) == rounded(by_hand(rows))


def test_guard_stands_on_top_of_the_most_findings(spark):
    found = spark.createDataFrame([(1, k, f"id{k}", "low", "reduce") for k in range(1, 8)], "doc_id long, rank int, id string, severity string, direction string")
    steps = spark.createDataFrame([(1, False), (2, True)], "doc_id long, canary_ok boolean")
    got = [(r.doc_id, r["rank"], r.id, r.severity) for r in critic.guarded(found, steps).orderBy("rank").collect()]
    assert got[0] == (1, 0, critic.GUARD, "high") and len(got) == 8


def test_scores_of_drafts(spark):
    rng = random.Random(5)
    plain, dashed = ("the cat sat on the mat, and then it left. ", "however — it is — moreover; the framework (again) shows! ")
    text = lambda kind: "".join(rng.choice((kind, kind, plain)) for _ in range(12))
    corpus = [(k, text(plain if k % 2 else dashed)) for k in range(24)]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    fitted = reference.fit(docs, "both", {"word": 20, "gram": 30, "punct": 20})
    new = spark.createDataFrame([(100, text(plain)), (101, dashed * 12), (102, "")], "doc_id long, text string")
    targets = reference.profile(docs.where("doc_id % 2 = 1 AND doc_id < 10"), fitted)
    bins = spark.createDataFrame([(50, [0.1 * k for k in range(40)], [1 + 0.1 * k for k in range(40)])], "tokens int, same array<double>, different array<double>")
    lengths = docs.unionByName(new).select("doc_id", F.size(F.split("text", " ")).alias("tokens"))
    got = {r.doc_id: r for r in critic.score(fitted, reference.profile(new, fitted), targets, lengths, bins).collect()}
    assert got[100].capped <= got[100].distance and got[100].reported < got[101].reported and got[100].canary < got[101].canary and got[100].p_same > got[101].p_same
    assert set(got) == {100, 101, 102} and all(r.target % 2 == 1 for r in got.values())
    blind = critic.with_content(critic.score(fitted, reference.profile(new, fitted), targets, lengths), new)
    steps = critic.advance(blind.withColumns({"session": F.lit(1), "at": F.col("doc_id")})).collect()
    assert [r.exit_code for r in steps] == [2, 2, 2] and steps[0].content_overlap is None
    median = reference.review(fitted, reference.profile(new, fitted), targets).collect()
    assert {r.doc_id: r.target for r in median} == {d: r.target for d, r in got.items()} and all(abs(got[r.doc_id].canary - r.canary_gap) < 1e-9 for r in median)


def test_content_of_a_draft(spark):
    docs = spark.createDataFrame([(1, "The cats of Rome, the cats"), (2, None)], "doc_id long, text string")
    held = {r.doc_id: r for r in critique.fingerprint(docs, ("the",)).collect()}
    assert sorted(held[1].words) == ["cats", "rome"] and held[2].words == [] and held[2].grams == []
