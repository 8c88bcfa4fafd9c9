"""Metre of hand-scanned lines, pronunciations with versions, rhyme and archaism."""

import json

import pytest

from penstroke.operators import metre

ENTRIES = [
    ("compare", 2, "01", "air"), ("summer", 2, "10", None), ("day", 1, "1", "ay"), ("temperate", 3, "100", None), ("may", 1, "1", "ay"), ("away", 2, "01", "ay"), ("th'", 0, "", None), ("heaven", 1, "1", None),
    ("odd", 2, "1", None),
]
VERSE = ["Shall I compare thee to a summer day,", "thou art more lovely and more temperate:", "rough winds do shake the", "Darling buds of May", "", "he goeth, and so goest away. x", "heaven; sits"]


@pytest.fixture(scope="module")
def table(spark):
    return metre.Pronunciations("test", "1", tuple(ENTRIES)).table(spark)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_stress_of_words(spark, table):
    words = spark.createDataFrame([(w,) for w in "compare summer the winds darling lovely heaven odd reading".split()], "w string")
    assert {r.w: (r.n, r.stress) for r in metre.stresses(words, table).collect()} == {
        "compare": (2, "01"), "summer": (2, "10"), "the": (1, "0"), "winds": (1, "1"), "darling": (2, "10"), "lovely": (3, "100"), "heaven": (1, "1"), "odd": (2, "10"), "reading": (2, "10"),
    }


def test_metre_by_hand(spark, table):
    lines = [x for x in VERSE if x]
    prose = "a line that goes on for much longer than fourteen words would ever do in any kind of verse at all\n" * 9
    got = {}
    for r in metre.metre(docs(spark, "\n".join(VERSE), prose, "short\nlines", None), table).collect():
        got.setdefault(r.doc_id, {})[r.dim] = r.value
    assert set(got) == {0}
    # Figures of each line, word by word.
    figures = ["".join(f) for f in (
        ("0", "1", "01", "1", "0", "0", "10", "1"), ("1", "1", "1", "100", "0", "1", "100"), ("1", "1", "0", "1", "0"), ("10", "1", "0", "1"), ("1", "1", "0", "1", "1", "01", "1"), ("1", "1"),
    )]
    k = len(lines)
    assert got[0]["verse:feminine_ending_rate"] == pytest.approx(100 * sum(f[-1] == "0" for f in figures) / k)
    assert got[0]["verse:midline_pause_rate"] == pytest.approx(100 * 2 / k) and got[0]["verse:run_on_rate"] == pytest.approx(100 * 2 / k) and got[0]["verse:stopped_rate"] == pytest.approx(100 * 2 / k)
    for i in range(1, 11):
        there = [f[i - 1] for f in figures if len(f) >= i]
        assert got[0][f"verse:stress:{i}"] == (pytest.approx(sum(x != "0" for x in there) / len(there)) if there else None), i
    hits = sum((x != "0") == (i % 2 == 1) for f in figures for i, x in enumerate(f[:10]))
    assert got[0]["verse:iambic_share"] == pytest.approx(hits / sum(min(10, len(f)) for f in figures))


def test_rhyme_and_archaism(spark, table):
    text = "by the day\nsome may\nthe day\nnothing at all\nrough\nfar away\nthough"
    assert [r.value for r in metre.rhymes(docs(spark, text), table).collect()] == [pytest.approx(100 * 2 / 7)]
    assert [r.value for r in metre.rhymes(docs(spark, text), table, 3).collect()] == [pytest.approx(100 * 3 / 7)]
    found = {r.dim: r.value for r in metre.archaism(docs(spark, "\n".join([*VERSE, "the easiest best guest", "thy you"]))).collect()}
    n = sum(len(x.replace(",", "").split()) for x in [*VERSE, "the easiest best guest", "thy you"])
    assert found == {"verse:thou_you": 3.0, "verse:eth_rate": pytest.approx(1000 / n), "verse:est_rate": pytest.approx(3000 / n)}


def test_versions_are_refused(tmp_path):
    path = tmp_path / "p.json"
    good = {"name": "dict", "version": "2", "entries": [{"word": "day", "syllables": 1, "stress": "1", "rhyme": "ay"}]}
    path.write_text(json.dumps(good))
    found = metre.load(str(path))
    assert found.method == "dict@2" and found.entries == (("day", 1, "1", "ay"),)
    metre.check("dict@2", found)
    for fitted in ("dict@1", metre.Pronunciations().method):
        with pytest.raises(ValueError, match="fitted with"):
            metre.check(fitted, found)
    for bad in ({"version": ""}, {"name": metre.VOWEL_GROUPS}, {"entries": [{"word": "day", "syllables": 2, "stress": "1"}]}, {"entries": good["entries"] * 2}, {"entries": [{"word": "Day", "syllables": 1, "stress": "1"}]}):
        path.write_text(json.dumps(good | bad))
        with pytest.raises(ValueError, match="p.json"):
            metre.load(str(path))
