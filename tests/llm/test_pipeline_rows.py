"""Every stage of the pipeline on odd tables."""

import random

import corpus_pipeline
import pytest


@pytest.fixture
def folder(spark, tmp_path):
    """Benchmark tables with a passage, and without a row."""
    for name, rows in (("some", [(1, "A benchmark passage of the length that an item needs to be found again by its q-grams."), (2, None)]), ("none", [])):
        spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / name / "benchmark.parquet"))
    return tmp_path


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("bench", ["some", "none"])
def test_odd_rows(spark, folder, bench):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, held = text(60), "A benchmark passage of the length that an item needs to be found again by its q-grams."
    texts = [base, base, base + " more", text(50) + " " + held + " " + text(20), text(40) + " password = hunter22x", text(9000)] + [text(50) for _ in range(20)]
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)] + [(0, base, "en", "a", len(base)), (7, texts[7], "en", "b", None), (None, texts[8], "en", "a", 1), (50, None, None, None, None), (51, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(folder / bench))
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), COLUMNS)
            seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {name: sorted(str(d) for d, _ in found) for name, found in seen.items()}
    assert {"50", "51"}.isdisjoint(ids["quality_rules"])
    assert ids["quality_rules"].count("0") == 2 and ids["near_duplicates"].count("0") == 1 and ids["near_duplicates"].count("7") == 1
    assert {"1", "2"}.isdisjoint(ids["near_duplicates"]) and "None" in ids["near_duplicates"]
    assert ("3" in ids["decontamination"]) == (bench == "none")
    assert "hunter22x" not in dict(seen["secret_scan"])[4] and len(dict(seen["secret_scan"])[5].split()) == 9000
    assert sum(r.n_tokens for r in out.collect()) == sum(len(t.split()) for _, t in seen["secret_scan"])


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(folder / "none")).count() == 0
