"""Fitted references: what is kept through a save, and what is refused."""

import dataclasses

import pytest
from penstroke.operators import agreement, reference


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["The cat - a grey one - sat on the mat, and the dog sat by it.", "A dog, the old one, lay down; the cat did not.", "No, no: the mat (the red mat) is the cat's!", "", None, "?"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def fitted(docs):
    return reference.fit(docs, "small", {"word": 5, "punct": 32, "gram": 6})


def rows(profiles):
    return sorted(map(tuple, profiles.collect()))


def test_round_trip(spark, docs, fitted, tmp_path):
    reference.save(fitted, spark, str(tmp_path / "r"))
    back = reference.load(spark, str(tmp_path / "r"))
    assert back == fitted and back.fingerprint == "small@1/43d" == fitted.fingerprint
    assert rows(reference.profile(docs, back)) == rows(reference.profile(docs, fitted))


def test_missing_values_stand_at_the_mean(docs, fitted):
    held = {(r.doc_id, r.dim): r for r in reference.profile(docs, fitted).collect()}
    assert len(held) == 6 * 43
    mean = {d["dim"]: d["mean"] for d in fitted.dims}
    assert all(held[3, d].missing and held[3, d].z == 0 and held[3, d].value == mean[d] for d in mean)
    assert not any(held[0, d].missing for d in mean)
    counted = {r.doc_id: (r.tokens, r.missing) for r in reference.coverage(docs, reference.profile(docs, fitted)).collect()}
    assert counted[3] == (0, 43) and counted[0][1] == 0


def test_profiles_of_another_reference_are_refused(docs, fitted):
    other = dataclasses.replace(fitted, name="other")
    mine, theirs = reference.profile(docs, fitted), reference.profile(docs, other)
    with pytest.raises(ValueError, match="other@1/43d"):
        reference.compare(fitted, mine, theirs)
    found = reference.compare(fitted, mine.where("doc_id = 0"), mine).collect()
    assert min(found, key=lambda r: r["rank"]).b == 0 and sorted(r["rank"] for r in found) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("change", [
    {"metric": "none"}, {"methods": {"tokens": 0}}, {"dims": []}, {"dims": lambda d: d[::-1]}, {"dims": lambda d: [*d, d[0]]}, {"dims": lambda d: [{**d[0], "scale": float("nan")}, *d[1:]]}, {"dims": lambda d: [{**d[0], "family": "x"}, *d[1:]]},
])
def test_broken_references_are_refused(fitted, change):
    with pytest.raises(ValueError):
        reference.validate(dataclasses.replace(fitted, **{k: v(fitted.dims) if callable(v) else v for k, v in change.items()}))


def test_agreement(spark):
    labels = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y"), (None, "x")], "a string, b string")
    n, observed, kappa = agreement.kappa(labels, "a", "b").first()
    assert (n, observed) == (4, 0.75) and abs(kappa - 0.5) < 1e-9
    assert agreement.kappa(labels.where("a = 'y'"), "a", "b").first()["kappa"] != agreement.kappa(labels.where("a = 'y'"), "a", "b").first()["kappa"]
    assert agreement.kappa(labels.limit(0), "a", "b").count() == 0
    scores = spark.createDataFrame([(float(k), False) for k in range(11)] + [(9.0, True), (8.9, True), (20.0, True)], "score double, positive boolean")
    threshold, tpr = agreement.detection(scores, 0.1).first()
    assert threshold == 9.0 and abs(tpr - 2 / 3) < 1e-9
    assert tuple(agreement.win_rate(spark.createDataFrame([("win",), ("loss",), ("win",), ("tie",)], "result string")).first()) == (4, 3, 2, 2 / 3)
    assert agreement.win_rate(spark.createDataFrame([("tie",)], "result string")).first().win_rate is None


def test_canaries():
    assert reference.resolve_canary(["word", "gram"], "gram") == ("gram", None)
    assert reference.resolve_canary(["punct", "word"], "rich")[0] == "word" and "instead" in reference.resolve_canary(["punct", "word"], "rich")[1]
    assert reference.resolve_canary(["punct"], "rich")[0] is None and reference.resolve_canary(["gram"], None)[0] is None


def test_review_takes_the_median_target(docs, fitted):
    profiles = reference.profile(docs, fitted)
    found = reference.review(fitted, profiles.where("doc_id = 0"), profiles.where("doc_id IN (0, 1, 2)")).collect()
    order = [r.b for r in sorted(reference.compare(fitted, profiles.where("doc_id = 0"), profiles.where("doc_id IN (0, 1, 2)")).collect(), key=lambda r: r["rank"])]
    assert [(r.doc_id, r.target) for r in found] == [(0, order[1])] and order[0] == 0 and found[0].canary_gap > 0


def test_every_family_can_be_fitted_saved_and_profiled(spark, tmp_path):
    long_ = "However, the old man — who was (as they say) wise — didn't go. He sat down. They were beaten by 3 DOGS! Was it so? It was as cold as ice, and so on and on. # not a heading\n* item\n1. two\n"
    docs = spark.createDataFrame([(k, long_ * (k + 2) + "The cat ran; a dog was seen, running, " * k) for k in range(6)], "doc_id long, text string")
    fitted = reference.fit(docs, "all", dict.fromkeys(reference.FAMILIES, 60))
    found = {d["family"] for d in fitted.dims}
    assert len(found) >= 25 and len(reference.FAMILIES) == 28, set(reference.FAMILIES) - found
    reference.save(fitted, spark, str(tmp_path / "all"))
    assert reference.load(spark, str(tmp_path / "all")) == fitted
    held = reference.profile(docs, fitted)
    assert held.count() == 6 * len(fitted.dims) and {r.family for r in reference.family_gaps(held, fitted).collect()} == found


def test_families_have_versions_and_names(docs, fitted, monkeypatch):
    with pytest.raises(ValueError, match="there is a family"):
        reference.register("word", reference.FAMILIES["word"])
    newer = dataclasses.replace(reference.FAMILIES["punct"], version=2)
    monkeypatch.setitem(reference.FAMILIES, "punct", newer)
    with pytest.raises(ValueError, match="fit it again"):
        reference.validate(fitted)
    monkeypatch.setitem(reference.FAMILIES, "own", reference.measured("per_1k", lambda d: d.selectExpr("doc_id", "'own:length' AS dim", "cast(length(text) AS double) AS value")))
    own = reference.fit(docs, "mine", {"own": 5})
    assert [(d["dim"], d["max"]) for d in own.dims] == [("own:length", 61.0)]
