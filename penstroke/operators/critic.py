"""The loop around a critique: drafts of one session, judged one after another, with guards against writing for the critique.

Each draft is scored by itself (`score`): distance to the target of median distance, capped so that no dimension buys a pass, what that is worth
(p_same), and its gaps over the reported families and over one that is held out. The loop (`advance`) then needs of a session only the scores of
the draft before and the content of the first: `advance` finds them by windows over a table, `advance_stream` keeps them as state by
session, and both give the same rows for the same drafts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from penstroke.operators import calibrate, critique, distance
from penstroke.operators import reference as references

#: Least p_same that passes, least content a draft must share with the first, and the share of change that counts as better or worse.
PASS, LEAST_OVERLAP, CHANGE = 0.10, 0.5, 0.01
#: Most of a distance that one dimension counts for.
SHARE = 0.25
GUARD = "guard.feedback_overfitting"


def score(reference: references.Reference, drafts: DataFrame, targets: DataFrame, lengths: DataFrame, bins: DataFrame | None = None, canary: str | None = "gram") -> DataFrame:
    """(doc_id, target, distance, capped, p_same, p_unrelated, reported, canary) of drafts; both are profiles of the reference, lengths is (doc_id,
    tokens) of both, targets are few. Without calibration (bins) there is no p_same."""
    family, _ = references.resolve_canary([d["family"] for d in reference.dims], canary)
    dims = reference.table(drafts.sparkSession).select("dim", "family", "idx")
    order = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    found = references.compare(reference, drafts, targets).withColumn("at", order).withColumn("n", F.count("*").over(Window.partitionBy("a")))
    chosen = found.where(F.col("at") == F.floor(F.col("n") / 2) + 1).select(F.col("a").alias("doc_id"), F.col("b").alias("target"), "distance")
    mine = chosen.join(drafts.select("doc_id", "dim", F.col("z").alias("x")), "doc_id")
    both = mine.join(targets.select(F.col("doc_id").alias("target"), "dim", F.col("z").alias("y")), ["target", "dim"])
    terms = distance.contributions(both.select(F.col("doc_id").alias("a"), F.col("target").alias("b"), "dim", "x", "y"), reference.metric, dims.select("dim", "idx"))
    capped = critique.capped_distance(terms, SHARE).select(F.col("a").alias("doc_id"), (F.col("distance") + (1.0 if reference.metric == "cosine" else 0.0)).alias("capped"))
    gap, held = F.abs(F.col("x") - F.col("y")), F.col("family") == F.lit(family)
    gaps = both.join(dims, "dim").groupBy("doc_id").agg(
        F.coalesce(F.avg(F.when(~F.coalesce(held, F.lit(False)), gap)), F.lit(0.0)).alias("reported"), F.coalesce(F.avg(F.when(held, gap)), F.lit(0.0)).alias("canary"))
    out = chosen.join(capped, "doc_id").join(gaps, "doc_id")
    if bins is None:
        return out.withColumns({"p_same": F.lit(None).cast("double"), "p_unrelated": F.lit(None).cast("double")})
    sized = out.join(lengths.withColumnRenamed("tokens", "tokens_a"), "doc_id").join(lengths.select(F.col("doc_id").alias("target"), F.col("tokens").alias("tokens_b")), "target")
    worth = calibrate.assess(sized.select(F.col("doc_id").alias("a"), F.col("target").alias("b"), F.col("capped").alias("distance"), "tokens_a", "tokens_b"), bins)
    return out.join(worth.select(F.col("a").alias("doc_id"), "p_same", "p_unrelated"), "doc_id")


def with_content(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """scored with words and grams, the content of each draft (docs: doc_id, text)."""
    return scored.join(critique.fingerprint(docs), "doc_id")


def exit_code(passed: Column) -> Column:
    """0 for a draft that passes, 1 for one that doesn't, 2 where that could not be told."""
    return F.when(passed.isNull(), 2).when(passed, 0).otherwise(1)


COLUMNS = "session {session}, doc_id {doc_id}, iteration long, passed boolean, canary_ok boolean, drift_ok boolean, content_overlap double, exit_code int"


def advance(scored: DataFrame, has_canary: bool = True) -> DataFrame:
    """(session, doc_id, iteration, passed, canary_ok, drift_ok, content_overlap, exit_code) of drafts (session, at, doc_id, reported, canary, p_same,
    words, grams), `at` giving their order: the canary fails where the reported families got better and the held-out one worse than in
    the draft before, drift where too little is left of the first draft, which has no overlap itself."""
    order = Window.partitionBy("session").orderBy("at", "doc_id")
    first = lambda c: F.first(c).over(order)
    before = lambda c: F.lag(c).over(order)
    number = F.row_number().over(order).cast("long")
    overlap = (critique.overlap(F.col("words"), first("words")) + critique.overlap(F.col("grams"), first("grams"))) / 2
    tripped = (F.col("reported") < before("reported") * (1 - CHANGE)) & (F.col("canary") > before("canary") * (1 + CHANGE))
    passed = F.col("p_same") >= PASS
    framed = scored.select("session", "doc_id", number.alias("iteration"), passed.alias("passed"), (~F.coalesce(tripped, F.lit(False)) | F.lit(not has_canary)).alias("canary_ok"), F.when(number > 1, overlap).alias("content_overlap"))
    return framed.select("session", "doc_id", "iteration", "passed", "canary_ok", (F.coalesce("content_overlap", F.lit(1.0)) >= LEAST_OVERLAP).alias("drift_ok"), "content_overlap", exit_code(F.col("passed")).alias("exit_code"))


def _jaccard(a: list[str], b: list[str]) -> float:
    union = len({*a} | {*b})
    return len({*a} & {*b}) / union if union else 1.0


def advance_stream(scored: DataFrame, has_canary: bool = True) -> DataFrame:
    """`advance` of a stream: sessions go on from batch to batch; drafts of a session in one batch are taken in their order."""
    kinds = dict(scored.dtypes)

    def step(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, reported, canary, words, grams = state.get if state.exists else (0, 0.0, 0.0, [], [])
        drafts, out = pd.concat(frames).sort_values(["at", "doc_id"]), []
        for draft in drafts.itertuples(index=False):
            tripped = bool(n) and has_canary and draft.reported < reported * (1 - CHANGE) and draft.canary > canary * (1 + CHANGE)
            overlap = (_jaccard(list(draft.words), list(words)) + _jaccard(list(draft.grams), list(grams))) / 2 if n else None
            if not n:
                words, grams = list(draft.words), list(draft.grams)
            n, reported, canary = n + 1, draft.reported, draft.canary
            passed = None if pd.isna(draft.p_same) else bool(draft.p_same >= PASS)
            out.append((key[0], draft.doc_id, n, passed, not tripped, overlap is None or overlap >= LEAST_OVERLAP, overlap, 2 if passed is None else 1 - passed))
        state.update((n, reported, canary, words, grams))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")]).astype({"passed": object, "content_overlap": float})

    held = "n long, reported double, canary double, words array<string>, grams array<string>"
    return scored.groupBy("session").applyInPandasWithState(step, COLUMNS.format(session=kinds["session"], doc_id=kinds["doc_id"]), held, "append", GroupStateTimeout.NoTimeout)


def guarded(found: DataFrame, steps: DataFrame) -> DataFrame:
    """(doc_id, rank, id, severity, direction): findings, already cut to the most that are shown, with the guard's on top, rank 0, where the canary of
    a step failed: it is one more than the most."""
    guards = steps.where(~F.col("canary_ok")).select("doc_id", F.lit(0).alias("rank"), F.lit(GUARD).alias("id"), F.lit("high").alias("severity"), F.lit("reduce").alias("direction"))
    return found.select("doc_id", "rank", "id", "severity", "direction").unionByName(guards)
