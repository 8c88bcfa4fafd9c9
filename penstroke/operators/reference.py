"""A fitted reference: dimensions chosen from a corpus with their statistics, against which documents are profiled.

A family of dimensions chooses its items from a corpus (`fit`) and measures documents over them (`measure`). A reference holds the
items in order, which is the order of its dimensions, and statistics of each; it is a few thousand rows at most, so it is held
in the driver, and saved as Parquet with its description as JSON. Profiles carry its fingerprint; those of different references are not compared."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstroke.functions import words as W
from penstroke.functions.text import lengths
from penstroke.operators import devices, distance, features, vocabulary

#: Versions of how text is read; a reference of another version would be silently reinterpreted, so it is refused.
METHODS = {"tokens": 1, "gram_types": 1, "marks": 1}
ITEM = "family string, idx long, dim string, unit string"
STATISTICS = ("n", "mean", "sd", "scale", "min", "max", "p05", "p25", "p50", "p75", "p95")


@dataclass(frozen=True)
class Family:
    """fit(docs, k) gives (idx, dim) of the family; measure(docs, dims) gives (doc_id, dim, value) of documents for which it is defined."""

    unit: str
    fit: Callable[[DataFrame, int], DataFrame]
    measure: Callable[[DataFrame, DataFrame], DataFrame]
    #: Raised when what is measured under a name changes.
    version: int = 1
    #: All measures of documents, where the dimensions are those that a corpus has a value for, in order of name.
    every: Callable[[DataFrame], DataFrame] | None = None


def _words(docs: DataFrame, dims: DataFrame) -> DataFrame:
    rates = vocabulary.word_rates(docs, dims.select(F.expr("substring(dim, 6)").alias("term")))
    return rates.select("doc_id", F.concat(F.lit("word:"), "term").alias("dim"), "value")


def _grams(docs: DataFrame, dims: DataFrame) -> DataFrame:
    named = dims.select(F.split("dim", ":", 3).alias("p")).select(F.get("p", F.lit(1)).alias("type"), F.get("p", F.lit(2)).alias("gram"))
    return vocabulary.gram_rates(docs, named, 3).select("doc_id", F.concat(F.lit("gram:"), "term").alias("dim"), "value")


def _ranked(top: DataFrame, dim: F.Column) -> DataFrame:
    return top.select((F.col("rank") - 1).cast("long").alias("idx"), dim.alias("dim"))


FAMILIES = {
    "word": Family("frequency", lambda docs, k: _ranked(vocabulary.most_frequent(docs, k), F.concat(F.lit("word:"), "term")), _words),
    "gram": Family("frequency", lambda docs, k: _ranked(vocabulary.ranked_grams(docs, 3, k), F.concat_ws(":", F.lit("gram"), "type", "gram")), _grams),
    "punct": Family(
        "per_1k",
        lambda docs, k: docs.sparkSession.createDataFrame([(i, f"punct:{m}_rate") for i, m in enumerate(W.MARKS)][:k], "idx long, dim string"),
        lambda docs, dims: features.mark_rates(docs).join(F.broadcast(dims.select("dim")), "dim", "left_semi").select("doc_id", "dim", "value"),
    ),
}


def measured(unit: str, measures: Callable[[DataFrame], DataFrame], version: int = 1) -> Family:
    """A family whose dimensions are those that a corpus has a value for, in order of name."""

    def fit_(docs: DataFrame, k: int) -> DataFrame:
        dims = measures(docs).where("value IS NOT NULL").select("dim").distinct().orderBy("dim").limit(k)
        return dims.withColumn("idx", F.row_number().over(Window.orderBy("dim")).cast("long") - 1)  # k rows

    return Family(unit, fit_, lambda docs, dims: measures(docs).join(F.broadcast(dims.select("dim")), "dim", "left_semi").select("doc_id", "dim", "value"), version, measures)  # dims: a reference's


def register(name: str, family: Family) -> None:
    """Add a family of one's own; a name is given once."""
    if name in FAMILIES:
        raise ValueError(f"there is a family {name}")
    FAMILIES[name] = family


for _name, _family in {
    "style": measured("fraction", features.style_ratios), "slips": measured("per_1k", features.informality), "kinds": measured("per_1k", features.kinds), "letters": measured("frequency", features.letters),
    "word_lengths": measured("index", features.word_lengths), "sentence_lengths": measured("tokens", features.sentence_dispersion), "sentences": measured("index", features.sentence_counts), "openers": measured("per_100_sentences", features.openers),
    "markers": measured("per_1k", features.markers), "markdown": measured("per_1k", features.markdown), "punch": measured("per_100_sentences", features.punch_rate), "richness": measured("index", features.richness),
    "moving_types": measured("fraction", features.mattr), "readability": measured("index", features.readability), "register": measured("per_1k", features.register), "alliteration": measured("index", features.alliteration),
    "escalation": measured("index", features.escalation), "participles": measured("per_1k", features.participial), "texture": measured("per_1k", devices.texture), "clauses": measured("per_100_sentences", devices.clause_shape),
    "headlines": measured("per_100_sentences", devices.marketing), "passives": measured("per_100_sentences", devices.passives), "frames": measured("per_1k", devices.frames), "links": measured("per_1k", devices.links), "asides": measured("index", devices.asides),
}.items():
    register(_name, _family)


@dataclass(frozen=True)
class Reference:
    name: str
    version: str
    metric: str
    dims: list[dict]
    methods: dict[str, int] = field(default_factory=lambda: dict(METHODS))

    @property
    def fingerprint(self) -> str:
        return f"{self.name}@{self.version}/{len(self.dims)}d"

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each dimension, in order of idx."""
        kinds = ", ".join(["n long", *(f"{c} double" for c in STATISTICS[1:]), "degenerate boolean"])
        names = [*(c.split()[0] for c in ITEM.split(", ")), *STATISTICS, "degenerate"]
        return spark.createDataFrame([tuple(d[c] for c in names) for d in self.dims], f"{ITEM}, {kinds}").coalesce(1)


def measure(docs: DataFrame, dims: DataFrame, families: list[str]) -> DataFrame:
    """(doc_id, dim, value) over the dimensions of some families."""
    parts = [FAMILIES[f].measure(docs, dims.where(F.col("family") == f).select("idx", "dim")) for f in families]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit(docs: DataFrame, name: str, sizes: dict[str, int], metric: str = "burrows", version: str = "1") -> Reference:
    """Choose the dimensions of each family (at most sizes[family] of them) and take their statistics over docs (doc_id, text)."""
    spark, items, stats = docs.sparkSession, [], {}
    for family, k in sizes.items():
        if every := FAMILIES[family].every:  # one pass gives the dimensions and their statistics
            rows = distance.dim_stats(every(docs), 0.0).orderBy("dim").limit(k).collect()  # k rows
            stats |= {r.dim: r.asDict() for r in rows}
        else:
            rows = FAMILIES[family].fit(docs, k).orderBy("idx").collect()  # k rows
        for row in rows:
            items.append({"family": family, "idx": len(items), "dim": row.dim, "unit": FAMILIES[family].unit})
    if len({i["dim"] for i in items}) < len(items):
        raise ValueError("two families give one dimension")
    if chosen := [f for f in sizes if not FAMILIES[f].every]:
        dims = spark.createDataFrame([tuple(i.values()) for i in items], ITEM).coalesce(1)
        stats |= {r.dim: r.asDict() for r in distance.dim_stats(measure(docs, dims, chosen), 0.0).collect()}  # a row for each dimension
    missing = {c: None for c in STATISTICS} | {"n": 0, "degenerate": True}
    for i in items:
        i |= {c: v for c, v in stats.get(i["dim"], missing).items() if c != "dim"}
        i["scale"] = max(i["sd"] or 0.0, W.NOISE_FLOORS[i["unit"]])
    out = Reference(name, version, metric, items, methods_of(sizes))
    validate(out)
    return out


def methods_of(families: Iterable[str]) -> dict[str, int]:
    """Versions of how text is read and of what the families measure."""
    return METHODS | {f"family {name}": FAMILIES[name].version for name in families}


def validate(reference: Reference) -> None:
    """Raise ValueError where a reference can't be used as it was fitted."""
    if reference.metric not in distance.METRICS:
        raise ValueError(f"unknown metric: {reference.metric}")
    if not reference.dims:
        raise ValueError("no dimension")
    families = {d["family"] for d in reference.dims}
    if unknown := families - FAMILIES.keys():
        raise ValueError(f"unknown families: {sorted(unknown)}")
    # A family that found no dimension has a version all the same.
    known = methods_of(families | {m.removeprefix("family ") for m in reference.methods if m.removeprefix("family ") in FAMILIES})
    if reference.methods != known:
        raise ValueError(f"fitted by other methods: {reference.methods}; this library has {known}; fit it again")
    if [d["idx"] for d in reference.dims] != list(range(len(reference.dims))) or len({d["dim"] for d in reference.dims}) < len(reference.dims):
        raise ValueError("dimensions are not numbered in order, or one is there twice")
    for d in reference.dims:
        if not d["scale"] > 0 or d["n"] and not all(math.isfinite(d[c]) for c in STATISTICS):
            raise ValueError(f"statistics of {d['dim']} are no numbers")


def save(reference: Reference, spark: SparkSession, path: str) -> None:
    """Write a new folder with `dims` (Parquet, so numbers keep all bits) and `about` (JSON)."""
    about = {k: v for k, v in asdict(reference).items() if k != "dims"} | {"fingerprint": reference.fingerprint}
    reference.table(spark).write.parquet(f"{path}/dims")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Reference:
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    rows = spark.read.parquet(f"{path}/dims").orderBy("idx").collect()  # a row for each dimension
    out = Reference(about["name"], about["version"], about["metric"], [r.asDict() for r in rows], about["methods"])
    validate(out)
    if out.fingerprint != about["fingerprint"]:
        raise ValueError(f"{out.fingerprint} was saved as {about['fingerprint']}")
    return out


def profile(docs: DataFrame, reference: Reference) -> DataFrame:
    """(fingerprint, doc_id, dim, value, z, missing) of each document and dimension: a missing value stands at the mean, with a z of 0."""
    validate(reference)
    dims = reference.table(docs.sparkSession)
    families = list(dict.fromkeys(d["family"] for d in reference.dims))
    held = measure(docs, dims, families).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("held"))
    dense = docs.select("doc_id").distinct().join(held, "doc_id", "left").crossJoin(F.broadcast(dims.select("dim", "mean", "scale")))  # the dimensions are few
    value = F.try_element_at("held", F.col("dim"))
    filled = F.coalesce(value, "mean")
    return dense.select(F.lit(reference.fingerprint).alias("fingerprint"), "doc_id", "dim", filled.alias("value"), F.coalesce((filled - F.col("mean")) / F.col("scale"), F.lit(0.0)).alias("z"), value.isNull().alias("missing"))


def compare(reference: Reference, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, distance, rank): the candidates of each query, nearest first; both are profiles of this reference, and queries are few."""
    for side in (queries, candidates):
        other = side.where(F.col("fingerprint") != reference.fingerprint).select("fingerprint").head(1)
        if other:
            raise ValueError(f"a profile of {other[0].fingerprint} can't be compared by {reference.fingerprint}")
    dims = reference.table(queries.sparkSession).select("dim", "idx")
    vectors = [side.join(F.broadcast(dims), "dim").groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("idx", "z"))).alias("z")) for side in (queries, candidates)]
    return distance.ranked(distance.between(*vectors, len(reference.dims), reference.metric))


def family_gaps(profiles: DataFrame, reference: Reference) -> DataFrame:
    """(doc_id, family, gap): mean distance of a document's z-scores from the corpus mean, by family."""
    dims = reference.table(profiles.sparkSession).select("dim", "family")
    return profiles.join(F.broadcast(dims), "dim").groupBy("doc_id", "family").agg(F.avg(F.abs("z")).alias("gap"))


#: Families held out in the place of one that a reference lacks, those hardest to write toward first.
CANARIES = ("gram", "word", "richness")


def resolve_canary(families: list[str], wanted: str | None) -> tuple[str | None, str | None]:
    """The family to hold out of a critique, and a note where it isn't the one wanted."""
    held = next((f for f in (wanted, *CANARIES) if f in families), None) if wanted else None
    if held and held == wanted:
        return held, None
    why = f"family {wanted} is not in this reference" if wanted else "no family is held out"
    return held, f"{why}; {held} is held out instead" if held else f"{why}: writing toward the findings will not be noticed"


def review(reference: Reference, drafts: DataFrame, targets: DataFrame, canary: str | None = "gram") -> DataFrame:
    """(doc_id, target, distance, canary_gap) of drafts: the target of median distance, so that one unusual target counts for little, and the mean
    distance from it over the held-out family, which shows drafts that only move where a critique looks. Both are profiles; targets are few."""
    family, _ = resolve_canary([d["family"] for d in reference.dims], canary)
    found = compare(reference, drafts, targets).withColumn("n", F.count("*").over(Window.partitionBy("a")))
    chosen = found.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select(F.col("a").alias("doc_id"), F.col("b").alias("target"), "distance")
    held = F.broadcast(reference.table(drafts.sparkSession).where(F.col("family") == F.lit(family)).select("dim"))
    mine = drafts.join(held, "dim").select("doc_id", "dim", "z")
    theirs = targets.join(held, "dim").select(F.col("doc_id").alias("target"), "dim", F.col("z").alias("aim"))
    gaps = chosen.join(mine, "doc_id").join(theirs, ["target", "dim"]).groupBy("doc_id").agg(F.avg(F.abs(F.col("z") - F.col("aim"))).alias("canary_gap"))
    return chosen.join(gaps, "doc_id", "left")


def coverage(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, tokens, missing): length of a document and the number of dimensions that it has no value for."""
    return lengths(docs).join(profiles.groupBy("doc_id").agg(F.count_if("missing").alias("missing")), "doc_id")
