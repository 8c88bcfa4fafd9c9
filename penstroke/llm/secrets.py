"""Operator 5, secret scans: character Markov models of random strings and of ordinary identifiers.

Base patterns find assigned values, access keys and long hexadecimal runs. Every other run of key
characters is scored by the log-likelihood ratio of two order-2 character models, one trained on
labelled random strings, the other on labelled ordinary words and identifiers; a run becomes a span of
kind `random` when the ratio per character and in all are high. Runs of lower-case letters alone are not scored: such models can't
tell them from words of a language they have not seen. The labelled samples have fixed sizes:
SAMPLES generated strings of each alphabet, and SAMPLES words drawn by hash from the corpus.

Degenerate rows: a null text is an empty one, without spans; repeated rows are each scanned; texts of any length are scanned
whole, in time proportional to it; an empty table gives no rows; further columns are kept and columns of the result's names
replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import table

#: Fixed patterns. ASCII letters of either case in the names; minimum lengths are checked afterwards.
_NAMES = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")
#: Runs that the models judge, their least length, and the least log-likelihood ratio in all and per character.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
TOTAL, EACH = 12.0, 0.5
SAMPLES = 20_000
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-")
SIGNS = 66


def _codes(run: str) -> np.ndarray:
    """0 at the ends, then digits, upper case, lower case, and the rest of a run's characters together by kind."""
    at = np.frombuffer(f"\0{run}\0".encode("ascii"), np.uint8).astype(np.int64)
    out = np.where(at == 0, 0, 63)
    for low, high, base in ((48, 57, 1), (65, 90, 11), (97, 122, 37)):
        inside = (at >= low) & (at <= high)
        out[inside] = at[inside] - low + base
    out[(at == ord("+")) | (at == ord("/"))] = 64
    out[at == ord("=")] = 65
    return out


def train(samples: list[str]) -> np.ndarray:
    """Smoothed log probabilities of a character given the two before it."""
    counts = np.zeros((SIGNS,) * 3)
    for run in samples:
        c = _codes(run)
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    p = np.full(SIGNS, 1 / SIGNS)
    for c in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
        p = (c + 5 * p) / (c.sum(axis=-1, keepdims=True) + 5)
    return np.log(p)


def random_strings(n: int = SAMPLES, seed: int = 7) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(alphabet), rng.integers(16, 49))) for alphabet in ALPHABETS for _ in range(n // len(ALPHABETS))]


def identifiers(words: list[str], n: int = SAMPLES, seed: int = 11) -> list[str]:
    """Words of the corpus, and names made of them as programmers make names."""
    rng = np.random.default_rng(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["value"]
    forms = ("_".join, "-".join, lambda x: "".join(w.capitalize() for w in x), lambda x: x[0] + "".join(w.capitalize() for w in x[1:]), lambda x: "/".join(x).lower(), lambda x: "_".join(x).upper(), lambda x: "".join(x) + str(rng.integers(1, 1000)))
    picks = rng.integers(0, len(words), (n, 4))
    return words + [forms[i % len(forms)]([words[k] for k in row[: 2 + i % 3]]) for i, row in enumerate(picks)] + ["=" * 20, "-" * 20, "_" * 20]


def fit(docs: DataFrame, n: int = SAMPLES) -> np.ndarray:
    """Log ratio of the two models' probabilities. The n words come first in the order of a hash over all documents' words."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col("text").cast("string"), F.lit("([A-Za-z]{3,24})"), 1))).alias("word"))
    drawn = words.groupBy("word").count().where("count > 1").orderBy(F.xxhash64("word"), "word").limit(n)
    return train(random_strings()) - train(identifiers([row.word for row in drawn.collect()]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(x in low for x in HINTS) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def spans_of(text: str, ratio: np.ndarray, total: float = TOTAL, each: float = EACH) -> list[tuple[int, int, str]]:
    """All spans by start, then by kind as listed; a run that a base span touches is not judged again."""
    found = base_spans(text)
    taken, k, reach = sorted((a, b) for a, b, _ in found), 0, 0
    for m in RUN.finditer(text):
        run = m[0]
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach > m.start() or (run.islower() and run.isalpha()):
            continue
        c = _codes(run)
        score = ratio[c[:-2], c[1:-1], c[2:]].sum()
        if score >= total and score >= each * len(run):
            found.append((m.start(), m.end(), "random"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """All columns of docs, then `secrets`, an array of (start, end, kind) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = "array<struct<start:int,end:int,kind:string>>"

    @F.pandas_udf(kind)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in spans_of(t or "", shared.value)] for t in texts])

    return docs.drop("secrets").withColumn("secrets", find(F.col("text").cast("string")))


def redact(docs: DataFrame, ratio: np.ndarray, mark: str = "[secret]") -> DataFrame:
    """docs with each secret of text replaced by a mark; overlapping spans count as one."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans, done, parts = spans_of(t, shared.value) if t else [], 0, []
            for a, b, _ in spans:
                if a >= done:
                    parts += [t[done:a], mark]
                done = max(done, b)
            out.append("".join(parts) + t[done:] if spans else t)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean(F.col("text").cast("string")))


def _joined(spans: list, kinds: tuple[str, ...]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in kinds)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs)).drop("text")
    line = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.transform(F.filter("secrets", lambda s: s["kind"] != "random"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(line, ",").alias("spans")
    )
