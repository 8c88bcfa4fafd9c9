"""Operator 4, URL filters: pattern rules behind an index of their rarest literal token.

A rule is a host with a path prefix (`example.com/en/`, which fits the host and its subdomains) or a
pattern in slashes (`/\\bcasino\\b/`, a regular expression on the lower-cased host and path); either way it
has literal tokens, runs of a-z and 0-9 that every url it fits must contain whole. The index holds a rule
under the token that the fewest urls have, counted over the distinct urls of all pages. The tokens of each distinct url fetch
candidate rules by an equi-join, and only those run their regular expressions. Among rules that fit, host
rules win over patterns, then the longest, then the first by text.

Degenerate rows: null urls and urls without `://` have an empty host and path, fit no rule and get the
verdict MALFORMED; repeated rows get the same verdict; an empty table gives no rows; further columns are
kept, those named as the result's replaced.
"""

from __future__ import annotations

import re
from collections import namedtuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import table

Rule = namedtuple("Rule", "action rule")

#: The contract's rules, then patterns of the method's own.
HOST_RULES = [Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/")]
PATTERNS = [Rule("block", f"/(^|[^a-z0-9]){word}([^a-z0-9]|$)/") for word in ("casino", "porn", "xxx", "warez", "torrent", "doubleclick", "adserver", "phishing")]
UNMATCHED, MALFORMED = "allow", "block"
#: Rules that a broadcast may hold; a longer list is joined by shuffle.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    whole = lambda part: F.when(at > 0, part).otherwise("")
    return whole(F.translate(host, _UPPER, _LOWER)), whole(path)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "-_/~%" else f"\\{c}" if c.isascii() else c for c in text)


def _regex(rule: Rule) -> str:
    if rule.rule.startswith("/"):
        return rule.rule[1:-1]
    host, _, path = rule.rule.partition("/")
    return rf"(?s)^([^/]*\.)?{_quoted(host)}/{_quoted(path)}.*$"


def _tokens(rule: Rule) -> list[str]:
    """Literal tokens that stand between separators in any url that the rule fits."""
    if rule.rule.startswith("/"):
        return re.findall(r"(?:\(\^\|\[\^a-z0-9\]\))([a-z0-9]+)(?:\(\[\^a-z0-9\]\|\$\))", rule.rule)
    host, _, path = rule.rule.partition("/")
    whole = path if re.search(r"[^A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", path)
    return [t for t in re.split(r"[^a-z0-9]+", host) if t] + [t for t in re.split(r"[^a-z0-9]+", whole.translate(str.maketrans(_UPPER, _LOWER))) if t]


def _url_tokens(host: F.Column, path: F.Column) -> F.Column:
    return F.array_distinct(F.split(F.translate(F.concat(host, F.lit("/"), path), _UPPER, _LOWER), "[^a-z0-9]+"))


def index_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, action, rule, regex, is_host): each rule under its rarest token; urls has host and path."""
    spark = urls.sparkSession
    tokens = {rule: _tokens(rule) for rule in rules}
    for rule, found in tokens.items():
        if not found:
            raise ValueError(f"rule without a literal token: {rule.rule}")
    wanted = sorted({t for found in tokens.values() for t in found})
    seen = urls.select(F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token")).where(F.col("token").isin(wanted)).groupBy("token").count()
    often = {row.token: row["count"] for row in seen.collect()}  # one row for each token of a rule at most
    rows = [(min(found, key=lambda t: (often.get(t, 0), t)), *rule, _regex(rule), not rule.rule.startswith("/")) for rule, found in tokens.items()]
    listed = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(row, ("token", "action", "rule", "regex", "is_host"), strict=True))) for row in rows)))
    out = spark.range(1).select(listed.alias("r")).select("r.*")
    return F.broadcast(out) if len(rows) <= BROADCAST_RULES else out


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """All columns of pages, then host, path, rule and verdict."""
    host, path = host_and_path(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict", "__spread").withColumn("host", host).withColumn("path", path)
    urls = pages.where("host != '' OR path != ''").select("host", "path").distinct()
    index = index_rules(urls, rules)
    candidates = urls.withColumn("token", F.explode(_url_tokens(F.col("host"), F.col("path")))).join(index, "token")
    subject = F.when(F.col("is_host"), F.concat("host", F.when(F.col("path") == "", "").otherwise(F.col("path")))).otherwise(F.translate(F.concat("host", "path"), _UPPER, _LOWER))
    hits = candidates.where(F.regexp(subject, F.col("regex"))).groupBy("host", "path").agg(
        F.max(F.struct("is_host", F.length("rule").alias("size"), F.col("rule"), F.col("action"))).alias("best")
    )
    # Pages without host and path, which may be many and have no hit, are dealt by their hash.
    spread = F.when((F.col("host") == "") & (F.col("path") == ""), F.pmod(F.xxhash64(*pages.columns), F.lit(1 << 20)) + 1).otherwise(0).cast("long")
    matched = pages.withColumn("__spread", spread).join(hits.withColumn("__spread", F.lit(0).cast("long")), ["host", "path", "__spread"], "left")
    parsed = F.locate("://", F.coalesce("url", F.lit(""))) > 0
    return matched.select(*pages.columns, F.when(F.col("best.is_host"), F.col("best.rule")).alias("rule"), F.coalesce("best.action", F.when(parsed, UNMATCHED).otherwise(MALFORMED)).alias("verdict"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES + PATTERNS).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parsed AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, rest,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parsed
), rules(action, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), ranked AS (
  SELECT s.*, r.action, r.host || r.path AS rule FROM split s
  LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
), best AS (
  SELECT page_id, rest, host, path, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM ranked GROUP BY ALL
)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN rest IS NULL
         OR regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])(casino|porn|xxx|warez|torrent|doubleclick|adserver|phishing)([^a-z0-9]|$)')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""
