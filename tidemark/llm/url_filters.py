"""URL filters (operator 7): host-suffix and path-prefix rules, found by hash.

Every url is expanded into expressions: each suffix of its host's labels beside each prefix of its path. Expressions meet
the rules on a short hash, the full digest confirms, and the longest rule wins. Only suffixes of as many labels, and
prefixes of as many characters, as some rule has are built, so that the number of expressions follows the rules and not
the length of urls.

Defined results: null urls and urls without ``://`` have an empty host and path and get the default verdict; repeated rows
are judged each; of rules of equal length, the longer host wins, then block, then the greater text; no rules or no pages
give defaults or nothing; other columns are ignored.

Hot hosts: expressions of distinct urls only are joined; a url that fills a third of the rows is one row there, and the
join back to the pages is a plain join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Rules of the registered query: fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _short(digest: Column) -> Column:
    """The first four bytes of a digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (page_id, url).

    ``rules``: rows of (host, path, verdict). The label counts and path lengths of the rules are read to the driver: two
    sets of small numbers, at most as many as a url has labels and characters.
    """
    spans = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    rules = rules.select(
        F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
    ).withColumn("short", _short(F.col("rule_digest")))
    urls = pages.select(F.col("url").cast("string").alias("url")).where(F.col("url").isNotNull()).distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in sorted(spans["labels"])])) if spans["labels"] else F.array().cast("array<string>")
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in sorted(spans["lengths"])])) if spans["lengths"] else F.array().cast("array<string>")
    expressions = (
        parts.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        .select("url", _digest(F.col("suffix"), F.col("prefix")).alias("digest"), "suffix")
        .withColumn("short", _short(F.col("digest")))
    )
    found = expressions.join(rules, "short").where((F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")))
    rank = F.struct(F.length("rule").alias("length"), F.length("rule_host").alias("host_length"), (F.col("rule_verdict") == "block").alias("blocks"), F.col("rule"), F.col("rule_verdict"))
    winners = found.groupBy("url").agg(F.max(rank).alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    return rows.join(winners, "url", "left").select(
        "page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS tail FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path,
  CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'allow'
       WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'block'
       WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'allow'
       WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""
