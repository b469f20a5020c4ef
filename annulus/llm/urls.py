"""URL filters against host and path rules, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query op9: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path: what follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def to_last_slash(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", prefix: int = 8) -> DataFrame:
    """`pages` with host, path, rule and verdict.

    `rules` has (verdict, host, path). A rule fits its host and all subdomains if the url's path starts with
    its path; the longest rule text wins, then the longest host, then `block`. Without a rule: `default`.

    Each distinct url is expanded into its host suffixes and its path prefixes that end in `/` (and the empty
    one), at the depths that some rule has and at no others, so that the work on a url grows with its length; a rule is filed under its host and
    its path up to the last `/`. Both are joined on the first
    `prefix` hexadecimal digits of a SHA-256; candidates are then confirmed by the full digest of that key and of the
    whole rule text. Null urls or urls without `://` have an empty host and path and get the default; repeated rows each get
    their row back; columns of `pages` called host, path, rule or verdict are replaced, and others come back whatever their names; empty tables are fine.
    Rules are joined by Spark's own size check: broadcast while they are few, else by a sorted join whose hot keys (all hosts under `com`) adaptive execution splits.
    """
    sep = F.lit("\n")  # in no key twice: hosts come first and a path starts with "/" or is empty
    rows = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    sites = rows.select("host", "path").distinct()
    r = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path")).dropDuplicates()
    # The depths at which rules are filed, in one row: labels of the host and slashes of the path. A url is cut at these alone.
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    labels = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1
    depths = r.agg(F.collect_set(F.struct(labels(F.col("r_host")).alias("labels"), slashes(F.col("r_path")).alias("slashes"))).alias("depths"))
    keys = sites.join(F.broadcast(depths), F.lit(True)).select("host", "path", labels(F.col("host")).alias("n"), slashes(F.col("path")).alias("m"), F.explode("depths").alias("d")).where("d.labels <= n and d.slashes <= m")
    lead = F.when(F.col("d.slashes") == 0, "").otherwise(F.concat(F.call_function("substring_index", "path", F.lit("/"), F.col("d.slashes")), F.lit("/")))
    keys = keys.select("host", "path", F.call_function("substring_index", "host", F.lit("."), -F.col("d.labels")).alias("suffix"), lead.alias("lead"))
    keys = keys.withColumn("digest", F.sha2(F.concat("suffix", sep, "lead"), 256)).withColumn("short", F.substring("digest", 1, prefix))
    r = r.withColumn("r_digest", F.sha2(F.concat("r_host", sep, to_last_slash(F.col("r_path"))), 256)).withColumn("short", F.substring("r_digest", 1, prefix)).withColumn("r_full", F.sha2(F.concat("r_host", sep, "r_path"), 256))
    begins = F.sha2(F.concat("suffix", sep, F.expr("substring(path, 1, length(r_path))")), 256)
    hit = keys.join(r, "short").where((F.col("digest") == F.col("r_digest")) & (begins == F.col("r_full")))
    rule = F.concat("r_host", "r_path")
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), (F.col("verdict") == "block").alias("b"), rule.alias("rule"), F.col("verdict").alias("verdict"))).alias("best"))
    same = F.expr("r.host = b.host and r.path = b.path")
    given = [F.col(f"r.`{c}`") for c in rows.columns]
    return rows.alias("r").join(best.alias("b"), same, "left").select(*given, F.col("b.best.rule").alias("rule"), F.coalesce("b.best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
d AS (SELECT DISTINCT host, path FROM u),
f AS (SELECT host, path, h || p AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS n
      FROM d JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM u LEFT JOIN f ON f.n = 1 AND u.host = f.host AND u.path = f.path
"""
