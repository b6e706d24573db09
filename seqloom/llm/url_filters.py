"""URL filters: host-suffix and path-prefix expressions joined with rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import lower_ascii, small

#: Hex digits of a digest's prefix that the join compares; full digests are compared after it.
PREFIX = 8
#: The contract's rules: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split_url(url):
    """Host and path of a URL as Columns; both empty without `://` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def apply_rules(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """The pages with host, path, rule and verdict (existing columns of these names give way).

    rules: host, path, verdict. A rule fits its host and subdomains where the path starts with the rule's path.
    The longest rule wins, then the one with the longer host, then block over allow. Each different URL expands into
    its host suffixes and path prefixes, of as many labels and characters as rules have, so a long URL makes no more
    of them than a short one; the expressions meet the rules on PREFIX digits of their digests, then by full digest.
    Only URLs are shuffled for it, and what a rule fits is joined back. Null and odd URLs have an empty host and meet
    no rule, so they get the default. Repeated rows stay repeated; null rule parts never fit. Empty tables of pages
    give no rows, empty tables of rules the default.
    """
    out = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c not in out]
    url = F.col(f"`{url_column}`")
    listed = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"),
            F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"),
        ).alias("rule"),
    )
    listed = listed.groupBy("digest").agg(F.max("rule").alias("hit")).withColumn("prefix", F.substring("digest", 1, PREFIX))
    # the different numbers of labels and lengths of paths that rules have: one row, no longer than the longest rule
    some = lambda c: F.coalesce(F.sort_array(F.collect_set(c)), F.array().cast("array<int>"))
    shapes = rules.agg(some(F.size(F.split("host", "\\."))).alias("counts"), some(F.length("path")).alias("lengths"))
    each = pages.filter(F.locate("://", url) > 0).select(url.alias("url")).distinct()
    host, path = split_url(F.col("url"))
    base = each.select("url", host.alias("host"), path.alias("path")).crossJoin(F.broadcast(shapes))
    labels = F.size(F.split("host", "\\."))
    suffixes = F.transform(F.filter("counts", lambda n: (n <= labels) & (F.col("host") != "")), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    exprs = base.withColumn("suffixes", suffixes).withColumn("prefixes", prefixes)
    exprs = exprs.select("url", F.explode(F.flatten(F.transform("suffixes", lambda s: F.transform("prefixes", lambda p: F.concat_ws("\n", s, p))))).alias("expr"))
    wide = exprs.select("url", F.sha2("expr", 256).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX))
    met = wide.join(small(listed.withColumnRenamed("digest", "full")), F.col("short") == F.col("prefix")).filter(F.col("digest") == F.col("full"))
    best = met.groupBy(F.col("url").alias("fit_url")).agg(F.max("hit").alias("fit_hit"))
    host, path = split_url(url)
    found = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), url.alias("fit_by")).join(best, F.col("fit_by") == F.col("fit_url"), "left")
    return found.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("fit_hit.rule").alias("rule"), F.coalesce("fit_hit.verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the verdict on every page's URL."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return apply_rules(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT b.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC NULLS LAST) AS k FROM b LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM c WHERE k = 1
"""
