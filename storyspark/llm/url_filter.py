"""URL filtering by host-suffix and path-prefix expressions over hash prefixes (DataFrame functions only).

Each distinct URL is expanded into expressions (a suffix of its host at label borders + a prefix of its path); only suffix
and prefix lengths that some rule has are formed, so a URL has at most as many expressions as there are length pairs.
Expressions meet the rules in an equi-join on the first ``PREFIX`` hex digits of their SHA-256, then the full digests are
compared; of the rules that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import table, without

PREFIX = 8
#: Rules up to this many may be broadcast (some 200 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 1 << 17
COLUMNS = ("host", "path", "rule", "verdict")
#: Fixed values of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url: both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``pages(url, ...)`` with host, path, rule and verdict.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the url's path starts with the rule's
    path; the rule of the longest host + path wins, among equals the longest host. Urls that no rule fits, null urls and urls without ``://`` get
    ``default`` and a null rule. Repeated rows are judged each; existing columns of the result's names are replaced. An
    empty rule table gives everything ``default``; of rules that repeat a host and path, block wins.
    """
    spark = pages.sparkSession
    pages = without(pages, *COLUMNS)
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v"))
    rules = rules.select(F.col("host").alias("r_host"), F.concat("host", "path").alias("rule"), F.col("v.verdict").alias("r_verdict"), F.sha2(F.concat_ws("\x1f", "host", "path"), 256).alias("digest"), F.length("host").alias("hl"), F.length("path").alias("pl"))
    rules = rules.withColumn("short", F.substring("digest", 1, PREFIX))
    n = rules.count()
    lengths = rules.agg(F.array_sort(F.collect_set(F.struct("hl", "pl")))).first()[0] or []  # distinct length pairs only
    pairs = F.array(*[F.struct(F.lit(int(x["hl"])).alias("hl"), F.lit(int(x["pl"])).alias("pl")) for x in lengths]) if lengths else F.expr("cast(array() as array<struct<hl:int,pl:int>>)")
    host, path = split_url(F.col("url"))
    urls = pages.select("url").where("url is not null").distinct().withColumn("_h", host).withColumn("_p", path)
    border = lambda x: (F.length("_h") == x["hl"]) | ((F.length("_h") > x["hl"]) & (F.substr("_h", F.length("_h") - x["hl"], F.lit(1)) == "."))
    fits = F.filter(pairs, lambda x: border(x) & (F.length("_p") >= x["pl"]))
    shown = F.transform(fits, lambda x: F.sha2(F.concat_ws("\x1f", F.substr("_h", F.length("_h") - x["hl"] + 1, x["hl"]), F.substr("_p", F.lit(1), x["pl"])), 256))
    asked = urls.select("url", F.explode(shown).alias("_d")).withColumn("short", F.substring("_d", 1, PREFIX))
    met = asked.join(F.broadcast(rules) if n <= BROADCAST_RULES else rules, "short").where("_d = digest")
    best = met.groupBy("url").agg(F.max(F.struct((F.col("hl") + F.col("pl")).alias("l"), "hl", "rule", "r_verdict")).alias("_best"))
    best = best.select(F.col("url").alias("_storyspark_url"), F.col("_best.rule").alias("rule"), F.col("_best.r_verdict").alias("verdict"))
    out = pages.join(best, pages["url"] == best["_storyspark_url"], "left").drop("_storyspark_url").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return out.withColumn("host", host).withColumn("path", path)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).select("page_id", *COLUMNS)


SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
