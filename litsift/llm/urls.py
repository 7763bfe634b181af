"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

A rule is an action for a host and a path (``block net/``). It fits its host and all
subdomains of it if the url's path starts with the rule's path. Each url is expanded into
the expressions that a rule can have: suffixes of its host that begin at a label, each with
prefixes of its path, in the pairs of lengths that occur among the rules. Expressions and
rules meet by an equi-join on the first 32 bits of their SHA-256 digests; the whole digest
then confirms. Of the confirmed rules the longest wins (ties: the longer host, then block).

Defined results: host and path are empty for a null url or one without ``://``; such a url
fits no rule of a non-empty host. Without a rule the verdict is DEFAULT. Repeated rows are
judged each; equal (host, path) pairs are expanded once, so a hot host costs its distinct
paths. Other columns are not read.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What becomes of a url that no rule fits.
DEFAULT = "allow"
#: The rules of the registered query: fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Pairs of a host's and a path's length among the rules, at most.
MAX_SHAPES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_df(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, rule_host string, rule_path string")


def host_and_path(url: str = "url"):
    """Two columns: host (A-Z lower-cased) and path, both empty without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """key, host, path, rule (null if none fits), verdict: one row for each row of ``pages(key, url)``."""
    host, path = host_and_path()
    urls = pages.select(key, host.alias("host"), path.alias("path"))
    known = (rules.select("action", "rule_host", "rule_path", F.concat("rule_host", "rule_path").alias("rule"))
             .where("rule is not null").distinct()
             .withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
             .withColumn("short", F.substring("digest", 1, 8)))
    shapes = (known.select(F.length("rule_host").alias("h"), F.length("rule_path").alias("p")).distinct()
              .limit(MAX_SHAPES + 1).collect())
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"the rules have more than {MAX_SHAPES} pairs of lengths")
    shape = F.array(*[F.struct(F.lit(r.h).alias("h"), F.lit(r.p).alias("p")) for r in sorted(shapes)]) if shapes else \
        F.expr("cast(array() as array<struct<h:int,p:int>>)")
    distinct = urls.select("host", "path").distinct()
    fits = ("h <= length(host) and p <= length(path) "
            "and (h = length(host) or substring(host, length(host) - h, 1) = '.')")
    asked = (distinct.select("host", "path", F.explode(shape).alias("s")).select("host", "path", "s.h", "s.p").where(fits)
             .withColumn("digest", F.sha2(F.concat_ws("\n", F.expr("substring(host, length(host) - h + 1)"), F.expr("substring(path, 1, p)")), 256))
             .select("host", "path", F.substring("digest", 1, 8).alias("short"), F.col("digest").alias("own")))
    rank = F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"),
                    F.when(F.col("action") == "block", 1).otherwise(0).alias("strict"), "rule", "action")
    won = (asked.join(known, "short").where("own = digest")
           .groupBy("host", "path").agg(F.max(rank).alias("won")))
    return (urls.join(won, ["host", "path"], "left")
            .select(key, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(DEFAULT)).alias("verdict")))
