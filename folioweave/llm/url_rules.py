"""URL filters: pattern rules found by their rarest literal token, so that few rules run a regular expression on a URL.

Every rule is stored under one of the tokens that any matching URL must hold: the one that the fewest URLs hold. The tokens
of a URL fetch the rules stored under them, and only those patterns are tried. All of it are joins of DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm.tables import written

#: (verdict, host and path): the rules that are given.
FIXED_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]

#: Words of addresses that the method blocks where no given rule fits.
BLOCKED_WORDS = ["bets", "betting", "bingo", "casino", "jackpot", "lottery", "malware", "phishing", "pills", "poker", "porn", "torrent", "warez", "xxx"]

_SCHEMA = "rule string, verdict string, pattern string, tokens array<string>, grade int"


def host_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as (rule, verdict, pattern, tokens, grade) from (verdict, host/path): they fit a host, its subdomains, and a path's start.

    Tokens are the letters and digits between other characters; a token that a longer one could continue is left out.
    """
    rows = []
    for verdict, rule in rules:
        tokens = [t for t, after in re.findall(r"([A-Za-z0-9]+)([^A-Za-z0-9]?)", rule) if after]
        rows.append((rule, verdict, "^(?:[^/]*\\.)?" + re.escape(rule), sorted(set(tokens)), 1))
    return spark.createDataFrame(rows, _SCHEMA)


def word_rules(spark: SparkSession, words: list[str], verdict: str = "block") -> DataFrame:
    """Rules for whole words anywhere in host or path, below any host rule."""
    return spark.createDataFrame([(None, verdict, f"(?:^|[^A-Za-z0-9]){w}(?![A-Za-z0-9])", [w], 0) for w in words], _SCHEMA)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.filter(F.split(key, "[^A-Za-z0-9]+"), lambda t: t != "")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``pages`` (page_id, url; other columns are ignored).

    ``rules`` has (rule, verdict, pattern, tokens, grade): a pattern is tried on host and path together; of the fitting rules
    the highest grade wins, then the longest rule, then the first in alphabetical order; without any, the verdict is
    ``default``. Every matching URL must hold all of a rule's tokens; a rule without tokens is tried on every URL.

    * A null URL and one without ``://`` have an empty host and path. URLs are judged whole, whatever their length.
    * Each distinct address is judged once; repeated rows, also with a repeated or null page_id, are returned each.
    * Empty tables give an empty result, or one with the default verdict.
    """
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = rows.select("host", "path").distinct().withColumn("key", F.concat("host", "path"))
    urls = written(urls.withColumn("url_id", F.monotonically_increasing_id()), "urls")
    tokens = urls.select("url_id", F.explode(_tokens(F.col("key"))).alias("token"))
    rules = written(rules.withColumn("rule_id", F.monotonically_increasing_id()), "rules")
    literal = rules.select("rule_id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    held = written(tokens.join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls")), "url-tokens")
    # min_by with numbers only: the rarest token is the least of (URLs, hash), which the join finds again.
    counted = literal.join(held, "token", "left").select("rule_id", "token", F.coalesce("urls", F.lit(0)).alias("urls"))
    rarest = counted.groupBy("rule_id").agg(F.min(F.struct("urls", "token")).alias("least")).select("rule_id", F.col("least.token").alias("token"))
    index = written(rarest.join(rules, "rule_id").select("token", "rule_id", "pattern", "grade", F.length("rule").alias("chars")), "rule-index")
    fetched = tokens.join(index, "token").join(urls.select("url_id", "key"), "url_id")
    fits = written(fetched.where(F.expr("key rlike pattern")).select("url_id", "rule_id"), "fitting-rules")
    # One number orders the rules: grade, length, then the place among equals.
    order = written(
        index.select("rule_id", "grade", "chars").join(rules.select("rule_id", "rule", "verdict"), "rule_id")
        .withColumn("weight", F.col("grade") * F.lit(1 << 32) + F.coalesce("chars", F.lit(0))), "rule-order")
    best = fits.join(order.select("rule_id", "weight"), "rule_id").groupBy("url_id").agg(F.max("weight").alias("weight"))
    same = fits.join(order, "rule_id").select("url_id", "weight", "rule", "verdict")
    won = same.join(written(best, "best-weights"), ["url_id", "weight"]).groupBy("url_id").agg(
        F.min("rule").alias("rule"), F.min_by("verdict", F.coalesce("rule", F.lit(""))).alias("verdict"))
    judged = written(urls.join(won, "url_id", "left").select("host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")), "judged")
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")
