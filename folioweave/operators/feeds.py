"""Feed articles: deduplication, detail text, reviews by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.operators.ordered import first_per_key


def dedupe_articles(articles: DataFrame, *scope: str) -> DataFrame:
    """First article per link, or per title where there is no link; neither drops the row."""
    key = F.coalesce(F.nullif("link", F.lit("")), F.nullif("title", F.lit("")))
    keyed = articles.withColumn("__key", key).filter(F.col("__key").isNotNull())
    return first_per_key(keyed, [*scope, "__key"], F.col("ord")).drop("__key")


def article_detail(articles: DataFrame, extracted: DataFrame) -> DataFrame:
    """Text of an article: its own, else what its linked page gave, else its description.

    ``extracted`` has one row per ``link`` with ``page_content``.
    """
    blank = F.lit("")
    return articles.join(extracted, "link", "left").withColumn(
        "content",
        F.coalesce(
            F.nullif("content", blank), F.nullif("page_content", blank),
            F.when(F.col("link") != "", F.nullif("description", blank)), blank,
        ),
    ).drop("page_content")


def zip_reviews(pages: DataFrame) -> DataFrame:
    """Review rows from parallel lists, by position; rows without content go, gaps are empty."""
    rows = pages.select(
        "*", F.posexplode(F.arrays_zip("contents", "avatars", "post_times", "quote_urls")).alias("position", "r")
    )
    blank = F.lit("")
    return rows.select(
        *[c for c in pages.columns if c not in ("contents", "avatars", "post_times", "quote_urls")], "position",
        F.coalesce("r.contents", blank).alias("content"), F.coalesce("r.avatars", blank).alias("avatar"),
        F.coalesce("r.post_times", blank).alias("post_time"), F.coalesce("r.quote_urls", blank).alias("quote_url"),
    ).filter(F.col("content") != "")
