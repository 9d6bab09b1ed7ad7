"""Shelf, progress, history, bookmarks and updates over keyed reading events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.operators.ordered import first_rows


def latest_state(events: DataFrame, keys: list[str], *fields: str, ts: str = "ts") -> DataFrame:
    """One row per key: when it was first seen and the fields of its latest event.

    Ties in time go to the higher ``event_id``. Minimum and maximum combine
    map-side, so a hot key costs one row per task.
    """
    held = [f for f in fields if f != "event_id"]
    return (
        events.groupBy(*keys)
        .agg(F.min(ts).alias("added_at"), F.max(F.struct(ts, "event_id", *held)).alias("last"))
        .select(*keys, "added_at", F.col(f"last.{ts}").alias("updated_at"), *[F.col(f"last.{f}") for f in fields])
    )


def search_history(searches: DataFrame, cap: int = 50) -> DataFrame:
    """Distinct trimmed queries per reader, latest first, ``cap`` per reader."""
    latest = (
        searches.withColumn("query", F.trim("query")).filter(F.col("query") != "")
        .groupBy("reader", "query").agg(F.max("ts").alias("ts"))
    )
    return first_rows(latest, ["reader"], cap, F.col("ts").desc(), F.col("query"))


def scroll_ratio(offset: Column, extent: Column) -> Column:
    """Share of a page scrolled, within 0 and 1."""
    ratio = F.try_divide(offset, F.nullif(extent, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))))


def progress_ratio(index: Column, total: Column, scroll: Column) -> Column:
    """Share of a book read: by chapter where the total is known, else by scroll; 0 unread."""
    return (
        F.when(index.isNull(), F.lit(0.0))
        .when(F.coalesce(total, F.lit(0)) > 0, (index + 1) / total)
        .otherwise(F.coalesce(scroll, F.lit(0.0)))
    )


def progress_label(index: Column, total: Column, scroll: Column) -> Column:
    """``n/total p%``, without the total where it is unknown; ``-`` unread."""
    percent = F.concat(F.floor(F.coalesce(scroll, F.lit(0.0)) * 100).cast("string"), F.lit("%"))
    number = (index + 1).cast("string")
    return (
        F.when(index.isNull(), F.lit("-"))
        .when(F.coalesce(total, F.lit(0)) > 0, F.concat(number, F.lit("/"), total.cast("string"), F.lit(" "), percent))
        .otherwise(F.concat(number, F.lit(" "), percent))
    )


def age_label(read_at: Column, now: Column) -> Column:
    """Minutes, hours or days since, or the date after 30 days; seconds in, ``now`` is given."""
    age = now - read_at
    return (
        F.when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit(" min")))
        .when(age < 86400, F.concat(F.floor(age / 3600).cast("string"), F.lit(" h")))
        .when(age < 86400 * 30, F.concat(F.floor(age / 86400).cast("string"), F.lit(" d")))
        .otherwise(F.date_format(F.timestamp_seconds(read_at), "yyyy-MM-dd"))
    )


def sort_shelf(shelf: DataFrame, mode: str = "updated") -> DataFrame:
    """Shelf by updated, name, author, progress or added; ties by key."""
    index, total = F.col("chapter_index"), F.col("chapter_total")
    by_progress = (
        F.when(index.isNull(), F.lit(-1.0))
        .when(F.coalesce(total, F.lit(0)) > 0, (index + 1) / total)
        .otherwise(index.cast("double"))
    )
    order = {
        "name": F.asc("name"), "author": F.asc("author"), "progress": by_progress.desc(), "added": F.desc("added_at"),
    }.get(mode, F.desc("updated_at"))
    return shelf.withColumn("sort_progress", by_progress).orderBy(order, "key")


def reading_history(shelf: DataFrame) -> DataFrame:
    """Entries with progress, last read first."""
    return (
        shelf.filter(F.col("chapter_index").isNotNull())
        .withColumn("read_at", F.coalesce("progress_at", "updated_at"))
        .orderBy(F.desc("read_at"), "key")
    )


def shelf_stats(shelf: DataFrame, stored: DataFrame) -> DataFrame:
    """Books on the shelf, books being read, chapters stored."""
    ones, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    books = shelf.select(
        ones.alias("total"), F.col("chapter_index").isNotNull().cast("bigint").alias("reading"), none.alias("cached_chapters")
    )
    chapters = stored.select(none.alias("total"), none.alias("reading"), ones.alias("cached_chapters"))
    return books.unionByName(chapters).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "reading", "cached_chapters")
    ])


def filter_rows_as_json(df: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON form contains ``text``, blind to case."""
    return df.filter(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.strip().lower())))


def bookmarks_by(bookmarks: DataFrame, name: str | None = None, author: str | None = None) -> DataFrame:
    for column, wanted in (("book_name", name), ("book_author", author)):
        if wanted is not None:
            bookmarks = bookmarks.filter(F.col(column) == wanted)
    return bookmarks


def bookmarks_latest(bookmarks: DataFrame, snippet: int = 500) -> DataFrame:
    return bookmarks.withColumn("content", F.substring("content", 1, snippet)).orderBy(F.desc("time"), "book_name")


def remove_entries(df: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    return df.join(gone, on, "left_anti")


def clear_progress(shelf: DataFrame, fields: list[str], only: Column | None = None) -> DataFrame:
    """Forget the progress of the rows under ``only``, or of all."""
    for name in fields:
        cleared = F.lit(None) if only is None else F.when(~only, F.col(name))
        shelf = shelf.withColumn(name, cleared.cast(shelf.schema[name].dataType))
    return shelf


def check_updates(shelf: DataFrame, toc: DataFrame) -> DataFrame:
    """New chapters per updatable book; a book without a chapter list failed."""
    totals = toc.groupBy("book").agg(F.count(F.lit(1)).alias("new_total"))
    return (
        shelf.filter("can_update").join(totals, "book", "left")
        .withColumn("failed", F.col("new_total").isNull())
        .withColumn("new_chapters", F.greatest(F.lit(0), F.coalesce(F.col("new_total") - F.col("old_total"), F.lit(0))))
    )


def update_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if("failed").alias("failed"),
        F.count_if(F.col("new_chapters") > 0).alias("with_new"),
        F.coalesce(F.sum("new_chapters"), F.lit(0)).alias("new_chapters"),
    )


def resume_position(progress: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapter to open per (reader, book): the saved URL, else the saved index, else the first.

    ``chapters`` is unique by (book, url) and by (book, idx).
    """
    by_url = chapters.select("book", F.col("url").alias("chapter_url"), F.col("idx").alias("by_url"))
    by_idx = chapters.select("book", F.col("idx").alias("chapter_index"), F.col("idx").alias("by_idx"))
    first = chapters.groupBy("book").agg(F.min("idx").alias("first_idx"))
    return (
        progress.join(by_url, ["book", "chapter_url"], "left")
        .join(by_idx, ["book", "chapter_index"], "left")
        .join(first, "book")
        .withColumn("resume_idx", F.coalesce("by_url", "by_idx", "first_idx"))
    )


def prefetch_window(progress: DataFrame, chapters: DataFrame, stored: DataFrame, depth: int = 2) -> DataFrame:
    """The ``depth`` chapters after each reader's current one that are not stored.

    The few wanted indexes are generated per progress row, so the join is an
    equality on (book, idx) and not a range over the book.
    """
    wanted = progress.withColumn(
        "idx", F.explode(F.sequence(F.col("chapter_index") + 1, F.col("chapter_index") + depth))
    )
    return wanted.join(chapters, ["book", "idx"]).join(stored, ["book", "idx"], "left_anti")
