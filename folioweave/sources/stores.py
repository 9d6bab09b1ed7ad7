"""Crawl tables, cached texts, the shelf file, encoded bodies and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioweave.sources import schemas


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Crawled pages with a body; the schema is declared, never inferred."""
    return with_body(spark.read.schema(schemas.PAGE).format(fmt).load(path))


# A scan below this many bytes a slot is small enough to be dealt out again.
SMALL_SHARE = 32 * 1024 * 1024


def spread(scan: DataFrame) -> DataFrame:
    """Deal a small scan of few files out to all slots; large scans pass unchanged.

    A file that cannot be split (one row group, a compressed text) is read by
    one task, and so is all work up to the first shuffle. Where the whole scan
    is small, an extra exchange costs less than idle slots; larger scans stay as
    they are. The optimizer's estimate decides; no file is listed for it.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(slots) if size < slots * SMALL_SHARE else scan


def with_body(pages: DataFrame, column: str = "body") -> DataFrame:
    return pages.filter(F.length(column) > 0)


def valid_entries(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that never expire (0) or have not expired at ``now``."""
    return cache.filter((F.col("expires_at") == 0) | (F.col("expires_at") >= now))


def write_store(rows: DataFrame, path: str, bucket: str = "bucket", buckets: int = 256) -> None:
    """A keyed store, laid out by key bucket so that a later join reads matching buckets only.

    A key always falls into the same bucket; the bucket count bounds the files.
    """
    placed = rows.withColumn(bucket, F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    placed.repartition(bucket, F.pmod(F.xxhash64("key", F.lit("spread")), F.lit(8))).write.mode("overwrite").partitionBy(bucket).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


# -- shelf file --------------------------------------------------------------


def shelf_rows(states: DataFrame) -> DataFrame:
    """Shelf entries of state files, one row per book, with defaults."""
    entry = states.select(F.explode("bookshelf").alias("e"))
    return entry.select(
        F.coalesce("e.key", F.lit("")).alias("key"),
        F.coalesce("e.added_at", F.lit(0)).alias("added_at"),
        F.coalesce("e.updated_at", F.lit(0)).alias("updated_at"),
        F.coalesce("e.book.bookUrl", F.lit("")).alias("book_url"),
        F.coalesce("e.book.name", F.lit("")).alias("name"),
        F.coalesce("e.book.author", F.lit("")).alias("author"),
        F.coalesce("e.source.bookSourceUrl", F.lit("")).alias("source_url"),
        "e.progress.chapter_index", "e.progress.chapter_total",
        F.coalesce("e.progress.scroll_ratio", F.lit(0.0)).alias("scroll_ratio"),
        F.col("e.progress.updated_at").alias("progress_at"),
    )


def bookmark_rows(states: DataFrame) -> DataFrame:
    return states.select(F.explode("bookmarks").alias("b")).select(
        F.col("b.time").alias("time"), F.col("b.bookName").alias("book_name"), F.col("b.bookAuthor").alias("book_author"),
        F.col("b.chapterIndex").alias("chapter_index"), F.col("b.chapterName").alias("chapter_name"), "b.content",
    )


def history_rows(states: DataFrame) -> DataFrame:
    return states.select(F.posexplode("search_history").alias("position", "query"))


def health_rows(states: DataFrame) -> DataFrame:
    return states.select(F.explode("source_health").alias("source", "h")).select("source", "h.*")


# -- character sets ----------------------------------------------------------


def detect_charset(option: Column, content_type: Column, head: Column) -> Column:
    """Character set by request option, header, then the first 4096 characters, else utf-8."""
    named = lambda text, mark: F.nullif(
        F.regexp_extract(F.lower(text), mark + r"""=["']?\s*([a-z0-9._-]+)""", 1), F.lit("")
    )
    start = F.substring(head, 1, 4096)
    return F.coalesce(
        F.nullif(F.lower(F.trim(option)), F.lit("")), named(content_type, "charset"), named(start, "charset"),
        named(start, "encoding"), F.lit("utf-8"),
    )


@F.pandas_udf(StringType())
def _decode_any(body: pd.Series, charset: pd.Series) -> pd.Series:
    def one(raw, name):
        try:
            return raw.decode(name, errors="replace")
        except LookupError:
            return raw.decode("utf-8", errors="replace")

    return pd.Series([None if b is None else one(b, c) for b, c in zip(body, charset)], dtype="object")


def decode_body(body: Column, charset: Column) -> Column:
    """Text of raw bytes. UTF-8 that is valid stays in the JVM; the rest takes the vectorised path."""
    text = body.cast("string")
    native = charset.isin("utf-8", "utf8") & F.is_valid_utf8(text)
    return F.when(native, text).otherwise(_decode_any(F.when(~native, body), charset))


@F.pandas_udf(StringType())
def _decode_text(raw: pd.Series) -> pd.Series:
    def one(data):
        for name in ("utf-8-sig", "gbk"):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
        return data.decode("latin-1")

    return raw.map(one, na_action="ignore")


def decode_text_files(files: DataFrame) -> DataFrame:
    """Text of ``content`` bytes: UTF-8 with or without mark, else GBK, else Latin-1."""
    text = F.col("content").cast("string")
    native = F.is_valid_utf8(text)
    return files.withColumn(
        "text",
        F.when(native, F.regexp_replace(text, "^﻿", "")).otherwise(_decode_text(F.when(~native, F.col("content")))),
    )


# -- archives ----------------------------------------------------------------


def explode_archives(files: DataFrame) -> DataFrame:
    """Members of zip archives (``path``, ``content`` columns) as rows, one archive at a time per task."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"path": [path], "member": [info.filename], "data": [archive.read(info)]})

    return files.select("path", "content").mapInPandas(members, "path STRING, member STRING, data BINARY")


def archive_text(files: DataFrame) -> DataFrame:
    """Text of all members of each archive, joined in name order."""
    rows = decode_text_files(explode_archives(files).withColumnRenamed("data", "content"))
    return rows.groupBy("path").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("member", "text"))), lambda m: m["text"]), "\n"
        ).alias("text")
    )

