"""Queries over the shelf, reading log, bookmarks and updates."""

from pyspark.sql import functions as F

from folioweave.operators import shelf as op
from folioweave.plans.registry import query
from folioweave.plans.tables import CHAPTERS_SQL, EVENTS_SQL, SHELF_SQL, chapters, reading_events, shelf, table
from folioweave.sources import schemas, stores


@query("shelf_stats", f"""WITH {SHELF_SQL}
SELECT count(*) AS total, count(chapter_index) AS reading, (SELECT count(*) FROM conversations) AS cached_chapters FROM shelf""")
def shelf_stats(spark, folder):
    return op.shelf_stats(shelf(spark, folder), chapters(spark, folder))


@query("sort_shelf_progress", f"""WITH {SHELF_SQL}
SELECT key, CASE WHEN chapter_index IS NULL THEN -1.0 WHEN coalesce(chapter_total, 0) > 0 THEN (chapter_index + 1) / chapter_total
       ELSE chapter_index END AS progress FROM shelf""")
def sort_shelf_progress(spark, folder):
    return op.sort_shelf(shelf(spark, folder), "progress").select("key", F.col("sort_progress").alias("progress"))


@query("sort_shelf_updated", f"""WITH {SHELF_SQL} SELECT key, updated_at FROM shelf ORDER BY updated_at DESC, key""")
def sort_shelf_updated(spark, folder):
    return op.sort_shelf(shelf(spark, folder)).select("key", "updated_at")


@query("reading_history", f"""WITH {SHELF_SQL}
SELECT key, name, coalesce(progress_at, updated_at) AS read_at FROM shelf WHERE chapter_index IS NOT NULL""")
def reading_history(spark, folder):
    return op.reading_history(shelf(spark, folder)).select("key", "name", "read_at")


@query("latest_state", f"""WITH {EVENTS_SQL}
SELECT source, book, min(ts) AS added_at, max(ts) AS updated_at, arg_max(value, row(ts, event_id)) AS value, arg_max(reader, row(ts, event_id)) AS reader
FROM reading GROUP BY 1, 2""")
def latest_state(spark, folder):
    return op.latest_state(reading_events(spark, folder), ["source", "book"], "value", "reader")


@query("search_history", f"""WITH {EVENTS_SQL}, latest AS (
  SELECT reader, source || ' ' || book AS query, max(ts) AS ts FROM reading GROUP BY 1, 2
)
SELECT reader, query, ts FROM latest QUALIFY row_number() OVER (PARTITION BY reader ORDER BY ts DESC, query) <= 50""")
def search_history(spark, folder):
    searches = reading_events(spark, folder).select(
        "reader", F.concat(F.lit(" "), "source", F.lit(" "), "book", F.lit("  ")).alias("query"), "ts")
    return op.search_history(searches)


@query("row_json_filter", """SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '#00000001') OR contains('"s_nationkey":7,', '"s_nationkey":' || s_nationkey || ',#00000001')""")
def row_json_filter(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return op.filter_rows_as_json(rows, "Supplier#00000001").select("s_suppkey", "s_name")


_BOOKMARKS_SQL = CHAPTERS_SQL + """, bookmarks AS (
  SELECT book * 1000 + idx AS time, 'Book ' || book % 10 AS book_name, role AS book_author, idx AS chapter_index, text AS content FROM chapters
)"""


def _bookmarks(spark, folder):
    return chapters(spark, folder).select(
        (F.col("book") * 1000 + F.col("idx")).alias("time"), F.concat(F.lit("Book "), F.col("book") % 10).alias("book_name"),
        F.col("role").alias("book_author"), F.col("idx").alias("chapter_index"), F.col("text").alias("content"))


@query("bookmark_filter", f"WITH {_BOOKMARKS_SQL} SELECT time, book_name, book_author FROM bookmarks WHERE book_name = 'Book 3' AND book_author = 'user'")
def bookmark_filter(spark, folder):
    return op.bookmarks_by(_bookmarks(spark, folder), "Book 3", "user").select("time", "book_name", "book_author")


@query("bookmarks_latest", f"WITH {_BOOKMARKS_SQL} SELECT time, book_name, substr(content, 1, 500) AS content FROM bookmarks ORDER BY time DESC")
def bookmarks_latest(spark, folder):
    return op.bookmarks_latest(_bookmarks(spark, folder)).select("time", "book_name", "content")


@query("remove_entries", f"""WITH {SHELF_SQL}
SELECT key, reader FROM shelf WHERE reader NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def remove_entries(spark, folder):
    gone = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("reader"))
    return op.remove_entries(shelf(spark, folder), gone, ["reader"]).select("key", "reader")


@query("clear_progress", f"""WITH {SHELF_SQL}
SELECT key, CASE WHEN author = '5-LOW' THEN NULL ELSE chapter_index END AS chapter_index, CASE WHEN author = '5-LOW' THEN NULL ELSE progress_at END AS progress_at FROM shelf""")
def clear_progress(spark, folder):
    cleared = op.clear_progress(shelf(spark, folder), ["chapter_index", "progress_at"], F.col("author") == "5-LOW")
    return cleared.select("key", "chapter_index", "progress_at")


_UPDATES_SQL = """
toc_size AS (
  SELECT l_suppkey AS book, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  WHERE n_regionkey <> 3 GROUP BY 1
), checked AS (
  SELECT s_suppkey AS book, n AS new_total, n IS NULL AS failed, greatest(0, coalesce(n - CAST(floor(s_acctbal / 15) AS BIGINT), 0)) AS new_chapters
  FROM supplier LEFT JOIN toc_size ON book = s_suppkey WHERE s_acctbal < 8000
)"""


def _checked(spark, folder):
    """A supplier is a book; those of region 3 have no chapter list, rich ones are not updated."""
    suppliers, nations = table(spark, folder, "supplier"), table(spark, folder, "nation")
    rows = suppliers.select(
        F.col("s_suppkey").alias("book"), F.floor(F.col("s_acctbal") / 15).alias("old_total"), (F.col("s_acctbal") < 8000).alias("can_update"))
    listed = suppliers.join(nations.filter("n_regionkey <> 3"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("book"))
    toc = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("book")).join(listed, "book", "left_semi")
    return op.check_updates(rows, toc)


@query("check_updates", f"WITH {_UPDATES_SQL} SELECT * FROM checked")
def check_updates(spark, folder):
    return _checked(spark, folder).select("book", "new_total", "failed", "new_chapters")


@query("update_summary", f"""WITH {_UPDATES_SQL}
SELECT count(*) AS checked, count(*) FILTER (failed) AS failed, count(*) FILTER (new_chapters > 0) AS with_new, CAST(sum(new_chapters) AS BIGINT) AS new_chapters FROM checked""")
def update_summary(spark, folder):
    return op.update_summary(_checked(spark, folder))


_PROGRESS_SQL = EVENTS_SQL + "," + CHAPTERS_SQL + """, progress AS (
  SELECT reader, book, arg_max(event_id % 9, row(ts, event_id)) AS chapter_index,
         'c' || book || '/' || arg_max(CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS VARCHAR) ELSE 'gone' END, row(ts, event_id)) AS chapter_url
  FROM reading GROUP BY 1, 2
)"""


def _progress(spark, folder):
    event = F.col("event_id")
    events = reading_events(spark, folder).withColumns({
        "chapter_index": event % 9,
        "chapter_url": F.concat(F.lit("c"), "book", F.lit("/"), F.when(event % 3 == 0, (event % 7).cast("string")).otherwise("gone")),
    })
    return op.latest_state(events, ["reader", "book"], "chapter_index", "chapter_url").select("reader", "book", "chapter_index", "chapter_url")


@query("resume_position", f"""WITH {_PROGRESS_SQL}
SELECT p.reader, p.book, coalesce(u.idx, i.idx, f.idx) AS resume_idx
FROM progress p JOIN (SELECT book, min(idx) AS idx FROM chapters GROUP BY 1) f ON f.book = p.book
LEFT JOIN chapters u ON u.book = p.book AND u.url = p.chapter_url
LEFT JOIN chapters i ON i.book = p.book AND i.idx = p.chapter_index""")
def resume_position(spark, folder):
    return op.resume_position(_progress(spark, folder), chapters(spark, folder)).select("reader", "book", "resume_idx")


@query("prefetch_window", f"""WITH {_PROGRESS_SQL}
SELECT p.reader, p.book, c.idx, c.url FROM progress p JOIN chapters c ON c.book = p.book AND c.idx BETWEEN p.chapter_index + 1 AND p.chapter_index + 2
WHERE NOT (c.idx < 3 AND c.role = 'user')""")
def prefetch_window(spark, folder):
    stored = chapters(spark, folder).filter("idx < 3 AND role = 'user'").select("book", "idx")
    rows = op.prefetch_window(_progress(spark, folder), chapters(spark, folder), stored)
    return rows.select("reader", "book", "idx", "url")


@query("shelf_ingest", f"""WITH {SHELF_SQL}
SELECT CAST(key AS VARCHAR) AS key, added_at, updated_at, name, author, CAST(chapter_index AS INTEGER) AS chapter_index,
       CAST(chapter_total AS INTEGER) AS chapter_total, CAST(CASE WHEN chapter_index IS NULL THEN 0 ELSE 0.5 END AS DOUBLE) AS scroll_ratio FROM shelf""")
def shelf_ingest(spark, folder):
    """State files, one per shelf entry, as JSON text and back; unread entries have no progress."""
    entry = F.struct(
        F.col("key").cast("string").alias("key"), "added_at", "updated_at", F.struct("name", "author").alias("book"),
        F.when(F.col("chapter_index").isNotNull(), F.struct("chapter_index", "chapter_total", F.lit(0.5).alias("scroll_ratio"))).alias("progress"))
    texts = shelf(spark, folder).select(F.to_json(F.struct(F.array(entry).alias("bookshelf"))).alias("json"))
    states = texts.select(F.from_json("json", schemas.STATE_FILE).alias("s")).select("s.*")
    return stores.shelf_rows(states).select("key", "added_at", "updated_at", "name", "author", "chapter_index", "chapter_total", "scroll_ratio")


@query("scan_pages", "SELECT page_id, url, length(html) AS body_chars FROM pages WHERE length(html) > 0")
def scan_pages(spark, folder):
    pages = stores.with_body(table(spark, folder, "pages"), "html")
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("body_chars"))


@query("text_files", "SELECT doc_id, text FROM documents")
def text_files(spark, folder):
    """Texts as bytes, some with a mark in front, some in GBK where it has all their characters, decoded again."""
    import pandas as pd
    from pyspark.sql.types import BinaryType

    @F.pandas_udf(BinaryType())
    def gbk(texts: pd.Series) -> pd.Series:
        def encoded(text):
            try:
                return text.encode("gbk")
            except UnicodeEncodeError:
                return text.encode()

        return texts.map(encoded, na_action="ignore")

    mark = F.unhex(F.lit("EFBBBF"))
    raw = F.encode("text", "UTF-8")
    turn = F.col("doc_id") % 3
    files = table(spark, folder, "documents").select(
        "doc_id", F.when(turn == 0, F.concat(mark, raw)).when(turn == 1, gbk("text")).otherwise(raw).alias("content"))
    return stores.decode_text_files(files).select("doc_id", "text")


@query("archive_members", "SELECT 'b' || conv_id || '/' || turn // 4 AS path, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def archive_members(spark, folder):
    """Conversations packed as zip archives of four turns each, one member a turn, and unpacked in name order."""
    import io
    import zipfile

    import pandas as pd

    def pack(batches):
        for batch in batches:
            for path, names, texts in zip(batch["path"], batch["names"], batch["texts"]):
                target = io.BytesIO()
                with zipfile.ZipFile(target, "w") as archive:
                    for name, text in sorted(zip(names, texts), reverse=True):
                        archive.writestr(name, text)
                yield pd.DataFrame({"path": [path], "content": [target.getvalue()]})

    rows = chapters(spark, folder).select(F.concat(F.lit("b"), "book", F.lit("/"), F.floor(F.col("idx") / 4)).alias("path"), F.struct(F.format_string("%05d.txt", "idx").alias("name"), "text").alias("m"))
    books = rows.groupBy("path").agg(F.collect_list("m").alias("m")).select("path", F.col("m.name").alias("names"), F.col("m.text").alias("texts"))
    return stores.archive_text(books.mapInPandas(pack, "path STRING, content BINARY"))


@query("image_hook", "SELECT page_id, 'bar' || html AS content FROM pages")
def image_hook(spark, folder):
    """Bytes through a user's hook that decodes base64 and replaces the head; a failure keeps them."""
    import base64

    import pandas as pd
    from pyspark.sql.types import BinaryType

    from folioweave.operators.content import image_hook as hook

    @F.pandas_udf(BinaryType())
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: base64.b64decode(b).replace(b"foo", b"bar", 1))

    body = F.concat(F.lit("foo"), F.col("html"))
    images = table(spark, folder, "pages").select("page_id", F.encode(F.base64(F.encode(body, "UTF-8")), "UTF-8").alias("content"))
    return hook(images, decode).select("page_id", F.decode("content", "UTF-8").alias("content"))
