"""Views of the test tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import prepared
from folioweave.sources.catalog import parse_sources
from folioweave.sources.stores import spread


# Tables whose rows cost far more to work on than to move.
TEXT_TABLES = {"pages", "documents"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = prepared(spark).read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def raw_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Search hits: a part listed by many suppliers is one book found in many sources."""
    listing = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"
    )
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return listing.join(part, listing.l_partkey == part.p_partkey).select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("origin"),
        F.concat(
            F.lit("https://s"), F.col("l_suppkey"), F.lit(".example/b/"), F.col("l_partkey")
        ).alias("book_url"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("author"),
        F.col("p_type").alias("kind"),
        F.when(F.col("l_returnflag") == "A", F.lit(""))
        .otherwise(F.concat(F.lit("intro "), F.col("l_orderkey")))
        .alias("intro"),
        F.when(F.col("l_linestatus") == "F", F.lit(""))
        .otherwise(F.concat(F.lit("/cover/"), F.col("l_partkey"), F.lit(".jpg")))
        .alias("cover_url"),
        F.when(F.col("l_returnflag") == "R", F.lit(""))
        .otherwise(F.concat(F.lit("Chapter "), F.col("l_linenumber")))
        .alias("latest_chapter"),
    )


HITS_SQL = """
hits AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         's' || l_suppkey AS origin,
         'https://s' || l_suppkey || '.example/b/' || l_partkey AS book_url,
         p_name AS name, p_brand AS author, p_type AS kind,
         CASE WHEN l_returnflag = 'A' THEN '' ELSE 'intro ' || l_orderkey END AS intro,
         CASE WHEN l_linestatus = 'F' THEN '' ELSE '/cover/' || l_partkey || '.jpg' END AS cover_url,
         CASE WHEN l_returnflag = 'R' THEN '' ELSE 'Chapter ' || l_linenumber END AS latest_chapter,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def toc_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Raw chapter-list rows: a supplier is a book, its listed parts are the links in page order.

    The same part is listed many times, as an index page lists the newest
    chapters both on top and in their place.
    """
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("book"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"),
        F.concat(F.lit("/c/"), F.col("l_partkey")).alias("url"),
        F.concat(F.lit("Chapter "), F.col("l_partkey")).alias("title"),
    )


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of books: one conversation is one book, its turns are the chapters."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("book"),
        F.col("turn").alias("idx"),
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("/"), F.col("turn")).alias("url"),
        F.concat(F.lit("Chapter "), F.col("turn"), F.lit(" "), F.col("role")).alias("title"),
        F.col("role"),
        F.col("text"),
    )


CHAPTERS_SQL = """
chapters AS (
  SELECT conv_id AS book, turn AS idx, 'c' || conv_id || '/' || turn AS url,
         'Chapter ' || turn || ' ' || role AS title, role, text
  FROM conversations
)"""


def reading_events(spark: SparkSession, folder: str) -> DataFrame:
    """Reading log: reader, source, book and position of every saved progress event."""
    events = table(spark, folder, "events")
    return events.select(
        "event_id",
        millis("ts").alias("ts"),
        F.col("user_id").alias("reader"),
        F.col("event_type").alias("source"),
        F.get_json_object("props", "$.k").cast("bigint").alias("book"),
        F.col("value"),
    )


EVENTS_SQL = """
reading AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts, user_id AS reader, event_type AS source,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS book, value
  FROM events
)"""


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", "url", F.col("html").alias("body"))


def nav_links(spark: SparkSession, folder: str) -> DataFrame:
    """Navigation links of every page as lists: texts and targets, in page order."""
    item = F.lit(r'<li><a href="([^"]*)">([^<]*)</a></li>')
    return table(spark, folder, "pages").select(
        "page_id", "url",
        F.regexp_extract_all("html", item, F.lit(2)).alias("texts"),
        F.regexp_extract_all("html", item, F.lit(1)).alias("hrefs"),
    )


NAV_SQL = r"""
nav AS (
  SELECT page_id, url,
         regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS texts,
         regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs
  FROM pages
)"""


def source_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rule sets as JSON text, one per supplier; every second nation's rule groups are strings.

    Suppliers of nations 20 and up have no name, as broken files do.
    """
    suppliers = table(spark, folder, "supplier")
    nations = table(spark, folder, "nation")
    joined = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey)
    number, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    search = F.to_json(F.struct(
        F.concat(F.lit("tag.li."), nation).alias("bookList"), F.lit("a@text").alias("name"),
        F.when(nation % 3 == 0, F.lit("$.name")).otherwise(F.lit("//a/@href")).alias("bookUrl"),
        F.when(nation % 4 == 0, F.lit("@js:result")).alias("author"),
    ))
    head = F.struct(
        F.concat(F.lit("https://s"), number, F.lit(".example")).alias("bookSourceUrl"),
        F.when(nation < 20, F.col("s_name")).alias("bookSourceName"),
        F.concat("n_name", F.lit(",region "), F.col("n_regionkey").cast("string")).alias("bookSourceGroup"),
        (nation % 4).alias("bookSourceType"),
        nation.alias("customOrder"),
        F.when(nation % 5 > 0, F.concat(
            F.lit("https://s"), number, F.lit(".example/find?q={{key}}&p={{page}}"))).alias("searchUrl"),
        F.when(nation % 3 == 1, F.lit("New::/new&&Top::/top")).alias("exploreUrl"),
        F.when(nation % 6 == 0, F.lit("/login")).alias("loginUrl"),
        F.when(nation % 2 == 1, F.lit("note")).alias("variableComment"),
    )
    opened = F.regexp_replace(F.to_json(head), r"\}$", "")
    as_string = F.regexp_extract(F.to_json(F.struct(search.alias("r"))), r'^\{"r":(.*)\}$', 1)
    rule = F.when(nation % 2 == 0, search).otherwise(as_string)
    return joined.select(
        "s_suppkey", F.concat(opened, F.lit(',"unknown":1,"ruleSearch":'), rule, F.lit("}")).alias("json")
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return parse_sources(source_texts(spark, folder), "json")


CATALOG_SQL = """
catalog AS (
  SELECT 'https://s' || s_suppkey || '.example' AS source, s_name AS name,
         n_name || ',region ' || n_regionkey AS groups, s_nationkey % 4 AS type, s_nationkey AS custom_order,
         CASE WHEN s_nationkey % 5 > 0
              THEN 'https://s' || s_suppkey || '.example/find?q={{key}}&p={{page}}' END AS search_url,
         CASE WHEN s_nationkey % 3 = 1 THEN 'New::/new&&Top::/top' END AS explore_url,
         CASE WHEN s_nationkey % 6 = 0 THEN '/login' END AS login_url,
         CASE WHEN s_nationkey % 2 = 1 THEN 'note' END AS variable_comment,
         'tag.li.' || s_nationkey AS list_rule,
         CASE WHEN s_nationkey % 3 = 0 THEN '$.name' ELSE '//a/@href' END AS url_rule,
         CASE WHEN s_nationkey % 4 = 0 THEN '@js:result' END AS author_rule
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey < 20
)"""


def shelf(spark: SparkSession, folder: str) -> DataFrame:
    """Shelf entries: an order is a book on a reader's shelf, its status says how far it was read."""
    orders = table(spark, folder, "orders")
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    unread = F.col("o_orderstatus") == "O"
    index = F.when(~unread, (F.col("o_custkey") % 40).cast("bigint"))
    return orders.select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("reader"),
        F.concat(F.lit("Book "), F.col("o_orderkey")).alias("name"),
        F.col("o_orderpriority").alias("author"),
        day.alias("added_at"), (day + F.col("o_custkey") * 60).alias("updated_at"),
        index.alias("chapter_index"),
        F.when(F.col("o_orderstatus") == "F", (index + 1 + F.col("o_orderkey") % 7).cast("bigint")).alias("chapter_total"),
        (F.col("o_totalprice")).alias("scroll_y"), F.lit(400000.0).alias("max_scroll_y"),
        F.when(~unread & (F.col("o_orderkey") % 2 == 0), day + 30).alias("progress_at"),
    )


SHELF_SQL = """
shelf AS (
  SELECT o_orderkey AS key, o_custkey AS reader, 'Book ' || o_orderkey AS name, o_orderpriority AS author,
         CAST(epoch(o_orderdate) AS BIGINT) AS added_at,
         CAST(epoch(o_orderdate) AS BIGINT) + o_custkey * 60 AS updated_at,
         CASE WHEN o_orderstatus <> 'O' THEN o_custkey % 40 END AS chapter_index,
         CASE WHEN o_orderstatus = 'F' THEN o_custkey % 40 + 1 + o_orderkey % 7 END AS chapter_total,
         o_totalprice AS scroll_y, 400000.0::DOUBLE AS max_scroll_y,
         CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 2 = 0
              THEN CAST(epoch(o_orderdate) AS BIGINT) + 30 END AS progress_at
  FROM orders
)"""
