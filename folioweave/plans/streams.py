"""Streaming jobs run over all there is, and their batch twins."""

from pyspark.sql import functions as F

from folioweave.operators import extract as ex
from folioweave.operators import windows
from folioweave.plans.extraction import _NAV_ROWS, NAV_RULES, _catalog
from folioweave.plans.hits import _MERGED_SQL
from folioweave.plans.registry import query
from folioweave.plans.tables import EVENTS_SQL, reading_events, table
from folioweave.streaming import jobs

# A minute of the busiest source is what one task sorts.
CHUNK_MS = 60_000


def _stream(spark, folder, name):
    return jobs.read_stream(spark, folder, f"{name}.parquet", table(spark, folder, name).schema)


def _event_stream(spark, folder):
    return _stream(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), F.col("user_id").alias("reader"),
        F.get_json_object("props", "$.k").cast("bigint").alias("book"), "value")


@query("stream_extract", f"""WITH {_NAV_ROWS}
SELECT page_id, CAST(ord AS BIGINT) AS ord, name, link AS book_url FROM links WHERE origin IN ('en', 'fr', 'de', 'es')""")
def stream_extract(spark, folder):
    pages = _stream(spark, folder, "pages").select(
        "page_id", "url", F.col("html").alias("body"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1).alias("origin"))
    compiled = ex.compile_stage(_catalog(spark, NAV_RULES), "origin", "rules", "bookList")
    records = jobs.stream_extract(pages, compiled, ["page_id", "url"]).select(
        "page_id", "ord", ex.one("name").alias("name"), ex.link("bookUrl", F.col("url")).alias("book_url"))
    return jobs.run_to_files(records, jobs.work_folder(spark, "extract"))


@query("stream_dedupe", f"WITH {EVENTS_SQL} SELECT DISTINCT reader, book FROM reading")
def stream_dedupe(spark, folder):
    rows = jobs.stream_dedupe(_event_stream(spark, folder), ["reader", "book"], "ts", "60 days").select("reader", "book")
    return jobs.run_to_files(rows, jobs.work_folder(spark, "dedupe"))


@query("stream_latest_state", f"""WITH {EVENTS_SQL}
SELECT source, book, min(ts) AS added_at, max(ts) AS updated_at, arg_max(value, row(ts, event_id)) AS value FROM reading GROUP BY 1, 2""")
def stream_latest_state(spark, folder):
    events = _event_stream(spark, folder).withColumn("ts", F.unix_millis("ts"))
    return jobs.stream_latest_state(events, ["source", "book"], ["value"], jobs.work_folder(spark, "latest"))


@query("stream_merge_hits", f"WITH {_MERGED_SQL} SELECT name, author, book_url, origin_count FROM merged")
def stream_merge_hits(spark, folder):
    part = table(spark, folder, "part")
    listing = _stream(spark, folder, "lineitem")
    hits = listing.join(part, listing.l_partkey == part.p_partkey).select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("author"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("origin"),
        F.concat(F.lit("https://s"), F.col("l_suppkey"), F.lit(".example/b/"), F.col("l_partkey")).alias("book_url"))
    return jobs.stream_merge_hits(hits, jobs.work_folder(spark, "merge"))


@query("activity_windows", """
WITH counted AS (
  SELECT event_type AS source, epoch_us(ts) // 21600000000 * 21600000 AS window_start, count(*) AS events FROM events GROUP BY 1, 2
)
SELECT source, window_start, events FROM counted""")
def activity_windows(spark, folder):
    """Counts per six hours, the last window closed with the stream."""
    windowed = lambda events: jobs.activity_windows(events, ["source"], "6 hours", "1 hour")
    done = jobs.run_closed(_event_stream(spark, folder), windowed, jobs.work_folder(spark, "activity"))
    return done.select("source", F.unix_millis("window_start").alias("window_start"), "events")


def _chain_sql(span):
    return EVENTS_SQL.replace("WITH", "") + f""", opened AS (
  SELECT source, min(ts) AS opened FROM reading GROUP BY 1
  UNION ALL
  SELECT o.source, (SELECT min(r.ts) FROM reading r WHERE r.source = o.source AND r.ts >= o.opened + {span}) AS opened
  FROM opened o WHERE (SELECT min(r.ts) FROM reading r WHERE r.source = o.source AND r.ts >= o.opened + {span}) IS NOT NULL
), placed AS (
  SELECT r.*, (SELECT max(o.opened) FROM opened o WHERE o.source = r.source AND o.opened <= r.ts) AS opened FROM reading r
)"""


@query("rate_limit_audit", f"""WITH RECURSIVE {_chain_sql(3_600_000)}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, opened ORDER BY ts, event_id) AS rn FROM placed
)
SELECT event_id, source, CASE WHEN rn <= 3 THEN 0 ELSE opened + 3600000 - ts END AS wait_ms FROM ranked""")
def rate_limit_audit(spark, folder):
    """At most 2 (so 3) an hour for each source."""
    return windows.rate_limit_audit(reading_events(spark, folder), "source", 2, 3_600_000).select("event_id", "source", "wait_ms")


@query("stream_rate_limit", f"""WITH RECURSIVE {_chain_sql(3_600_000)}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, opened ORDER BY ts, event_id) AS rn FROM placed
)
SELECT event_id, source, CASE WHEN rn <= 3 THEN 0 ELSE opened + 3600000 - ts END AS wait_ms FROM ranked""")
def stream_rate_limit(spark, folder):
    events = _event_stream(spark, folder).select(
        "event_id", "source", "ts", F.unix_millis("ts").alias("ts_ms"), F.lit(0).cast("bigint").alias("amount"))
    return jobs.run_closed(events, lambda e: jobs.stream_rate_limit(e, "source", 2, 3_600_000, "1 hour"), jobs.work_folder(spark, "limit"))


_RATE_SQL = """CASE length(source) % 3 WHEN 0 THEN 1800000 WHEN 1 THEN 3600000 ELSE 0 END"""


@query("rate_limit_by_source", f"""WITH RECURSIVE {_chain_sql(0).replace('+ 0', '+ ' + _RATE_SQL.replace('source', 'o.source'))}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, opened ORDER BY ts, event_id) AS rn FROM placed
)
SELECT event_id, source, CASE WHEN length(source) % 3 = 2 OR rn <= 1 + (CASE length(source) % 3 WHEN 1 THEN 3 ELSE 0 END) THEN 0
  ELSE opened + {_RATE_SQL} - ts END AS wait_ms FROM ranked""".replace("r.ts >= o.opened + ", "length(o.source) % 3 <> 2 AND r.ts >= o.opened + "))
def rate_limit_by_source(spark, folder):
    """Rate strings by source: a least gap, so many in a window, and what is no rate."""
    events = reading_events(spark, folder)
    kind = F.length("source") % 3
    rate = F.when(kind == 0, " 1800000").when(kind == 1, "3/3600000").otherwise("often")
    rates = events.select("source").distinct().select("source", rate.alias("rate"))
    return windows.rate_limit_by_source(events, "source", rates).select("event_id", "source", "wait_ms")


@query("ttl_by_entry", f"""WITH RECURSIVE {_chain_sql(0).replace('+ 0', '+ ' + _RATE_SQL.replace('source', 'o.source') + ' + 1')}
SELECT event_id, source, event_id = min(event_id) OVER (PARTITION BY source, ts) AND opened = ts AS refetch FROM placed""".replace(
    "r.ts >= o.opened + ", "length(o.source) % 3 <> 2 AND r.ts >= o.opened + "))
def ttl_by_entry(spark, folder):
    """Each entry has a life time of its own; some never end."""
    kind = F.length("source") % 3
    ttl = F.when(kind == 0, 1_800_000).when(kind == 1, 3_600_000).otherwise(0)
    return windows.ttl_refetch(reading_events(spark, folder), "source", ttl).select("event_id", "source", "refetch")


@query("ttl_refetch", f"""WITH RECURSIVE {_chain_sql(7_200_001)}
SELECT event_id, source, event_id = min(event_id) OVER (PARTITION BY source, ts) AND opened = ts AS refetch FROM placed""")
def ttl_refetch(spark, folder):
    """Entries live two hours; each source reads its own."""
    return windows.ttl_refetch(reading_events(spark, folder), "source", 7_200_000).select("event_id", "source", "refetch")


@query("new_item_counts", f"""WITH {EVENTS_SQL}, polls AS (SELECT event_id, source, ts, CAST(floor(value) AS BIGINT) AS amount FROM reading)
SELECT event_id, source, greatest(0, coalesce(amount - lag(amount) OVER (PARTITION BY source ORDER BY ts, event_id), 0)) AS new_items FROM polls""")
def new_item_counts(spark, folder):
    polls = reading_events(spark, folder).select("event_id", "source", "ts", F.floor("value").alias("amount"))
    return windows.new_item_counts(polls, "source", F.floor(F.col("ts") / CHUNK_MS)).select("event_id", "source", "new_items")


@query("stream_new_items", f"""WITH {EVENTS_SQL}, polls AS (SELECT event_id, source, ts, CAST(floor(value) AS BIGINT) AS amount FROM reading)
SELECT event_id, source, greatest(0, coalesce(amount - lag(amount) OVER (PARTITION BY source ORDER BY ts, event_id), 0)) AS new_items FROM polls""")
def stream_new_items(spark, folder):
    polls = _event_stream(spark, folder).select(
        "event_id", "source", "ts", F.unix_millis("ts").alias("ts_ms"), F.floor("value").cast("bigint").alias("amount"))
    return jobs.run_closed(polls, lambda e: jobs.stream_new_items(e, "source", "1 hour"), jobs.work_folder(spark, "items"))
