"""Queries over lists of links, regex rows, JSON fields, variables, templates."""

from pyspark.sql import functions as F

from folioweave.functions import lists as fn
from folioweave.functions import text as tx
from folioweave.plans.registry import query
from folioweave.plans.tables import EVENTS_SQL, NAV_SQL, nav_links, table


def _lists(spark, folder, **columns):
    nav = nav_links(spark, folder)
    return nav.select("page_id", *[F.array_join(c, "|").alias(n) for n, c in columns.items()])


@query("index_pick", f"""WITH {NAV_SQL}
SELECT page_id, texts[1] AS first, texts[len(texts)] AS last,
       array_to_string([texts[1], texts[3]], '|') AS pair FROM nav""")
def index_pick(spark, folder):
    texts = F.col("texts")
    return _lists(spark, folder, first=fn.pick(texts, 0), last=fn.pick(texts, -1), pair=fn.pick(texts, 0, 2))


@query("index_exclude", f"""WITH {NAV_SQL}
SELECT page_id, array_to_string(texts[2:], '|') AS but_first,
       array_to_string(list_concat(texts[2:2], texts[4:]), '|') AS but_pair FROM nav""")
def index_exclude(spark, folder):
    texts = F.col("texts")
    return _lists(spark, folder, but_first=fn.exclude(texts, 0), but_pair=fn.exclude(texts, 0, 2))


@query("index_range", f"""WITH {NAV_SQL}
SELECT page_id, array_to_string(texts[2:4], '|') AS middle,
       array_to_string(list_reverse(texts[2:4]), '|') AS turned,
       array_to_string([texts[1], texts[3]], '|') AS stepped,
       array_to_string([texts[len(texts)], texts[1]], '|') AS ends,
       array_to_string(list_concat(texts[1:1], texts[len(texts) - 0 : len(texts)]), '|') AS outside FROM nav""")
def index_range(spark, folder):
    texts = F.col("texts")
    return _lists(
        spark, folder, middle=fn.pick(texts, (1, 3, 1)), turned=fn.pick(texts, (3, 1, 1)),
        stepped=fn.pick(texts, (0, 3, 2)), ends=fn.pick(texts, -1, 0), outside=fn.exclude(texts, (1, -2, 1)),
    )


@query("combine_concat", f"WITH {NAV_SQL} SELECT page_id, array_to_string(list_concat(texts, hrefs), '|') AS items FROM nav")
def combine_concat(spark, folder):
    return _lists(spark, folder, items=fn.concat_lists(F.col("texts"), F.col("hrefs")))


@query("combine_first", f"""WITH {NAV_SQL}
SELECT page_id, array_to_string(CASE WHEN len(list_filter(texts, lambda t: contains(t, '.'))) > 0
       THEN list_filter(texts, lambda t: contains(t, '.')) ELSE hrefs END, '|') AS items FROM nav""")
def combine_first(spark, folder):
    dotted = F.filter("texts", lambda t: F.contains(t, F.lit(".")))
    return _lists(spark, folder, items=fn.first_non_empty(dotted, F.col("hrefs")))


@query("combine_interleave", f"""WITH {NAV_SQL}, begun AS (SELECT page_id, texts, [h FOR h IN hrefs IF starts_with(h, '/t')] AS hrefs FROM nav)
SELECT page_id, array_to_string(flatten([CASE WHEN i <= len(hrefs) THEN [texts[i], hrefs[i]] ELSE [texts[i]] END FOR i IN range(1, len(texts) + 1)]), '|') AS items FROM begun""")
def combine_interleave(spark, folder):
    """All labels in turn with the targets that begin alike, which are fewer."""
    return _lists(spark, folder, items=fn.interleave(F.col("texts"), F.filter("hrefs", lambda h: h.startswith("/t"))))


@query("regex_rows", r"""
WITH found AS (
  SELECT page_id, array_to_string(regexp_extract_all(html, '<li>.*?</li>'), '') AS items FROM pages
), groups AS (
  SELECT page_id, regexp_extract_all(items, '<a href="([^"]*)">([^<]*)</a>', 0) AS g0,
         regexp_extract_all(items, '<a href="([^"]*)">([^<]*)</a>', 1) AS g1,
         regexp_extract_all(items, '<a href="([^"]*)">([^<]*)</a>', 2) AS g2 FROM found
)
SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, g0[i] AS whole, g1[i] AS href, g2[i] AS label
FROM groups, unnest(range(1, len(g0) + 1)) AS u(i)""")
def regex_rows(spark, folder):
    rows = fn.regex_rows(F.col("html"), ["<li>.*?</li>", '<a href="([^"]*)">([^<]*)</a>'], 2)
    return table(spark, folder, "pages").select("page_id", F.posexplode(rows).alias("ord", "g")).select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), F.col("g")[0].alias("whole"), F.col("g")[1].alias("href"),
        F.col("g")[2].alias("label"),
    )


@query("clean_suffix", r"SELECT doc_id, regexp_replace(text, '[aeiou][.,]', '-', 'g') AS cleaned FROM documents")
def clean_suffix(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", fn.clean_all(F.col("text"), "[aeiou][.,]", "-").alias("cleaned"))


@query("clean_first", r"""SELECT doc_id, CASE WHEN regexp_matches(text, 'th[a-z]+ing')
       THEN regexp_extract(text, 'th[a-z]+ing') ELSE 'none' END AS found FROM documents""")
def clean_first(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", fn.clean_first(F.col("text"), "th[a-z]+ing", "none").alias("found"))


@query("jsonpath_fields", """SELECT event_id, json_extract_string(props, '$.k') AS k,
       CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS next_k, json_extract_string(props, '$.none') AS missing FROM events""")
def jsonpath_fields(spark, folder):
    events = table(spark, folder, "events")
    doc = F.col("props")
    return events.select(
        "event_id", fn.json_string(doc, "$.k").alias("k"),
        (fn.json_string(doc, "$.k").cast("bigint") + 1).alias("next_k"), fn.json_string(doc, "$.none").alias("missing"))


@query("jsonpath_lists", f"""WITH {EVENTS_SQL}
SELECT reader, book, string_agg(source, chr(10) ORDER BY source) AS sources
FROM (SELECT DISTINCT reader, book, source FROM reading) GROUP BY 1, 2""")
def jsonpath_lists(spark, folder):
    """List paths over JSON built per reader and book; at most one entry per source."""
    from folioweave.plans.tables import reading_events

    docs = reading_events(spark, folder).select("reader", "book", "source").distinct().groupBy("reader", "book").agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("source"))).alias("list"))).alias("doc"))
    return docs.select("reader", "book", fn.json_string(F.col("doc"), "$.list[*].source").alias("sources"))


@query("rule_steps", f"""WITH {NAV_SQL}
SELECT page_id, array_to_string(list_transform(texts, lambda t: replace(regexp_replace(t, '[.,]$', ''), '&amp;', '&')), chr(10)) AS labels,
       regexp_extract(url, '^[a-z]+://[^/?#]+') || hrefs[1] AS first_link FROM nav""")
def rule_steps(spark, folder):
    """Steps one after the other: list, cleaning, joining by line, entities; and the first link made absolute."""
    from folioweave.functions import urls

    cleaned = F.transform("texts", lambda t: fn.clean_all(t, "[.,]$"))
    return nav_links(spark, folder).select(
        "page_id", tx.unescape_common(F.array_join(cleaned, "\n")).alias("labels"),
        urls.resolve(F.col("url"), F.col("hrefs")[0]).alias("first_link"))


@query("variable_lookup", """
SELECT event_id, CASE WHEN value > 50 THEN 'event' || event_id WHEN user_id % 2 = 0 THEN 'reader' || user_id
       ELSE event_type END AS token FROM events""")
def variable_lookup(spark, folder):
    """A name looked up in the chapter's, then the record's, then the source's variables."""
    def scope(condition, value):
        return F.when(condition, F.create_map(F.lit("token"), value)).otherwise(F.create_map(F.lit("token"), F.lit("")))

    chapter = scope(F.col("value") > 50, F.concat(F.lit("event"), F.col("event_id")))
    record = scope(F.col("user_id") % 2 == 0, F.concat(F.lit("reader"), F.col("user_id")))
    source = F.create_map(F.lit("token"), F.col("event_type"))
    return table(spark, folder, "events").select("event_id", fn.lookup_variable("token", chapter, record, source).alias("token"))


@query("template_fields", r"""
WITH groups AS (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS g1,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS g2 FROM pages
)
SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, 'page ' || page_id || ': ' || g2[i] || ' at ' || g1[i] || ' $7' AS label
FROM groups, unnest(range(1, len(g1) + 1)) AS u(i)""")
def template_fields(spark, folder):
    """Literal text, a column and back-references into regex rows; an unknown group stays as written."""
    rows = fn.regex_rows(F.col("html"), ['<a href="([^"]*)">([^<]*)</a>'], 2)
    label = fn.fill_template(["page ", F.col("page_id"), ": ", 2, " at ", 1, " ", 7], F.col("g"))
    return table(spark, folder, "pages").select("page_id", F.posexplode(rows).alias("ord", "g")).select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), label.alias("label"))
