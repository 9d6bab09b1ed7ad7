"""Queries that build and take apart URLs and requests."""

from pyspark.sql import functions as F

from folioweave.functions import urls as fn
from folioweave.plans.registry import query
from folioweave.plans.tables import NAV_SQL, nav_links, table


@query("data_uri_decode", """
SELECT doc_id, 'text/plain;base64' AS header, text AS body, text AS plain_body FROM documents""")
def data_uri_decode(spark, folder):
    """Document texts through both forms of ``data:`` URI, with options behind, and back."""
    docs = table(spark, folder, "documents")
    encoded = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")), F.lit(',{"type":"x"}'))
    plain = F.concat(F.lit("data:,"), F.url_encode("text"))
    header, body = fn.decode_data_uri(encoded)
    return docs.select("doc_id", header.alias("header"), body.alias("body"), fn.decode_data_uri(plain)[1].alias("plain_body"))


@query("charset_detect", r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'gbk' WHEN page_id % 3 = 1 THEN 'iso-8859-1'
       ELSE coalesce(nullif(regexp_extract(lower(html[1:4096]), 'charset=["'']?\s*([a-z0-9._-]+)', 1), ''), 'utf-8') END AS charset
FROM pages""")
def charset_detect(spark, folder):
    from folioweave.sources.stores import detect_charset

    option = F.when(F.col("page_id") % 3 == 0, "GBK")
    header = F.when(F.col("page_id") % 3 == 1, "text/html; charset=ISO-8859-1").otherwise("text/html")
    return table(spark, folder, "pages").select("page_id", detect_charset(option, header, F.col("html")).alias("charset"))


@query("page_alternatives", """
SELECT o_orderkey, '/list' || CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_custkey % 5 = 1 THEN '_2' ELSE '_3' END || '.html' AS request
FROM orders""")
def page_alternatives(spark, folder):
    page = F.col("o_custkey") % 5 + 1
    return table(spark, folder, "orders").select(
        "o_orderkey", fn.page_alternative(F.lit("/list<, _2,_3>.html"), page).alias("request"))


@query("url_options", r"""
SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'POST' END AS method,
       CASE WHEN page_id % 2 = 0 THEN 'q=' || page_id END AS body, CASE WHEN page_id % 2 = 0 THEN 'x' END AS agent,
       CASE WHEN page_id % 2 = 0 THEN 2 END AS retry
FROM pages""")
def url_options(spark, folder):
    options = F.to_json(F.struct(
        F.lit("POST").alias("method"), F.concat(F.lit("q="), F.col("page_id")).alias("body"),
        F.create_map(F.lit("agent"), F.lit("x")).alias("headers"), F.lit(2).alias("retry")))
    request = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(" , "), options)).otherwise(F.col("url"))
    url, parsed = fn.split_options(request)
    return table(spark, folder, "pages").select(
        "page_id", url.alias("url"), parsed["method"].alias("method"), parsed["body"].alias("body"),
        parsed["headers"]["agent"].alias("agent"), parsed["retry"].alias("retry"))


@query("form_fields", r"""
SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS kind,
       CASE WHEN event_type <> 'view' THEN 'reader ' || user_id END AS reader, event_type = 'view' AS is_json FROM events""")
def form_fields(spark, folder):
    form = F.concat(F.lit("kind="), "event_type", F.lit("&reader=reader+"), F.col("user_id"))
    body = F.when(F.col("event_type") == "view", F.col("props")).otherwise(form)
    fields = fn.form_fields(body)
    return table(spark, folder, "events").select(
        "event_id", fields["kind"].alias("kind"), fields["reader"].alias("reader"), fields.isNull().alias("is_json"))


@query("merged_headers", """
SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'own' ELSE 'default' END AS agent,
       CASE WHEN s_nationkey % 3 = 0 THEN 'login' || s_suppkey END AS cookie, 'GET' AS verb, CAST(NULL AS VARCHAR) AS proxy
FROM supplier""")
def merged_headers(spark, folder):
    """Default, login and request headers laid over each other."""
    def layer(condition, *pairs):
        return F.when(condition, F.create_map(*pairs))

    nation = F.col("s_nationkey")
    default = F.create_map(F.lit("agent"), F.lit("default"), F.lit("proxy"), F.lit("p"))
    login = layer(nation % 3 == 0, F.lit("cookie"), F.concat(F.lit("login"), F.col("s_suppkey")))
    own = layer(nation % 2 == 0, F.lit("agent"), F.lit("own"))
    merged = fn.merge_headers(default, login, own, F.create_map(F.lit("verb"), F.lit("GET")))
    return table(spark, folder, "supplier").withColumn("h", merged).select(
        "s_suppkey", *[F.try_element_at("h", F.lit(n)).alias(n) for n in ("agent", "cookie", "verb", "proxy")])


_RESOLVE_SQL = r"""
WITH parts AS (
  SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+:)', 1) AS scheme, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') AS origin,
         regexp_replace(url, '[?#].*$', '') AS no_query, regexp_replace(url, '#.*$', '') AS no_fragment FROM pages
)
SELECT page_id, origin || '/next' AS rooted, scheme || '//cdn.example.org/x' AS other_host,
       regexp_replace(no_query, '[^/]*$', '') || 'a/b.html' AS relative, no_query || '?p=2' AS query, no_fragment || '#end' AS fragment,
       'ftp://h/f' AS absolute, '' AS blank FROM parts"""


@query("resolve_links", _RESOLVE_SQL)
def resolve_links(spark, folder):
    shapes = {
        "rooted": "/next", "other_host": "//cdn.example.org/x", "relative": " a/b.html", "query": "?p=2", "fragment": "#end",
        "absolute": "ftp://h/f", "blank": "  ",
    }
    return table(spark, folder, "pages").select(
        "page_id", *[fn.resolve(F.col("url"), F.lit(u)).alias(n) for n, u in shapes.items()])


@query("resolve_dotted", r"""
WITH parts AS (
  SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') AS origin, regexp_replace(url, '[?#].*$', '') AS no_query FROM pages
)
SELECT page_id, CASE WHEN no_query LIKE '%/' THEN regexp_replace(no_query, '[^/]*/[^/]*$', '')
                     ELSE regexp_replace(no_query, '[^/]*/[^/]*$', '') END || 'up.html' AS parent,
       regexp_replace(no_query, '[^/]*$', '') || 'x' AS same FROM parts""")
def resolve_dotted(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", fn.resolve(F.col("url"), F.lit("../up.html")).alias("parent"),
        fn.resolve(F.col("url"), F.lit("./x")).alias("same"))


@query("url_parts", r"""
SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') AS base, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host,
       regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
       nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
       nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm FROM pages""")
def url_parts(spark, folder):
    url = F.col("url")
    query_map = fn.query_map(url)
    return table(spark, folder, "pages").select(
        "page_id", fn.base_url(url).alias("base"), fn.authority(url).alias("host"), fn.url_path(url).alias("path"),
        F.try_element_at(query_map, F.lit("page")).alias("page"), F.try_element_at(query_map, F.lit("utm_source")).alias("utm"))


@query("payload_kind", """
SELECT 'page' AS origin, page_id AS id, false AS is_json, true AS is_html, contains(html, '%') AS encoded, false AS has_scheme FROM pages
UNION ALL SELECT 'event', event_id, true, false, false, false FROM events
UNION ALL SELECT 'link', page_id, false, false, contains(url, '%'), true FROM pages""")
def payload_kind(spark, folder):
    pages = table(spark, folder, "pages")
    rows = (
        pages.select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("body"))
        .unionByName(table(spark, folder, "events").select(F.lit("event").alias("origin"), F.col("event_id").alias("id"), F.col("props").alias("body")))
        .unionByName(pages.select(F.lit("link").alias("origin"), F.col("page_id").alias("id"), F.col("url").alias("body")))
    )
    body = F.col("body")
    return rows.select(
        "origin", "id", fn.is_json(body).alias("is_json"), fn.looks_like_html(body).alias("is_html"),
        fn.percent_encoded(body).alias("encoded"), fn.has_scheme(body).alias("has_scheme"))


@query("link_frontier", f"""WITH {NAV_SQL}
SELECT DISTINCT regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') || h AS link FROM (SELECT url, unnest(hrefs) AS h FROM nav)""")
def link_frontier(spark, folder):
    """Distinct absolute links of all pages."""
    links = nav_links(spark, folder).select("url", F.explode("hrefs").alias("href"))
    return links.select(fn.resolve(F.col("url"), F.col("href")).alias("link")).distinct()
