"""Queries over chapter lists, page chains, chapter text and replace rules."""

from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators import content, feeds, toc
from folioweave.operators.content import ReplaceRule
from folioweave.plans.registry import query
from folioweave.plans.tables import CHAPTERS_SQL, chapters, table, toc_rows

_TOC_SQL = """
links AS (
  SELECT l_suppkey AS book, '/c/' || l_partkey AS url, 'Chapter ' || l_partkey AS title, l_orderkey, l_linenumber, l_partkey FROM lineitem
), kept AS (
  SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY book, url ORDER BY l_orderkey {d}, l_linenumber {d}, l_partkey {d}) = 1
), toc AS (
  SELECT book, url, title, row_number() OVER (PARTITION BY book ORDER BY l_orderkey {e}, l_linenumber {e}, l_partkey {e}) - 1 AS idx FROM kept
)"""
_DEFAULT_TOC = _TOC_SQL.format(d="DESC", e="ASC")
_REVERSED_TOC = _TOC_SQL.format(d="ASC", e="DESC")
# Lines of this many orders share a chunk of a book's chapter list.
_ORDERS_PER_CHUNK = 100_000


def _toc(spark, folder, reversed_list=False):
    chunk = F.floor(F.col("pos.l_orderkey") / _ORDERS_PER_CHUNK)
    return toc.build_toc(toc_rows(spark, folder), chunk, reversed_list).select("book", "idx", "url", "title")


@query("build_toc", f"WITH {_DEFAULT_TOC} SELECT book, idx, url, title FROM toc")
def build_toc(spark, folder):
    return _toc(spark, folder)


@query("build_toc_reversed", f"WITH {_REVERSED_TOC} SELECT book, idx, url, title FROM toc")
def build_toc_reversed(spark, folder):
    return _toc(spark, folder, True)


@query("reverse_toc", f"WITH {_DEFAULT_TOC} SELECT book, url, max(idx) OVER (PARTITION BY book) - idx AS idx FROM toc")
def reverse_toc(spark, folder):
    return toc.reverse_toc(_toc(spark, folder)).select("book", "url", "idx")


@query("toc_summary", f"WITH {_DEFAULT_TOC} SELECT book, count(*) AS chapter_count, arg_max(title, idx) AS latest_title FROM toc GROUP BY 1")
def toc_summary(spark, folder):
    return toc.toc_summary(_toc(spark, folder))


@query("next_chapter", f"""WITH {_DEFAULT_TOC}
SELECT book, idx, url, lead(url) OVER (PARTITION BY book ORDER BY idx) AS next_url FROM toc""")
def next_chapter(spark, folder):
    return toc.next_chapter(_toc(spark, folder)).select("book", "idx", "url", "next_url")


@query("chapter_slice", f"""WITH {_DEFAULT_TOC}, sized AS (SELECT *, count(*) OVER (PARTITION BY book) AS n FROM toc)
SELECT book, idx, title, greatest(0, n - 30) AS remaining FROM sized WHERE idx >= 10 AND idx < 30""")
def chapter_slice(spark, folder):
    return toc.chapter_slice(_toc(spark, folder), 10, 30).select("book", "idx", "title", "remaining")


@query("chapter_filter", f"WITH {CHAPTERS_SQL} SELECT book, idx, title FROM chapters WHERE contains(lower(title), 'user')")
def chapter_filter(spark, folder):
    wanted = F.contains(F.lower("title"), F.lit("User".lower()))
    return chapters(spark, folder).filter(wanted).select("book", "idx", "title")


@query("next_page_chain", f"""WITH RECURSIVE {CHAPTERS_SQL}, walk AS (
  SELECT book, url AS start, url, 0::BIGINT AS depth, idx FROM chapters WHERE idx = 0
  UNION ALL
  SELECT w.book, w.start, c.url, w.depth + 1, c.idx FROM walk w JOIN chapters c ON c.book = w.book AND c.idx = w.idx + 1
)
SELECT start, url, depth FROM walk""")
def next_page_chain(spark, folder):
    """Each turn links to the next; chains start at the first one of a conversation."""
    rows = chapters(spark, folder)
    links = rows.select("url", F.concat(F.lit("c"), "book", F.lit("/"), F.col("idx") + 1).alias("next_url"))
    links = links.join(rows.select(F.col("url").alias("next_url")), "next_url", "left_semi")
    starts = rows.filter(F.col("idx") == 0).select(F.col("url").alias("start"))
    return toc.follow_links(starts, links)


@query("page_chains", f"""WITH {CHAPTERS_SQL}, heads AS (
  SELECT book, idx, url, lead(idx) OVER (PARTITION BY book ORDER BY idx) AS stop FROM chapters WHERE role = 'user'
)
SELECT h.url AS start, c.url, c.idx - h.idx AS depth FROM heads h JOIN chapters c ON c.book = h.book AND c.idx >= h.idx AND (h.stop IS NULL OR c.idx < h.stop)""")
def page_chains(spark, folder):
    """A chapter starts at a user's turn; its chain of pages ends before the next chapter's page."""
    rows = chapters(spark, folder)
    links = rows.select("url", F.concat(F.lit("c"), "book", F.lit("/"), F.col("idx") + 1).alias("next_url"))
    links = links.join(rows.select(F.col("url").alias("next_url")), "next_url", "left_semi")
    heads = toc.next_chapter(rows.filter("role = 'user'")).select("url", "next_url")
    return toc.page_chains(heads, links)


@query("fan_out_pages", f"""WITH {CHAPTERS_SQL}
SELECT 'c' || h.book || '/0' AS start, CAST(c.idx AS BIGINT) AS link_ord, c.url, c.text
FROM (SELECT DISTINCT book FROM chapters) h JOIN chapters c ON c.book = h.book AND c.idx > 0 AND c.idx <> 3""")
def fan_out_pages(spark, folder):
    """The first turn names all others at once; the fourth is the next chapter's page."""
    rows = chapters(spark, folder)
    links = rows.select(
        F.concat(F.lit("c"), "book", F.lit("/0")).alias("start"), F.col("idx").alias("link_ord"), "url",
        F.concat(F.lit("c"), "book", F.lit("/3")).alias("next_url"))
    return toc.fan_out_pages(links, rows.select("url", "text")).select("start", "link_ord", "url", "text")


@query("stitch_pages", """
SELECT conv_id AS book, turn // 4 AS part, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY 1, 2""")
def stitch_pages(spark, folder):
    """Parts of four pages, to show the split; a part holds thousands by default."""
    pages = chapters(spark, folder).select("book", F.col("idx").alias("page_no"), "text")
    return toc.stitch_pages(pages, ["book"], 4)


@query("access_flags", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_returnflag = 'R' AND l_linestatus <> 'F' AS locked, l_linenumber = 1 AS divider FROM lineitem""")
def access_flags(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("is_vip"),
        tx.is_true(F.when(F.col("l_linestatus") == "F", "YES").otherwise("no")).alias("is_pay"),
        (F.col("l_linenumber") == 1).alias("is_volume"))
    return toc.access_flags(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "locked", "divider")


@query("invalid_chapters", f"""WITH {CHAPTERS_SQL}
SELECT book, idx, CASE WHEN idx IN (0, 1, 2) AND role <> 'assistant' THEN 'invalid_url' END AS error FROM chapters""")
def invalid_chapters(spark, folder):
    """The first three turns get bad addresses; a volume heading (the assistant's) may have one."""
    book_url = F.concat(F.lit("b"), "book")
    address = F.when(F.col("idx") == 0, book_url).when(F.col("idx") == 1, F.lit("/toc")).when(F.col("idx") == 2, "").otherwise(F.col("url"))
    rows = chapters(spark, folder).select(
        "book", "idx", address.alias("url"), book_url.alias("book_url"), F.lit("/toc").alias("toc_url"),
        (F.col("role") == "assistant").alias("is_volume"))
    return toc.chapter_errors(rows).select("book", "idx", "error")


@query("title_hook", f"""WITH {CHAPTERS_SQL}
SELECT book, idx, CASE WHEN idx = 0 THEN title ELSE (idx + 1) || '. ' || title END AS title FROM chapters""")
def title_hook(spark, folder):
    hook = F.when(F.col("idx") > 0, F.concat((F.col("idx") + 1).cast("string"), F.lit(". "), "title")).otherwise(" ")
    return toc.retitle(chapters(spark, folder), hook).select("book", "idx", "title")


# -- replace rules -----------------------------------------------------------

RULES = [
    ReplaceRule(r"\bthe\b", "THE", "the", id=3, order=1),
    ReplaceRule("THE of", "[of]", "of", id=1, order=2, is_regex=False),
    ReplaceRule("[aeiou]{3,}", "~", "vowels", id=2, order=1, scope="en, fr"),
    ReplaceRule("Chapter", "Ch.", "title", id=4, order=0, scope_title=True, scope_content=False),
    ReplaceRule("ion", "ION", "src", id=5, order=3, scope="SRC1", exclude_scope="src12\nen"),
    ReplaceRule("unused", "", "off", id=6, enabled=False),
    ReplaceRule("broken(", "", "broken", id=7),
]

_S1 = "regexp_replace(text, '[aeiou]{3,}', '~', 'g')"
_RULES_SQL = """
s1 AS (SELECT doc_id, lang, source, text, CASE WHEN lang IN ('en', 'fr') THEN regexp_replace(text, '[aeiou]{3,}', '~', 'g') ELSE text END AS t1 FROM documents),
s2 AS (SELECT *, regexp_replace(t1, '(^|[^a-zA-Z0-9_ßäöüéèêçáíóúñÉÈÊÇÁÍÓÚÑÄÖÜ])the($|[^a-zA-Z0-9_ßäöüéèêçáíóúñÉÈÊÇÁÍÓÚÑÄÖÜ])', '\\1THE\\2', 'g') AS t2a FROM s1),
s2b AS (SELECT *, regexp_replace(t2a, '(^|[^a-zA-Z0-9_ßäöüéèêçáíóúñÉÈÊÇÁÍÓÚÑÄÖÜ])the($|[^a-zA-Z0-9_ßäöüéèêçáíóúñÉÈÊÇÁÍÓÚÑÄÖÜ])', '\\1THE\\2', 'g') AS t2 FROM s2),
s3 AS (SELECT *, replace(t2, 'THE of', '[of]') AS t3 FROM s2b),
s4 AS (SELECT *, CASE WHEN source LIKE 'src1%' AND source <> 'src12' AND lang <> 'en' THEN replace(t3, 'ion', 'ION') ELSE t3 END AS t4 FROM s3)"""


def _documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return docs, content.context_tokens(F.col("source"), F.col("lang"))


@query("apply_replace_rules", f"WITH {_RULES_SQL} SELECT doc_id, t4 AS text FROM s4")
def apply_replace_rules(spark, folder):
    docs, tokens = _documents(spark, folder)
    return content.apply_rules(docs, "text", RULES, tokens).select("doc_id", "text")


@query("effective_rules", f"""WITH {_RULES_SQL}
SELECT doc_id, array_to_string(list_filter([CASE WHEN t1 <> text THEN 'vowels' END, CASE WHEN t2 <> t1 THEN 'the' END,
       CASE WHEN t3 <> t2 THEN 'of' END, CASE WHEN t4 <> t3 THEN 'src' END], lambda x: x IS NOT NULL), ',') AS rules FROM s4""")
def effective_rules(spark, folder):
    docs, tokens = _documents(spark, folder)
    out = content.apply_rules(docs, "text", RULES, tokens, effective="rules")
    return out.select("doc_id", F.array_join("rules", ",").alias("rules"))


@query("rule_scope_join", """
SELECT doc_id, rule FROM documents, (VALUES ('the'), ('of'), ('vowels'), ('src')) AS r(rule)
WHERE rule IN ('the', 'of') OR (rule = 'vowels' AND (contains(lang, 'en') OR contains(lang, 'fr')))
   OR (rule = 'src' AND contains(source, 'src1') AND NOT contains(source, 'src12') AND NOT contains(lang, 'en'))""")
def rule_scope_join(spark, folder):
    docs, tokens = _documents(spark, folder)
    return content.rules_in_scope(docs, RULES, tokens).select("doc_id", F.col("rule").alias("rule"))


@query("long_rule_list", r"""
WITH words AS (
  SELECT list(w ORDER BY w) AS ws FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS w FROM benchmark)
)
SELECT doc_id, list_reduce(list_prepend(text, ws), lambda t, w: replace(t, w, upper(w))) AS text FROM documents, words""")
def long_rule_list(spark, folder):
    """Hundreds of rules, one for each word of the benchmark, over every document."""
    found = table(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    words = [r.w for r in found.distinct().orderBy("w").collect()]
    rules = [ReplaceRule(w, w.upper(), w, id=i) for i, w in enumerate(words)]
    docs, tokens = _documents(spark, folder)
    return content.apply_rules(docs, "text", rules, tokens).select("doc_id", "text")


@query("display_title", f"WITH {CHAPTERS_SQL} SELECT book, idx, replace(title, 'Chapter', 'Ch.') AS title FROM chapters")
def display_title(spark, folder):
    return content.display_title(chapters(spark, folder), RULES).select("book", "idx", "title")


@query("valid_rules", """SELECT item_id, length(text) > 0 AND item_id % 3 <> 1 AND item_id % 3 <> 2 AS valid FROM benchmark""")
def valid_rules(spark, folder):
    """Rule patterns made from benchmark texts: quoted ones are good, an open bracket and a bare ``|`` are not."""
    from folioweave.functions.patterns import valid_pattern

    tail = F.when(F.col("item_id") % 3 == 1, "(").when(F.col("item_id") % 3 == 2, "|").otherwise("")
    pattern = F.concat(tx.quote_pattern(F.col("text")), tail)
    return table(spark, folder, "benchmark").select("item_id", valid_pattern(pattern).alias("valid"))


@query("finish_content", f"""WITH {CHAPTERS_SQL}, cleaned AS (
  SELECT book, idx, role, replace(replace(text, 'la', 'LA'), 'Re', 're') AS text FROM chapters
), lines AS (
  SELECT book, idx, role, list_filter(list_transform(string_split(text, chr(10)),
         lambda s: trim(s, ' 　' || chr(9) || chr(13) || chr(10))), lambda s: s <> '') AS l FROM cleaned
)
SELECT book, idx, array_to_string(list_transform(l, lambda s: '　　' || s), chr(10)) AS text,
       CASE WHEN len(l) = 0 AND role <> 'assistant' THEN 'empty_content' END AS error FROM lines""")
def finish_content(spark, folder):
    """Source-wide cleaning, rules, removal of the title put in front, indentation."""
    rows = chapters(spark, folder)
    rows = rows.select(
        "book", "idx", "title", F.concat(F.lit("Book "), "book").alias("book_name"),
        F.concat(F.lit("Book "), "book", F.lit(": "), "title", F.lit("\n"), "text").alias("text"),
        (F.col("role") == "assistant").alias("is_volume"))
    rules = [ReplaceRule("Re", "re", "re", id=1, is_regex=False)]
    done = content.finish_content(rows, rules, content.context_tokens(F.col("title")), "la", "LA")
    return done.select("book", "idx", "text", "error")


# -- store -------------------------------------------------------------------


@query("content_keys", """SELECT conv_id, turn, sha1('s' || chr(10) || conv_id || chr(10) || turn) AS key FROM conversations""")
def content_keys(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", tx.identity_key(F.lit("s"), F.col("conv_id"), F.col("turn")).alias("key"))


@query("store_upsert", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'new: ' || text ELSE text END AS text, CAST(CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS BIGINT) AS version
FROM conversations WHERE turn <> 3""")
def store_upsert(spark, folder):
    """The assistant's turns are stored again in a newer version; turn 3 is then made invalid."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    old = rows.drop("role").withColumn("version", F.lit(1).cast("bigint"))
    new = rows.filter("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("new: "), "text").alias("text"), F.lit(2).cast("bigint").alias("version"))
    stored = content.upsert(old, new, ["conv_id", "turn"], "version")
    gone = rows.filter("turn = 3").select("conv_id", "turn")
    return content.invalidate(stored, gone, ["conv_id", "turn"])


@query("missing_content", """SELECT conv_id, turn FROM conversations WHERE NOT (turn < 2 AND role = 'user')""")
def missing_content(spark, folder):
    key = tx.identity_key(F.col("conv_id"), F.col("turn"))
    rows = table(spark, folder, "conversations").withColumn("key", key)
    store = rows.filter("turn < 2 AND role = 'user'").select("key")
    return content.missing_content(rows, store).select("conv_id", "turn")


@query("body_reuse", """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'toc' WHEN page_id % 5 = 1 THEN 'info' ELSE html END AS body FROM pages""")
def body_reuse(spark, folder):
    pages = table(spark, folder, "pages")
    turn = F.col("page_id") % 5
    books = pages.select(
        "page_id", "url", F.when(turn == 0, "toc").alias("toc_html"), F.when(turn <= 1, "info").alias("info_html"))
    return content.body_reuse(books, pages.select("url", F.col("html").alias("body"))).select("page_id", "body")


@query("cache_valid", """SELECT event_id, CASE WHEN value > 50 THEN 0 ELSE epoch_us(ts) // 1000000 + 86400 END AS expires_at FROM events
WHERE value > 50 OR epoch_us(ts) // 1000000 + 86400 >= 1705320000""")
def cache_valid(spark, folder):
    from folioweave.sources.stores import valid_entries

    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    cache = table(spark, folder, "events").select(
        "event_id", F.when(F.col("value") > 50, 0).otherwise(seconds + 86400).cast("bigint").alias("expires_at"))
    return valid_entries(cache, F.lit(1705320000))


# -- feeds and reviews -------------------------------------------------------


@query("dedupe_articles", """
WITH a AS (
  SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/d/' || doc_id % 50 END AS link,
         CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Title ' || doc_id % 40 END AS title FROM documents
)
SELECT source, link, title, doc_id FROM a WHERE link <> '' OR title <> ''
QUALIFY row_number() OVER (PARTITION BY source, coalesce(nullif(link, ''), nullif(title, '')) ORDER BY doc_id) = 1""")
def dedupe_articles(spark, folder):
    number = F.col("doc_id")
    articles = table(spark, folder, "documents").select(
        "doc_id", number.alias("ord"), "source",
        F.when(number % 3 == 0, "").otherwise(F.concat(F.lit("/d/"), number % 50)).alias("link"),
        F.when(number % 7 == 0, "").otherwise(F.concat(F.lit("Title "), number % 40)).alias("title"))
    return feeds.dedupe_articles(articles, "source").select("source", "link", "title", "doc_id")


@query("article_detail", """
SELECT item_id, 'd' || item_id AS link, CASE WHEN item_id % 4 = 0 THEN 'own' WHEN d.text IS NOT NULL THEN d.text ELSE 'about ' || item_id END AS content
FROM benchmark LEFT JOIN documents d ON doc_id = item_id AND length(d.text) > 0""")
def article_detail(spark, folder):
    articles = table(spark, folder, "benchmark").select(
        "item_id", F.concat(F.lit("d"), "item_id").alias("link"),
        F.when(F.col("item_id") % 4 == 0, "own").otherwise("").alias("content"),
        F.concat(F.lit("about "), "item_id").alias("description"))
    extracted = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("link"), F.col("text").alias("page_content"))
    return feeds.article_detail(articles, extracted).select("item_id", "link", "content")
