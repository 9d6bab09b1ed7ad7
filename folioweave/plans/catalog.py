"""Queries over the rule catalogue."""

from pyspark.sql import functions as F

from folioweave.operators import catalog as op
from folioweave.operators import health
from folioweave.plans.registry import query
from folioweave.plans.tables import CATALOG_SQL, EVENTS_SQL, catalog, reading_events, source_texts, table
from folioweave.sources import catalog as src


@query("catalog_ingest", f"""WITH {CATALOG_SQL}
SELECT source, name, groups, type, custom_order, true AS enabled, search_url, list_rule, url_rule, author_rule FROM catalog""")
def catalog_ingest(spark, folder):
    """JSON texts with rule groups as objects and as strings, an unknown field, and sources without a name."""
    return catalog(spark, folder).select(
        F.col("bookSourceUrl").alias("source"), F.col("bookSourceName").alias("name"), F.col("bookSourceGroup").alias("groups"),
        F.col("bookSourceType").alias("type"), F.col("customOrder").alias("custom_order"), "enabled",
        F.col("searchUrl").alias("search_url"), F.col("ruleSearch.bookList").alias("list_rule"),
        F.col("ruleSearch.bookUrl").alias("url_rule"), F.col("ruleSearch.author").alias("author_rule"))


@query("catalog_export", f"""WITH {CATALOG_SQL}
SELECT source, search_url IS NOT NULL AS has_search, login_url IS NOT NULL AS has_login, author_rule IS NOT NULL AS has_author,
       list_rule FROM catalog""")
def catalog_export(spark, folder):
    """Exported JSON names a field only where it has a value."""
    out = src.source_json(catalog(spark, folder))
    return out.select(
        F.get_json_object("json", "$.bookSourceUrl").alias("source"), F.contains("json", F.lit('"searchUrl"')).alias("has_search"),
        F.contains("json", F.lit('"loginUrl"')).alias("has_login"), F.contains("json", F.lit('"author"')).alias("has_author"),
        F.get_json_object("json", "$.ruleSearch.bookList").alias("list_rule"))


@query("replace_rule_ingest", """
SELECT item_id AS id, 'rule ' || item_id AS name, text AS pattern, '' AS replacement, item_id % 2 = 0 AS scope_title, true AS scope_content,
       true AS is_regex, CAST(CASE WHEN item_id % 3 = 1 THEN 500 ELSE 3000 END AS BIGINT) AS timeout_ms,
       CASE WHEN item_id % 2 = 0 THEN item_id ELSE item_id + 1 END AS "order" FROM benchmark""")
def replace_rule_ingest(spark, folder):
    """Rules made from benchmark texts; odd ones give their place under the older name."""
    item = F.col("item_id")
    rule = F.to_json(F.struct(
        item.alias("id"), F.concat(F.lit("rule "), item).alias("name"), F.col("text").alias("pattern"),
        F.when(item % 2 == 0, True).alias("scopeTitle"), F.when(item % 2 == 0, item).alias("sortOrder"),
        F.when(item % 2 == 1, item + 1).alias("order"), F.when(item % 3 == 1, 500).otherwise(0).alias("timeoutMillisecond")))
    texts = table(spark, folder, "benchmark").select(F.when(item % 2 == 0, rule).otherwise(F.concat(F.lit("["), rule, F.lit("]"))).alias("json"))
    parsed = src.parse_replace_rules(texts, "json")
    return parsed.select("id", "name", "pattern", "replacement", "scope_title", "scope_content", "is_regex", "timeout_ms",
                         F.col("order").cast("bigint").alias("order"))


@query("feed_catalog_ingest", """
SELECT 'https://feed' || s_suppkey AS url, s_name AS name, s_nationkey % 2 = 0 AS enabled, false AS single_url,
       0 AS custom_order, '@CSS:.item' AS articles FROM supplier""")
def feed_catalog_ingest(spark, folder):
    feed = F.to_json(F.struct(
        F.concat(F.lit("https://feed"), "s_suppkey").alias("sourceUrl"), F.col("s_name").alias("sourceName"),
        (F.col("s_nationkey") % 2 == 0).alias("enabled"), F.lit("@CSS:.item").alias("ruleArticles"), F.lit(1).alias("other")))
    parsed = src.parse_feeds(table(spark, folder, "supplier").select(feed.alias("json")), "json")
    return parsed.select(F.col("sourceUrl").alias("url"), F.col("sourceName").alias("name"), "enabled", F.col("singleUrl").alias("single_url"),
                         F.col("customOrder").alias("custom_order"), F.col("ruleArticles").alias("articles"))


@query("catalog_filter", f"""WITH {CATALOG_SQL}
SELECT source, name FROM catalog WHERE list_contains(string_split(groups, ','), 'region 1') AND contains(lower(name || ' ' || groups || ' ' || source), '#00000000')""")
def catalog_filter(spark, folder):
    found = op.filter_catalog(catalog(spark, folder), "region 1", " #00000000")
    return found.select(F.col("bookSourceUrl").alias("source"), F.col("bookSourceName").alias("name"))


@query("catalog_parts", f"""WITH {CATALOG_SQL}
SELECT source, login_url IS NOT NULL AS has_login, explore_url IS NOT NULL AS has_explore, search_url IS NOT NULL AS searchable FROM catalog""")
def catalog_parts(spark, folder):
    return op.catalog_parts(catalog(spark, folder)).select(
        F.col("bookSourceUrl").alias("source"), F.col("hasLoginUrl").alias("has_login"),
        F.col("hasExploreUrl").alias("has_explore"), "searchable")


@query("catalog_order", f"WITH {CATALOG_SQL} SELECT custom_order, name, source FROM catalog ORDER BY 1, 2, 3")
def catalog_order(spark, folder):
    return op.catalog_order(catalog(spark, folder)).select(
        F.col("customOrder").alias("custom_order"), F.col("bookSourceName").alias("name"), F.col("bookSourceUrl").alias("source"))


@query("group_index", f"""WITH {CATALOG_SQL}
SELECT trim(t) AS tag, count(*) AS sources FROM (SELECT unnest(string_split(groups, ',')) AS t FROM catalog) GROUP BY 1""")
def group_index(spark, folder):
    return op.group_index(catalog(spark, folder))


@query("display_labels", f"""WITH {CATALOG_SQL}
SELECT source, name || ' (' || groups || ')' AS label, 'sun' AS check_keyword,
       CASE WHEN variable_comment IS NULL THEN 'other' ELSE variable_comment || chr(10) || 'other' END AS variable_note FROM catalog""")
def display_labels(spark, folder):
    return op.display_labels(catalog(spark, folder), "sun", "other").withColumnRenamed("bookSourceUrl", "source")


@query("tag_ops", f"""WITH {CATALOG_SQL}, t AS (SELECT source, string_split(groups, ',') AS g FROM catalog)
SELECT source, array_to_string(list_sort(list_distinct(list_concat(g, ['new', 'region 1']))), ',') AS added,
       nullif(array_to_string(list_sort(list_filter(g, lambda x: x <> 'region 1')), ','), '') AS removed,
       list_contains(g, 'region 1') AS has FROM t""")
def tag_ops(spark, folder):
    groups = F.col("bookSourceGroup")
    return catalog(spark, folder).select(
        F.col("bookSourceUrl").alias("source"), op.add_tags(groups, F.lit("new\nregion 1")).alias("added"),
        op.remove_tags(groups, F.lit("region 1")).alias("removed"), F.array_contains(op.tags(groups), "region 1").alias("has"))


@query("invalid_tags", """
SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN '搜索失效' WHEN 1 THEN '校验超时' ELSE '' END AS broken, 'good' AS kept FROM supplier""")
def invalid_tags(spark, folder):
    nation = F.col("s_nationkey") % 3
    groups = F.when(nation == 0, "good,搜索失效").when(nation == 1, "校验超时\ngood").otherwise("good")
    broken = F.array_join(op.broken_tags(groups), ",")
    return table(spark, folder, "supplier").select("s_suppkey", broken.alias("broken"), op.remove_tags(groups, broken).alias("kept"))


@query("error_notes", """
SELECT s_suppkey, '// Error: timeout' || CASE WHEN s_nationkey % 2 = 0 THEN chr(10) || chr(10) || s_name ELSE '' END AS noted,
       CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE '' END AS cleared FROM supplier""")
def error_notes(spark, folder):
    comment = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name"))
    noted = op.add_error_note(comment, F.lit("timeout"))
    return table(spark, folder, "supplier").select("s_suppkey", noted.alias("noted"), op.remove_error_notes(noted).alias("cleared"))


@query("catalog_diff", """
SELECT 'https://s' || s_suppkey || '.example' AS source,
       CASE WHEN s_nationkey = 4 THEN 'removed' WHEN s_nationkey = 3 THEN 'added' ELSE 'changed' END AS status,
       CASE WHEN s_nationkey IN (3, 4) THEN 'all' WHEN s_nationkey = 5 THEN 'bookSourceName' WHEN s_nationkey % 2 = 0 THEN 'ruleSearch' END AS changed
FROM supplier WHERE s_nationkey < 20 AND (s_nationkey IN (3, 4, 5) OR s_nationkey % 8 = 6)""")
def catalog_diff(spark, folder):
    """A later catalogue: nation 3 came, 4 went, 5 is renamed, 6 and 14 have a new list rule; a blank group is no change."""
    rows = catalog(spark, folder)
    nation = F.col("customOrder")
    new = rows.filter(nation != 4).withColumns({
        "bookSourceName": F.when(nation == 5, F.concat("bookSourceName", F.lit("!"))).otherwise(F.col("bookSourceName")),
        "loginUrl": F.coalesce("loginUrl", F.lit("")),
        "ruleSearch": F.when(nation % 8 == 6, F.col("ruleSearch").withField("bookList", F.lit(".new"))).otherwise(F.col("ruleSearch")),
    })
    columns = ["bookSourceName", "bookSourceGroup", "loginUrl", "searchUrl", "customOrder", "ruleSearch"]
    diff = op.catalog_diff(rows.filter(nation != 3), new, "bookSourceUrl", columns)
    named = F.when(F.col("status") == "changed", F.array_join("changed", ",")).otherwise("all")
    return diff.select(F.col("bookSourceUrl").alias("source"), "status", named.alias("changed"))


@query("categories", f"""WITH {CATALOG_SQL}
SELECT source, p AS position, CASE p WHEN 0 THEN 'New' ELSE 'Top' END AS title, CASE p WHEN 0 THEN '/new' ELSE '/top' END AS url, false AS failed
FROM catalog, (VALUES (0), (1)) AS v(p) WHERE explore_url IS NOT NULL AND type <> 2
UNION ALL SELECT source, 0, 'J ' || name, '/j', false FROM catalog WHERE type = 2 AND custom_order <> 2
UNION ALL SELECT source, 0, 'ERROR', '[broken', true FROM catalog WHERE custom_order = 2""")
def categories(spark, folder):
    """Plain items as they are; type 2 gets a JSON array, nation 2 a broken one."""
    as_json = F.to_json(F.array(F.struct(F.concat(F.lit("J "), "bookSourceName").alias("title"), F.lit("/j").alias("url"))))
    rule = F.when(F.col("customOrder") == 2, "[broken").when(F.col("bookSourceType") == 2, as_json).otherwise(F.col("exploreUrl"))
    rows = op.parse_categories(catalog(spark, folder).withColumn("exploreUrl", rule))
    return rows.select(F.col("bookSourceUrl").alias("source"), "position", "title", "url", "failed")


@query("category_filter", f"""WITH {CATALOG_SQL}
SELECT source, 'Top' AS title, '/top' AS url FROM catalog WHERE explore_url IS NOT NULL""")
def category_filter(spark, folder):
    rows = op.filter_categories(op.parse_categories(catalog(spark, folder)), "TOP")
    return rows.select(F.col("bookSourceUrl").alias("source"), "title", "url")


@query("expand_requests", f"""WITH {CATALOG_SQL}
SELECT source, k AS keyword, CAST(p AS BIGINT) AS page, replace(replace(search_url, '{{{{key}}}}', k), '{{{{page}}}}', CAST(p AS VARCHAR)) AS request, false AS needs_script
FROM catalog, (VALUES ('sun'), ('red moon')) AS w(k), (VALUES (1), (2), (3)) AS n(p) WHERE search_url IS NOT NULL""")
def expand_requests(spark, folder):
    return op.expand_requests(catalog(spark, folder), ["sun", "red moon"], 3).withColumnRenamed("bookSourceUrl", "source")


@query("rule_report", f"""WITH {CATALOG_SQL}, counted AS (
  SELECT source, CASE WHEN author_rule IS NULL THEN 0 ELSE 1 END AS scripts, CASE WHEN url_rule LIKE '$%' THEN 1 ELSE 0 END AS jsons FROM catalog
)
SELECT source, 'ruleSearch' AS stage, CAST(3 + scripts AS BIGINT) AS rules, 2::BIGINT AS default_rules, CAST(jsons AS BIGINT) AS json_rules,
       CAST(1 - jsons AS BIGINT) AS xpath_rules, CAST(scripts AS BIGINT) AS script_rules, scripts > 0 AS needs_script FROM counted""")
def rule_report(spark, folder):
    rows = op.rule_report(catalog(spark, folder))
    return rows.select(F.col("bookSourceUrl").alias("source"), "stage", "rules", "default_rules", "json_rules", "xpath_rules", "script_rules", "needs_script")


# -- health ------------------------------------------------------------------

_OUTCOMES_SQL = EVENTS_SQL + """,
outcomes AS (
  SELECT reader AS source, book % 5 AS stage_no, CASE WHEN value > 40 THEN 'slow ' || book END AS error, ts, event_id FROM reading
), last AS (
  SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY source, stage_no ORDER BY ts DESC, event_id DESC) = 1
), health AS (
  SELECT source, max(ts) AS tested_at, count(error) = 0 AS passed,
         coalesce(substr(string_agg('stage' || stage_no || ': ' || error, '; ' ORDER BY stage_no) FILTER (error IS NOT NULL), 1, 200), 'OK') AS message
  FROM last GROUP BY 1
)"""


def _health(spark, folder):
    events = reading_events(spark, folder)
    stage = F.col("book") % 5
    outcomes = events.select(
        F.col("reader").alias("source"), stage.alias("stage_no"), F.concat(F.lit("stage"), stage).alias("stage"),
        F.struct("ts", "event_id").alias("ts"), F.when(F.col("value") > 40, F.concat(F.lit("slow "), "book")).alias("error"))
    return health.source_health(outcomes).withColumn("tested_at", F.col("tested_at.ts"))


@query("source_health", f"WITH {_OUTCOMES_SQL} SELECT source, tested_at, passed, message FROM health")
def source_health(spark, folder):
    return _health(spark, folder).select("source", "tested_at", "passed", "message")


@query("catalog_health", f"""WITH {_OUTCOMES_SQL}
SELECT s_suppkey AS source, s_name AS name, CASE WHEN passed THEN '✓' WHEN NOT passed THEN '✗' ELSE '?' END AS mark FROM supplier LEFT JOIN health ON source = s_suppkey""")
def catalog_health(spark, folder):
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("name"))
    return health.catalog_health(suppliers, _health(spark, folder)).select("source", "name", "mark")


@query("stage_metrics", """
SELECT lang AS stage, count(*) AS row_count, CAST(sum(length(text)) AS BIGINT) AS body_chars,
       arg_min(source || '/' || doc_id, doc_id) AS first_name, arg_max(source || '/' || doc_id, doc_id) AS last_name FROM documents GROUP BY 1""")
def stage_metrics(spark, folder):
    records = table(spark, folder, "documents").select(
        F.col("lang").alias("stage"), F.col("text").alias("body"), F.concat("source", F.lit("/"), "doc_id").alias("name"), F.col("doc_id").alias("ord"))
    return health.stage_metrics(records)


@query("sources_as_text", """SELECT 'https://s' || s_suppkey || '.example' AS source FROM supplier""")
def sources_as_text(spark, folder):
    """Identity of every source text, also of those ingest drops."""
    return source_texts(spark, folder).select(F.get_json_object("json", "$.bookSourceUrl").alias("source"))
