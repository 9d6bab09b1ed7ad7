"""Rule catalogue: filters, order, tags, differences, labels, categories, requests, rule report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from folioweave.functions import urls
from folioweave.sources.schemas import RULE_GROUPS

# Tags that mark a source as broken.
BROKEN_PART, TIMED_OUT = "失效", "校验超时"
ERROR_NOTE = "// Error: "


def filled(column: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(column), F.lit("")))) > 0


def tags(groups: Column) -> Column:
    """Distinct trimmed tags of a comma or newline list, in the order written."""
    parts = F.transform(F.split(F.coalesce(groups, F.lit("")), "[,\n]"), lambda t: F.trim(t))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def _joined(items: Column) -> Column:
    return F.nullif(F.array_join(F.array_sort(items), ","), F.lit(""))


def add_tags(groups: Column, extra: Column) -> Column:
    return _joined(F.array_union(tags(groups), tags(extra)))


def remove_tags(groups: Column, gone: Column) -> Column:
    return _joined(F.array_except(tags(groups), tags(gone)))


def broken_tags(groups: Column) -> Column:
    return F.filter(tags(groups), lambda t: F.contains(t, F.lit(BROKEN_PART)) | (t == TIMED_OUT))


def add_error_note(comment: Column, message: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit(ERROR_NOTE), message), F.nullif(comment, F.lit("")))


def remove_error_notes(comment: Column) -> Column:
    """Blank-line separated parts that are not error notes, joined by a line end."""
    kept = F.filter(F.split(comment, "\n\n"), lambda p: ~p.startswith(ERROR_NOTE))
    return F.array_join(kept, "\n")


def filter_catalog(catalog: DataFrame, tag: str | None = None, text: str = "") -> DataFrame:
    """Sources with exactly this tag and with ``text`` in name, tags or URL, blind to case."""
    if tag:
        catalog = catalog.filter(F.array_contains(tags(F.col("bookSourceGroup")), tag))
    if text.strip():
        row = F.lower(F.concat_ws(" ", "bookSourceName", "bookSourceGroup", "bookSourceUrl"))
        catalog = catalog.filter(F.contains(row, F.lit(text.strip().lower())))
    return catalog


def catalog_parts(catalog: DataFrame) -> DataFrame:
    """Light projection: identity, order, and whether there is a login and an explore URL."""
    return catalog.select(
        "bookSourceUrl", "bookSourceName", "bookSourceGroup", "customOrder", "enabled", "enabledExplore",
        filled("loginUrl").alias("hasLoginUrl"), filled("exploreUrl").alias("hasExploreUrl"),
        filled("searchUrl").alias("searchable"),
    )


def catalog_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.coalesce("customOrder", F.lit(0)), "bookSourceName", "bookSourceUrl")


def group_index(catalog: DataFrame) -> DataFrame:
    return (
        catalog.select(F.explode(tags(F.col("bookSourceGroup"))).alias("tag"))
        .groupBy("tag").agg(F.count(F.lit(1)).alias("sources"))
    )


def display_labels(catalog: DataFrame, default_keyword: str, other_comment: str) -> DataFrame:
    """Shown name, keyword for a check, and variable note over another note."""
    named = F.when(filled("bookSourceGroup"), F.concat(
        "bookSourceName", F.lit(" ("), "bookSourceGroup", F.lit(")")
    )).otherwise(F.col("bookSourceName"))
    keyword = F.coalesce(F.nullif(F.trim("ruleSearch.checkKeyWord"), F.lit("")), F.lit(default_keyword))
    note = F.concat_ws("\n", F.nullif("variableComment", F.lit("")), F.lit(other_comment))
    return catalog.select(
        "bookSourceUrl", named.alias("label"), keyword.alias("check_keyword"), note.alias("variable_note")
    )


def catalog_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed; null and empty count as equal. Changed columns are named."""
    before, after = F.struct(*columns).alias("before"), F.struct(*columns).alias("after")
    both = old.select(key, before).join(new.select(key, after), key, "full_outer")

    def comparable(side: str, name: str) -> Column:
        value, kind = F.col(side)[name], old.schema[name].dataType
        if isinstance(kind, StringType):
            return F.coalesce(value, F.lit(""))
        return F.coalesce(F.to_json(value), F.lit("{}")) if isinstance(kind, StructType) else value

    def differs(name: str) -> Column:
        return ~comparable("before", name).eqNullSafe(comparable("after", name))

    changed = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in columns]))
    status = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
        .when(F.size("changed") > 0, "changed").otherwise("same")
    )
    return both.withColumn("changed", changed).select(key, status.alias("status"), "changed").filter("status <> 'same'")


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


# -- categories and requests -------------------------------------------------


def parse_categories(catalog: DataFrame) -> DataFrame:
    """Category rows of ``exploreUrl``: a JSON array, or ``title::url`` items on ``&&`` or lines.

    A rule that starts like JSON and does not parse gives one error row.
    """
    rule = F.trim("exploreUrl")
    as_json = F.from_json(rule, "array<struct<title: string, url: string, style: map<string,string>>>")
    looks_json = rule.startswith("[")
    items = F.transform(
        F.filter(F.split(rule, "(?:&&|\n)+"), lambda s: F.trim(s) != ""),
        lambda s: F.struct(
            F.trim(F.split_part(s, F.lit("::"), F.lit(1))).alias("title"),
            F.nullif(F.trim(F.split_part(s, F.lit("::"), F.lit(2))), F.lit("")).alias("url"),
            F.lit(None).cast("map<string,string>").alias("style"),
        ),
    )
    failed = looks_json & F.try_parse_json(rule).isNull()
    error = F.array(F.struct(F.lit("ERROR").alias("title"), rule.alias("url"), F.lit(None).cast("map<string,string>").alias("style")))
    rows = F.when(failed, error).when(looks_json, as_json).otherwise(items)
    return (
        catalog.filter(filled("exploreUrl"))
        .select("bookSourceUrl", failed.alias("failed"), F.posexplode(rows).alias("position", "c"))
        .select("bookSourceUrl", "position", "c.title", "c.url", "c.style", "failed")
    )


def filter_categories(categories: DataFrame, text: str) -> DataFrame:
    wanted = F.lit(text.strip().lower())
    return categories.filter(F.contains(F.lower("title"), wanted) | F.contains(F.lower(F.coalesce("url", F.lit(""))), wanted))


def expand_requests(catalog: DataFrame, keywords: Sequence[str], pages: int = 1) -> DataFrame:
    """One request per searchable source, keyword and page.

    The keywords of a search are few and come as values, so the requests are
    generated where each source stands; nothing is joined or shuffled.
    """
    words = F.explode(F.array(*map(F.lit, keywords)))
    numbered = catalog.filter(filled("searchUrl")).select("bookSourceUrl", "searchUrl", words.alias("keyword"))
    paged = numbered.withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(pages).cast("bigint"))))
    scripted = r"(?is)@js:|<js>|\{\{(?!(?:key|page|searchKey|searchPage|searchPage_1)\}\})"
    return paged.select(
        "bookSourceUrl", "keyword", "page",
        urls.fill_request(F.col("searchUrl"), F.col("keyword"), F.col("page")).alias("request"),
        F.col("searchUrl").rlike(scripted).alias("needs_script"),
    )


# -- rule report -------------------------------------------------------------


def rule_rows(catalog: DataFrame) -> DataFrame:
    """Every non-empty rule string of the catalogue: source, stage, field, rule."""
    stages = [
        F.struct(
            F.lit(group).alias("stage"),
            F.map_from_arrays(
                F.array(*[F.lit(n) for n in names]), F.array(*[F.col(group)[n] for n in names])
            ).alias("rules"),
        )
        for group, names in RULE_GROUPS.items()
    ]
    return (
        catalog.select("bookSourceUrl", F.explode(F.array(*stages)).alias("s"))
        .select("bookSourceUrl", "s.stage", F.explode("s.rules").alias("field", "rule"))
        .filter(F.coalesce(F.col("rule"), F.lit("")) != "")
    )


def rule_mode(rule: Column) -> Column:
    """How a rule is read, by its prefix."""
    upper = F.upper(rule)
    return (
        F.when(rule.rlike(r"(?is)@js:|<js>"), "script")
        .when(rule.startswith(":"), "regex")
        .when(upper.startswith("@CSS:"), "css")
        .when(rule.startswith("@@"), "default")
        .when(upper.startswith("@XPATH:") | rule.startswith("/"), "xpath")
        .when(upper.startswith("@JSON:") | rule.startswith("$.") | rule.startswith("$["), "json")
        .when(rule.rlike(r"(?is)\{\{|@get:\{|\$\d"), "template")
        .otherwise("default")
    )


def rule_flags(rules: DataFrame) -> DataFrame:
    rule = F.col("rule")
    body = F.split_part(rule, F.lit("##"), F.lit(1))
    return rules.withColumns({
        "mode": rule_mode(rule),
        "needs_script": rule.rlike(r"(?is)@js:|<js>"),
        "needs_browser": rule.rlike(r"(?i)webview|startbrowser"),
        "broken": body.rlike(r"[.:!]\s*$"),
    })


def rule_report(catalog: DataFrame) -> DataFrame:
    """Per source and stage: rules by mode, and what cannot run here."""
    modes = ["css", "default", "json", "regex", "script", "template", "xpath"]
    return (
        rule_flags(rule_rows(catalog)).groupBy("bookSourceUrl", "stage").agg(
            F.count(F.lit(1)).alias("rules"),
            *[F.count_if(F.col("mode") == m).alias(f"{m}_rules") for m in modes],
            F.bool_or("needs_script").alias("needs_script"),
            F.bool_or("needs_browser").alias("needs_browser"),
            F.count_if("broken").alias("broken_rules"),
        )
    )
