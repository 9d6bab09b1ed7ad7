"""Rule sets, feeds and replace rules: lenient ingest to declared types, and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.sources import schemas


def _typed_sources(rows: DataFrame) -> DataFrame:
    groups = [F.from_json(F.col(g), schemas.group_ddl(g)).alias(g) for g in schemas.RULE_GROUPS]
    plain = [F.col(name) for name, _ in schemas.SOURCE_FIELDS]
    defaults = {"enabled": True, "enabledExplore": True, "bookSourceType": 0, "customOrder": 0}
    plain = [
        F.coalesce(F.col(n), F.lit(defaults[n])).alias(n) if n in defaults else F.col(n)
        for n, _ in schemas.SOURCE_FIELDS
    ]
    named = (F.length(F.trim("bookSourceUrl")) > 0) & (F.length(F.trim("bookSourceName")) > 0)
    return rows.filter(named).select(*plain, *groups)


def parse_sources(texts: DataFrame, column: str) -> DataFrame:
    """Rule sets from JSON texts, each one object or an array of them.

    Rule groups may be objects or strings that hold one. Unknown fields are
    dropped, and so are rows without URL or name.
    """
    parsed = F.from_json(F.col(column), f"array<struct<{schemas.SOURCE_TEXT.replace('` ', '`: ')}>>")
    return _typed_sources(texts.select(F.explode(parsed).alias("s")).select("s.*"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Rule sets from JSON files; a file is one object or an array."""
    return _typed_sources(spark.read.schema(schemas.SOURCE_TEXT).option("multiLine", True).json(path))


def write_sources(catalog: DataFrame, path: str) -> None:
    """Export as JSON lines, nulls left out."""
    catalog.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def source_json(catalog: DataFrame) -> DataFrame:
    """Each rule set as JSON text, nulls left out."""
    return catalog.select("bookSourceUrl", F.to_json(F.struct("*")).alias("json"))


def parse_feeds(texts: DataFrame, column: str) -> DataFrame:
    """Feed sources from JSON texts, each one object or an array of them."""
    fields = schemas.ddl(schemas.FEED_FIELDS).replace("` ", "`: ")
    rows = texts.select(F.explode(F.from_json(F.col(column), f"array<struct<{fields}>>")).alias("s")).select("s.*")
    return rows.filter(F.length(F.trim("sourceUrl")) > 0).withColumns({
        "enabled": F.coalesce("enabled", F.lit(True)), "singleUrl": F.coalesce("singleUrl", F.lit(False)),
        "customOrder": F.coalesce("customOrder", F.lit(0)),
    })


def parse_replace_rules(texts: DataFrame, column: str) -> DataFrame:
    """Replace rules from JSON texts; ``sortOrder`` falls back to ``order``, the time-out to 3000 ms."""
    fields = schemas.ddl(schemas.REPLACE_RULE_FIELDS).replace("` ", "`: ")
    rows = texts.select(F.explode(F.from_json(F.col(column), f"array<struct<{fields}>>")).alias("r")).select("r.*")

    def or_default(name: str, value: object) -> Column:
        return F.coalesce(F.col(name), F.lit(value))

    return rows.select(
        or_default("id", 0).alias("id"), or_default("name", "").alias("name"), F.col("group"),
        or_default("pattern", "").alias("pattern"), or_default("replacement", "").alias("replacement"),
        "scope", or_default("scopeTitle", False).alias("scope_title"),
        or_default("scopeContent", True).alias("scope_content"), F.col("excludeScope").alias("exclude_scope"),
        or_default("isEnabled", True).alias("enabled"), or_default("isRegex", True).alias("is_regex"),
        F.coalesce(F.nullif("timeoutMillisecond", F.lit(0)), F.lit(3000)).cast("bigint").alias("timeout_ms"),
        F.coalesce("sortOrder", F.col("order"), F.lit(0)).alias("order"),
    )
