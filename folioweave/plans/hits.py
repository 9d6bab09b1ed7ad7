"""Queries over search hits: merge, rank, match."""

from pyspark.sql import functions as F

from folioweave.operators import hits as op
from folioweave.operators.ordered import numbered
from folioweave.plans.registry import query
from folioweave.plans.tables import HITS_SQL, raw_hits, table

_MERGED_SQL = HITS_SQL + """,
merged AS (
  SELECT lower(trim(name)) AS kn, lower(trim(author)) AS ka, min(ord) AS ord,
         arg_min(name, ord) AS name, arg_min(author, ord) AS author, arg_min(kind, ord) AS kind,
         arg_min(book_url, ord) AS book_url,
         coalesce(arg_min(intro, ord) FILTER (intro <> ''), '') AS intro,
         coalesce(arg_min(cover_url, ord) FILTER (cover_url <> ''), '') AS cover_url,
         coalesce(arg_min(latest_chapter, ord) FILTER (latest_chapter <> ''), '') AS latest_chapter,
         count(DISTINCT origin) AS origin_count
  FROM hits GROUP BY 1, 2
), first_seen AS (
  SELECT lower(trim(name)) AS kn, lower(trim(author)) AS ka, origin, min(ord) AS o FROM hits GROUP BY 1, 2, 3
), origin_lists AS (
  SELECT kn, ka, string_agg(origin, ',' ORDER BY o) AS origins FROM first_seen GROUP BY 1, 2
), ranked AS (
  SELECT merged.*, origins, CASE WHEN kn = 'red bolt' THEN 0 WHEN contains(kn, 'red bolt') THEN 1 ELSE 2 END AS tier
  FROM merged JOIN origin_lists USING (kn, ka)
)"""
_MERGED_COLUMNS = ["name", "author", "kind", "book_url", "intro", "cover_url", "latest_chapter", "origins", "origin_count"]


def _flat(df):
    return df.withColumn("origins", F.array_join("origins", ","))


@query("merge_hits", f"WITH {_MERGED_SQL} SELECT {', '.join(_MERGED_COLUMNS)} FROM ranked")
def merge_hits(spark, folder):
    return _flat(op.merge_hits(raw_hits(spark, folder))).select(*_MERGED_COLUMNS)


@query("rank_hits", f"WITH {_MERGED_SQL} SELECT tier, name, author, origin_count, book_url FROM ranked ORDER BY tier, origin_count DESC, ord")
def rank_hits(spark, folder):
    ranked = op.rank_hits(op.merge_hits(raw_hits(spark, folder)), "Red Bolt")
    return ranked.select("tier", "name", "author", "origin_count", "book_url")


@query("top_k_hits", f"WITH {_MERGED_SQL} SELECT tier, name, author, origin_count, origins FROM ranked ORDER BY tier, origin_count DESC, ord LIMIT 100")
def top_k_hits(spark, folder):
    ranked = op.rank_hits(op.merge_hits(raw_hits(spark, folder)), "red bolt")
    return _flat(op.top_hits(ranked, 100)).select("tier", "name", "author", "origin_count", "origins")


_TIERED_SQL = HITS_SQL + """,
tiered AS (
  SELECT *, CASE
    WHEN lower(name) = 'blue gear' OR lower(author) = 'blue gear' THEN 3
    WHEN contains(lower(name), 'blue gear') OR contains(lower(author), 'blue gear') THEN 2
    WHEN contains(lower(name), 'blue') OR contains(lower(author), 'blue')
      OR contains(lower(name), 'gear') OR contains(lower(author), 'gear') THEN 1 ELSE 0 END AS tier
  FROM hits
), merged AS (
  SELECT lower(name) AS kn, lower(author) AS ka, max(tier) AS tier, count(*) AS hit_count, min(ord) AS first_ord
  FROM tiered {where} GROUP BY 1, 2
), rep AS (
  SELECT *, row_number() OVER (PARTITION BY lower(name), lower(author) ORDER BY tier DESC, ord) AS rn FROM tiered
)
SELECT m.tier, r.name, r.author, r.book_url, r.origin, m.hit_count
FROM merged m JOIN rep r ON m.kn = lower(r.name) AND m.ka = lower(r.author) AND r.rn = 1"""


def _tiered(spark, folder, precise):
    merged = op.merge_hits_tiered(raw_hits(spark, folder), "Blue Gear", precise)
    return merged, ["tier", "name", "author", "book_url", "origin", "hit_count"]


@query("merge_hits_tiered", "WITH " + _TIERED_SQL.replace("{where}", ""))
def merge_hits_tiered(spark, folder):
    merged, columns = _tiered(spark, folder, False)
    return merged.select(*columns)


@query("rank_hits_tiered", "WITH " + _TIERED_SQL.replace("{where}", "") + " ORDER BY m.tier DESC, m.hit_count DESC, first_ord")
def rank_hits_tiered(spark, folder):
    merged, columns = _tiered(spark, folder, False)
    return op.rank_hits_tiered(merged).select(*columns)


@query("precision_search", "WITH " + _TIERED_SQL.replace("{where}", "WHERE tier >= 2"))
def precision_search(spark, folder):
    merged, columns = _tiered(spark, folder, True)
    return merged.select(*columns)


@query("dedupe_first", f"""WITH {HITS_SQL}
SELECT origin, book_url, name, intro FROM hits
QUALIFY row_number() OVER (PARTITION BY origin, book_url ORDER BY ord) = 1""")
def dedupe_first(spark, folder):
    return op.dedupe_hits(raw_hits(spark, folder), "origin").select("origin", "book_url", "name", "intro")


@query("hit_filter", f"""WITH {HITS_SQL}
SELECT origin, book_url, name, author FROM hits
WHERE contains(name, 'bolt') AND author <> 'Brand#1'
QUALIFY row_number() OVER (PARTITION BY origin, book_url ORDER BY ord) = 1""")
def hit_filter(spark, folder):
    wanted = F.contains("name", F.lit("bolt")) & (F.col("author") != "Brand#1")
    hits = raw_hits(spark, folder).filter(wanted)
    return op.dedupe_hits(hits, "origin").select("origin", "book_url", "name", "author")


@query("precise_match", f"""WITH {HITS_SQL}, firsts AS (
  SELECT lower(trim(name)) AS kn, lower(trim(author)) AS ka, arg_min(name, ord) AS name, arg_min(author, ord) AS author,
         arg_min(origin, ord) AS origin, arg_min(book_url, ord) AS book_url FROM hits GROUP BY 1, 2
)
SELECT p_partkey AS request_id, f.name, f.author, f.origin, f.book_url
FROM part JOIN firsts f ON lower(trim(' ' || upper(p_name) || ' ')) = kn AND lower(p_brand) = ka""")
def precise_match(spark, folder):
    requests = table(spark, folder, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("name"), F.col("p_brand").alias("author"),
    )
    return op.precise_match(requests, raw_hits(spark, folder))


@query("alternative_sources", f"""WITH {HITS_SQL}, shelf AS (
  SELECT DISTINCT p_name AS name, CASE WHEN p_type = 'SMALL' THEN '' ELSE p_brand END AS author FROM part
)
SELECT s.name, s.author, h.origin, arg_min(h.book_url, h.ord) AS book_url
FROM shelf s JOIN hits h ON s.name = h.name AND (s.author = '' OR s.author = h.author)
GROUP BY 1, 2, 3""")
def alternative_sources(spark, folder):
    shelf = table(spark, folder, "part").select(
        F.col("p_name").alias("name"),
        F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_brand")).alias("author"),
    ).distinct()
    return op.alternative_sources(shelf, raw_hits(spark, folder))


@query("paginate_hits", f"""WITH {HITS_SQL}, paged AS (
  SELECT origin, book_url, l_linenumber AS page, l_orderkey, l_partkey, l_suppkey FROM hits
)
SELECT origin, book_url, page,
       row_number() OVER (ORDER BY page, l_orderkey, l_partkey, l_suppkey) - 1 AS position FROM paged""")
def paginate_hits(spark, folder):
    """Later result pages follow earlier ones; the running number needs no single-task sort."""
    hits = raw_hits(spark, folder).select("origin", "book_url", "ord.*")
    order = F.struct("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")
    span = F.struct(F.col("l_linenumber"), F.floor(F.col("l_orderkey") / 1_000_000))
    placed = numbered(hits.withColumn("all", F.lit(0)), ["all"], order, span, "position")
    return placed.select("origin", "book_url", F.col("l_linenumber").alias("page"), "position")


@query("project_hits", f"""WITH {HITS_SQL}
SELECT origin, name, author, book_url, CAST(json_extract_string('{{"token":"t' || l_suppkey || '"}}', '$.token') AS VARCHAR) AS token,
       book_url AS toc_url FROM hits""")
def project_hits(spark, folder):
    """Hit to book: shared columns, and the variables carried over as a blob and read back."""
    hits = raw_hits(spark, folder).withColumn(
        "variable", F.to_json(F.create_map(F.lit("token"), F.concat(F.lit("t"), F.col("ord.l_suppkey"))))
    )
    books = op.to_books(op.to_hits(op.to_books(hits)))
    return books.select("origin", "name", "author", "book_url", F.col("variables")["token"].alias("token"), "toc_url")


@query("union_sources", """
SELECT 'listing' AS stage, 's' || l_suppkey AS origin, count(*) AS hits FROM lineitem GROUP BY 2
UNION ALL SELECT 'catalog', 's' || s_suppkey, 1 FROM supplier WHERE s_acctbal >= 0""")
def union_sources(spark, folder):
    """Hits of both stages; a source that failed (a negative balance) contributes none."""
    from folioweave.operators.catalog import union_sources as union

    listing = table(spark, folder, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("origin")).agg(
        F.count(F.lit(1)).alias("hits")).select(F.lit("listing").alias("stage"), "origin", "hits")
    own = table(spark, folder, "supplier").filter("s_acctbal >= 0").select(
        F.lit("catalog").alias("stage"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("origin"),
        F.lit(1).cast("bigint").alias("hits"))
    return union([listing, own])
