"""Search hits: merge the same item across sources, rank against a query, match.

Hits carry an ``ord`` column (any orderable type), their order of arrival.
Results depend on it alone, never on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.text import strip
from folioweave.operators.ordered import first_per_key

_LATER_FIELDS = ("intro", "cover_url", "latest_chapter")


def merge_key(value: Column) -> Column:
    return F.lower(strip(F.coalesce(value, F.lit(""))))


def _first_filled(field: str) -> Column:
    """(arrival, value) of the earliest row that has a value; a plain minimum, so it combines map-side."""
    return F.min(F.when(F.col(field) != "", F.struct("ord", field))).alias(field)


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per (name, author), blind to case and outer space.

    The first hit to arrive represents the item; its empty intro, cover and
    latest chapter are filled from the first hit that has one. ``origins`` are
    the distinct sources in order of arrival.

    Texts are reduced to one row per item before they are shuffled; only names,
    sources and arrival go through the distinct step, and the list per item is
    bounded by the number of sources. Hits are read twice for this, so write
    them first (``session.checkpointed`` or a table) where they are costly.
    """
    item = ["__name", "__author"]
    keyed = hits.withColumn("__name", merge_key(F.col("name"))).withColumn("__author", merge_key(F.col("author")))
    # Rows are sorted to be aggregated; a checksum first makes that a comparison of numbers.
    best = keyed.groupBy(F.xxhash64(*item).alias("__sum"), *item).agg(
        F.min(F.struct("ord", "name", "author", "kind", "book_url")).alias("rep"),
        *[_first_filled(f) for f in _LATER_FIELDS],
    )
    first_seen = keyed.groupBy(F.xxhash64(*item, "origin").alias("__sum"), *item, "origin").agg(F.min("ord").alias("ord"))
    # Where only the count is asked for, Spark drops the lists, and the step before is a plain distinct. ``sort_array`` compares
    # rows as such; the comparison of ``array_sort`` is an expression, run anew for every pair.
    origins = first_seen.groupBy(*item).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("ord", "origin"))).alias("seen"))
    return best.join(origins, item).select(
        F.col("rep.ord").alias("ord"),
        "rep.name", "rep.author", "rep.kind", "rep.book_url",
        *[F.coalesce(F.col(f)[f], F.lit("")).alias(f) for f in _LATER_FIELDS],
        F.transform("seen", lambda s: s["origin"]).alias("origins"),
        F.greatest(F.lit(1), "n").cast("bigint").alias("origin_count"),
    )


def name_tier(name: Column, query: str) -> Column:
    """0 the query itself, 1 contains it, 2 other. An empty query is contained in every name."""
    key, wanted = merge_key(name), query.strip().lower()
    return F.when(key == wanted, 0).when(F.contains(key, F.lit(wanted)), 1).otherwise(2)


def rank_hits(merged: DataFrame, query: str) -> DataFrame:
    """Merged hits with their tier, best first; ties by arrival."""
    return merged.withColumn("tier", name_tier(F.col("name"), query)).orderBy(
        "tier", F.desc("origin_count"), "ord"
    )


def match_tier(name: Column, author: Column, query: str) -> Column:
    """3 exact, 2 contains, 1 has any word of the query, 0 none; on name or author."""
    wanted = query.strip().lower()
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in (name, author)]

    def either(test) -> Column:
        return reduce(lambda a, b: a | b, [test(f) for f in fields])

    tier = F.when(either(lambda f: f == wanted), 3).when(either(lambda f: F.contains(f, F.lit(wanted))), 2)
    for word in wanted.split():
        tier = tier.when(either(lambda f, w=word: F.contains(f, F.lit(w))), 1)
    return tier.otherwise(0)


def merge_hits_tiered(hits: DataFrame, query: str, precise: bool = False) -> DataFrame:
    """One row per (name, author) as written but for case; rows are counted, not sources.

    The earliest hit of the highest tier represents the item. ``precise`` keeps
    only tiers 2 and 3. The minimum and the count both combine map-side.
    """
    tiered = hits.withColumn("tier", match_tier(F.col("name"), F.col("author"), query))
    if precise:
        tiered = tiered.filter(F.col("tier") >= 2)
    return (
        tiered.groupBy(
            F.lower(F.coalesce("name", F.lit(""))).alias("__name"),
            F.lower(F.coalesce("author", F.lit(""))).alias("__author"),
        )
        .agg(
            F.min(F.struct((-F.col("tier")).alias("t"), "ord", "name", "author", "book_url", "origin")).alias("rep"),
            F.min("ord").alias("first_ord"),
            F.count(F.lit(1)).alias("hit_count"),
        )
        .select(
            "first_ord", (-F.col("rep.t")).alias("tier"), "rep.name", "rep.author", "rep.book_url", "rep.origin",
            "hit_count",
        )
    )


def rank_hits_tiered(merged: DataFrame) -> DataFrame:
    return merged.orderBy(F.desc("tier"), F.desc("hit_count"), "first_ord")


def top_hits(ranked: DataFrame, n: int) -> DataFrame:
    """The best ``n``; after a sort Spark keeps ``n`` rows a task and never sorts the whole."""
    return ranked.limit(n)


def dedupe_hits(hits: DataFrame, *scope: str) -> DataFrame:
    """First row per book URL within a source (and request), in list order."""
    return first_per_key(hits, [*scope, "book_url"], F.col("ord"))


def _first_hits(hits: DataFrame, keys: list[Column], *fields: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.min(F.struct("ord", *fields)).alias("hit"))


def precise_match(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """The first hit whose name and author equal the request's, blind to case and outer space.

    Hits shrink to one row per item before the join, so the join never multiplies rows.
    """
    firsts = _first_hits(
        hits, [merge_key(F.col("name")).alias("__n"), merge_key(F.col("author")).alias("__a")],
        "name", "author", "origin", "book_url",
    )
    keyed = requests.withColumn("__n", merge_key(F.col("name"))).withColumn("__a", merge_key(F.col("author")))
    return keyed.join(firsts, ["__n", "__a"]).select(
        "request_id", "hit.name", "hit.author", "hit.origin", "hit.book_url"
    )


def alternative_sources(shelf: DataFrame, hits: DataFrame) -> DataFrame:
    """For each shelf book the first hit per source with its name, and its author where it has one."""
    # Hits whose name is on no shelf go before anything is aggregated.
    named = hits.join(shelf.select("name").distinct(), "name", "left_semi")
    by_author = _first_hits(named, [F.col("name"), F.col("author"), F.col("origin")], "book_url")
    by_name = by_author.groupBy("name", "origin").agg(F.min("hit").alias("hit"))
    with_author = shelf.filter(F.col("author") != "").join(by_author, ["name", "author"])
    without = shelf.filter(F.col("author") == "").join(by_name, ["name"])
    columns = ["name", "author", "origin", F.col("hit.book_url").alias("book_url")]
    return with_author.select(*columns).unionByName(without.select(*columns))


# Fields a hit and a book share.
SHARED_FIELDS = ["origin", "name", "author", "book_url"]


def to_books(hits: DataFrame, variables: str = "variable") -> DataFrame:
    """Hits as books: shared fields, the hit's variables read from their blob, the chapter list at the book's URL."""
    return hits.select(
        *SHARED_FIELDS, F.from_json(variables, "map<string,string>").alias("variables"), F.col("book_url").alias("toc_url")
    )


def to_hits(books: DataFrame) -> DataFrame:
    """Books as hits: shared fields, variables written to a blob."""
    return books.select(*SHARED_FIELDS, F.to_json("variables").alias("variable"))
