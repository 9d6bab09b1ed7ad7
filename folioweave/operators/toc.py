"""Chapter lists: order, index, neighbours, page chains, joined text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.operators.ordered import first_per_key, numbered, with_next
from folioweave.session import checkpointed


def build_toc(links: DataFrame, chunk: Column, reversed_list: bool = False) -> DataFrame:
    """Distinct chapter URLs per book with a dense index.

    Normally the last link to a URL stays, in page order. On a list that runs
    newest first (``reversed_list``) the first link stays and the order turns.
    ``links`` has ``book``, ``pos``, ``url``; ``chunk`` grows with ``pos``. The
    deduplicated links are written once, as numbering reads them twice and the
    shuffle of all links should not run again for that.
    """
    order = F.col("pos").asc() if reversed_list else F.col("pos").desc()
    kept = checkpointed(first_per_key(links, ["book", "url"], order))
    indexed = numbered(kept, ["book"], F.col("pos"), chunk, "idx", total="__count")
    if reversed_list:
        indexed = indexed.withColumn("idx", F.col("__count") - 1 - F.col("idx"))
    return indexed.drop("__count")


def reverse_toc(toc: DataFrame) -> DataFrame:
    """Turn a dense index round; the size of a book is one aggregate, joined back."""
    sizes = toc.groupBy("book").agg(F.max("idx").alias("__last"))
    return toc.join(sizes, "book").withColumn("idx", F.col("__last") - F.col("idx")).drop("__last")


def next_chapter(toc: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """Each chapter with the URL of the one after it."""
    return with_next(
        toc, ["book"], F.col("idx"), F.floor(F.col("idx") / chunk_rows), F.col("url"), "next_url"
    )


def toc_summary(toc: DataFrame) -> DataFrame:
    return toc.groupBy("book").agg(
        F.count(F.lit(1)).alias("chapter_count"), F.max_by("title", "idx").alias("latest_title")
    )


def chapter_slice(toc: DataFrame, start: int, end: int) -> DataFrame:
    """Chapters ``start`` up to ``end``, and how many follow the slice."""
    sizes = toc.groupBy("book").agg(F.count(F.lit(1)).alias("__n"))
    part = toc.filter((F.col("idx") >= start) & (F.col("idx") < end))
    return part.join(sizes, "book").withColumn("remaining", F.greatest(F.lit(0), F.col("__n") - end)).drop("__n")


def stitch_pages(pages: DataFrame, keys: Sequence[str], pages_per_part: int = 4096) -> DataFrame:
    """Non-empty page texts joined by newline in page order.

    A text of more than ``pages_per_part`` pages comes in numbered parts, each
    within what one row may hold; joined by newline the parts are the text.
    """
    return (
        pages.filter(F.coalesce(F.col("text"), F.lit("")) != "")
        .withColumn("part", F.floor(F.col("page_no") / pages_per_part).cast("bigint"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("__pages"))
        .withColumn("text", F.array_join(F.transform("__pages", lambda p: p["text"]), "\n"))
        .drop("__pages")
    )


def follow_links(starts: DataFrame, links: DataFrame) -> DataFrame:
    """All pages reached from each start by following single next links, with their depth.

    ``starts`` has ``start``; ``links`` has ``url`` (unique), ``next_url`` and, where a link counts for several pages, ``length``.
    Following stops at a page without a link and at a page visited before. Each
    round doubles the distance a join covers, so a chain of n pages takes
    log2(n) rounds; every round is checkpointed, and a page is kept once per
    start at its least depth, which ends cycles.
    """
    reached = checkpointed(starts.select("start", F.col("start").alias("url"), F.lit(0).cast("bigint").alias("depth")))
    length = F.col("length") if "length" in links.columns else F.lit(1)
    jump = checkpointed(links.filter(F.col("next_url") != "").select("url", "next_url", length.cast("bigint").alias("length")))
    known = reached.count()
    while True:
        step = reached.join(jump, "url").select(
            "start", F.col("next_url").alias("url"), (F.col("depth") + F.col("length")).alias("depth")
        )
        reached = checkpointed(
            reached.unionByName(step).groupBy("start", "url").agg(F.min("depth").alias("depth"))
        )
        now = reached.count()
        if now == known:
            return reached
        known = now
        further = jump.select(F.col("url").alias("next_url"), F.col("next_url").alias("far"), F.col("length").alias("more"))
        jump = checkpointed(jump.join(further, "next_url").select("url", F.col("far").alias("next_url"), (F.col("length") + F.col("more")).alias("length")))


def page_chains(chapters: DataFrame, links: DataFrame) -> DataFrame:
    """Pages of each chapter, in order: its own page and what its next links lead to.

    ``chapters`` has ``url`` and ``next_url``, the next chapter's page; a chain
    ends where it would enter that page.

    Links that enter a chapter's first page are taken out before anything is followed, so what is built first is each
    chapter's own stretch, one row a page. Only a chapter that goes on into another one that is not its next is followed
    further, over whole stretches.
    """
    heads = checkpointed(chapters.select(F.col("url").alias("start"), F.col("next_url").alias("stop")).distinct())
    first_pages = heads.select(F.col("start").alias("next_url")).distinct()
    stretches = follow_links(heads.select("start").distinct(), links.join(first_pages, "next_url", "left_anti"))
    exits = stretches.join(links.join(first_pages, "next_url", "left_semi").select("url", "next_url"), "url")
    exits = checkpointed(exits.select(F.col("start").alias("url"), "next_url", (F.col("depth") + 1).alias("length")))
    going_on = exits.join(heads, (exits["url"] == heads["start"]) & ~exits["next_url"].eqNullSafe(heads["stop"]), "left_semi")
    onwards = checkpointed(going_on.select(F.col("url").alias("start")).distinct())
    reached = stretches
    if not onwards.isEmpty():
        entered = follow_links(onwards, exits).where("depth > 0").select("start", F.col("url").alias("head"), F.col("depth").alias("before"))
        more = entered.join(stretches.withColumnRenamed("start", "head"), "head").select("start", "url", (F.col("before") + F.col("depth")).alias("depth"))
        reached = checkpointed(stretches.unionByName(more).groupBy("start", "url").agg(F.min("depth").alias("depth")))
    joined = reached.join(heads.withColumnRenamed("stop", "__stop"), "start")
    cut = joined.filter(F.col("url") == F.col("__stop")).select("start", "__stop", F.col("depth").alias("__cut"))
    cut = joined.select("start", "url", "depth", "__stop").join(cut, ["start", "__stop"], "left")
    return cut.filter(F.col("__cut").isNull() | (F.col("depth") < F.col("__cut"))).select("start", "url", "depth")


def fan_out_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Bodies of the pages a chapter names all at once, by link position.

    ``links``: ``start``, ``link_ord``, ``url``, ``next_url`` (next chapter).
    The chapter's own page and the next chapter's page are left out.
    """
    wanted = links.filter(
        (F.col("url") != F.col("start")) & (F.col("next_url").isNull() | (F.col("url") != F.col("next_url")))
    )
    first = wanted.groupBy("start", "url").agg(F.min("link_ord").alias("link_ord"))
    return first.join(pages, "url").select("start", "link_ord", "url", "text")


def access_flags(toc: DataFrame) -> DataFrame:
    """``locked``: for paying readers and not yet paid; ``divider``: a volume heading."""
    return toc.withColumn("locked", F.col("is_vip") & ~F.col("is_pay")).withColumn("divider", F.col("is_volume"))


def chapter_errors(toc: DataFrame) -> DataFrame:
    """An error code for chapters whose URL leads nowhere; null for good ones."""
    url = F.coalesce(F.col("url"), F.lit(""))
    bad = (url == "") | (url == F.col("book_url")) | (url == F.col("toc_url"))
    return toc.withColumn("error", F.when(bad & ~F.col("is_volume"), F.lit("invalid_url")))


def retitle(toc: DataFrame, hook: Column) -> DataFrame:
    """Set each title to ``hook`` (a column over idx and title) unless that is empty."""
    return toc.withColumn("title", F.coalesce(F.nullif(F.trim(hook.cast("string")), F.lit("")), F.col("title")))
