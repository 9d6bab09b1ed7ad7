"""Source divergence audit: run-length encoded columns of term counts, compared pair by pair.

The vocabulary of a language is put in an order that brings terms with equal counts together: by their counts in the largest
sources first. Each source's column of counts in that order is run-length encoded, block by block. Two columns are compared by
intersecting their run boundaries: inside a piece both are constant, so its share of the sum is one difference times its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.tables import scoped, small_side, written
from folioweave.operators.ordered import numbered

#: Terms of a block of the vocabulary, and sources of a language that are compared in one task, on average.
BLOCK, TILE = 8192, 32
#: Sources whose counts order the vocabulary.
LEADING = 8
#: Distinct terms by source that a task holds before it sends their counts, and bytes of a text that are cut at once.
HELD, SLICE = 200_000, 1 << 20

_TERM, _BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def pieces(text: bytes, size: int, breaks: re.Pattern) -> Iterator[bytes]:
    """``text`` in pieces of ``size`` bytes or somewhat more that end before a byte that ``breaks`` matches."""
    at = 0
    while at < len(text):
        found = breaks.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms by (lang, source): one row for each term, and one with an empty term for each group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms = [b"", *times]
            columns = [
                pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)),
                pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *times.values()], pa.int64()),
                pa.array([0, *(docs[t] for t in times)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in pieces(text.as_py().lower(), SLICE, _BREAK):  # of bytes, lower() maps A-Z only
                words = _TERM.findall(piece)
                times.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(times) + 1 for times, _ in held.values()) > HELD:
            yield from sent()
    yield from sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; every group has a row with an empty term."""
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = text.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: str, terms: str, smoothing: int) -> Column:
    """1 + floor(10^9 * (n + smoothing) / (total + smoothing * terms)), exactly; null where there is no term."""
    wide = lambda c: c.cast("decimal(19,0)")
    n = F.col(n) if isinstance(n, str) else n
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * wide(n + smoothing)
    below = F.nullif(wide(F.col(total) + smoothing * F.col(terms)), F.lit(0).cast("decimal(19,0)"))
    return F.call_function("div", above, below).cast("long") + 1


def vocabulary(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, pos, terms): the kept terms with their places, and the number of them in the language."""
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("size").desc(), "source"))
    leading = sizes.withColumn("lead", rank).where(F.col("lead") <= LEADING).select("lang", "source", "lead")
    led = counts.where("term != ''").join(small_side(written(leading, "leading"), 64), ["lang", "source"], "left")
    key = F.array(*(F.sum(F.when(F.col("lead") == i, F.col("n")).otherwise(0)) for i in range(1, LEADING + 1)))
    kept = led.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), key.alias("key")).where(F.col("docs") >= least_docs)
    # Parts are ranges of the order, cut by a sample of it, so that a large language is numbered in many tasks.
    kept = kept.repartitionByRange("lang", "key", "term").withColumn("part", F.spark_partition_id())
    kept = written(kept.select("lang", "term", "total", "part", F.struct("key", "term").alias("key")), "kept-terms")
    return numbered(kept, ["lang"], F.col("key"), F.col("part"), "pos", "terms").select("lang", "term", "total", "pos", "terms")


def run_lengths(places: np.ndarray, values: np.ndarray, length: int, zero: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, value) of the runs of a column of ``length`` that has ``values`` at ``places`` and ``zero`` elsewhere."""
    column = np.full(length, zero, np.int64)
    column[places] = values
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    return starts, column[starts]


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = batch.drop_columns(["entries", "length", "zero"])
        starts, values = [], []
        for entries, length, zero in zip(*(batch.column(c) for c in ("entries", "length", "zero")), strict=True):
            cells = entries.values if entries.is_valid else pa.array([], batch.column("entries").type.value_type)
            start, value = run_lengths(cells.field("at").to_numpy(), cells.field("p").to_numpy(), length.as_py(), zero.as_py())
            starts.append(start)
            values.append(value)
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, batch.column("length"), pa.array(starts, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))],
            [*rest.schema.names, "length", "starts", "values"])


def difference(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """Sum of absolute differences of two run-length encoded columns."""
    cuts = np.concatenate([one[0], other[0]])
    cuts.sort()
    apart = np.abs(one[1][np.searchsorted(one[0], cuts, "right") - 1] - other[1][np.searchsorted(other[0], cuts, "right") - 1])
    return int(apart @ np.diff(cuts, append=length))


def _compared(table: pa.Table) -> pa.Table:
    """Differences of all pairs of a tile, or of the sources of two tiles, inside one block."""
    rows = [(r["tile"], r["source"], (np.array(r["starts"]), np.array(r["values"]))) for r in table.sort_by("source").to_pylist()]
    length, t, u = (table.column(c)[0].as_py() for c in ("length", "t", "u"))
    ones, others = ([r for r in rows if r[0] == tile] for tile in (t, u))
    out = [(a, b, difference(x, y, length)) for i, (_, a, x) in enumerate(ones) for _, b, y in (others[i + 1:] if t == u else others)]
    lang = pa.repeat(table.column("lang")[0], len(out))
    a, b, value = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"lang": lang, "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def pair_sums(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every pair of sources of a language, once.

    ``entries`` are (lang, source, pos, p) of the terms with a count, ``groups`` (lang, source, terms, zero, tiles) of all
    groups. A row of a block is copied to as many tasks as its language has tiles.
    """
    block = F.floor(F.col("pos") / BLOCK)
    cells = entries.groupBy("lang", "source", block.alias("block")).agg(
        F.collect_list(F.struct((F.col("pos") - block * BLOCK).alias("at"), "p")).alias("entries"))
    last = F.floor((F.greatest(F.col("terms"), F.lit(1)) - 1) / BLOCK)
    columns = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    length = F.least(F.col("terms") - F.col("block") * BLOCK, F.lit(BLOCK)).alias("length")
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).alias("tile")
    full = columns.join(cells, ["lang", "source", "block"], "left").select("lang", "source", "block", tile, "tiles", length, F.coalesce("zero", F.lit(0)).alias("zero"), "entries")
    shape = "lang string, source string, block long, tile long, tiles long, length long, starts array<long>, values array<long>"
    runs = written(full.where("length > 0").mapInArrow(_encoded, shape), "runs")
    beside = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("beside")
    met = runs.select("*", beside).withColumns({"t": F.least("tile", "beside"), "u": F.greatest("tile", "beside")}).drop("beside", "tiles")
    found = met.groupBy("lang", "block", "t", "u").applyInArrow(_compared, "lang string, a string, b string, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    ways = F.explode(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba"))))
    return pairs.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")


@scoped("divergence")
def audit_sources(docs: DataFrame, least_docs: int = 30, smoothing: int = 5, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far apart the sources of a language are, and by which terms.

    Terms are runs of letters and non-ASCII characters of ``text``, A-Z lower-cased. A language keeps the terms of at least
    ``least_docs`` of its documents. p of a kept term is 1 + floor(10^9 * (count + smoothing) / (N + smoothing * V)) in its
    group (lang, source), q the same in the whole language. Part ``pair`` has every other source of the language with the sum
    of absolute differences of p over all kept terms, in full; part ``term`` the ``top`` terms with a count whose p exceeds q,
    by p - q. Ranks go by value descending, then item.

    * Null text, lang and source count as empty; a group without any term takes part with counts of 0.
    * Every row is a document, repeated ones too. Other columns are ignored; an empty table gives an empty result.
    * A language without kept terms has pairs of value 0 and no terms; a single source has no pairs.
    """
    counts = written(term_counts(docs), "term-counts")
    terms = written(vocabulary(counts, least_docs), "vocabulary")
    entries = written(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "pos", "n", "total"), "entries")
    in_lang = terms.groupBy("lang").agg(F.first("terms").alias("terms"), F.sum("total").alias("lang_size"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(in_lang, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "terms", "lang_size"))), "groups")
    shares = entries.join(small_side(groups, 96), ["lang", "source"]).withColumns(
        {"p": share("n", "size", "terms", smoothing), "q": share("total", "lang_size", "terms", smoothing)})

    sources = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    shaped = groups.join(sources, "lang").select("lang", "source", "terms", "tiles", share(F.lit(0), "size", "terms", smoothing).alias("zero"))
    sums = pair_sums(shares.select("lang", "source", "pos", "p"), shaped)
    # Where a language keeps no term there are no blocks: its pairs stand for themselves.
    bare = shaped.where("terms = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = _both_ways(sums).union(bare.select("lang", "source", "item", "value")).withColumn("rank", F.row_number().over(order))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(above.withColumn("part", F.lit("term")).select(columns))
