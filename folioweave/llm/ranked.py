"""Ranked lexical search by best-first document intervals over posting lists with range-maximum sparse tables.

A shard of documents has a posting list of impacts for each term, in document order, and a sparse table that gives the largest
impact of any stretch of a list at once. An interval of documents can score no more than the sum of its terms' largest impacts.
The interval with the highest bound is taken first and split at the document that has its single largest impact: that document
is scored, and the two sides get bounds of their own. Intervals whose bound the k-th best score already exceeds are done.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.divergence import pieces
from folioweave.llm.tables import in_blocks, scoped, shared_path, written

#: Bytes of the distinct terms of the items that are ranked in one pass over the documents.
BLOCK_BYTES = 4 << 20
#: Postings and documents of a shard, and (interval, term) cells that are split at once and held at most for all.
POSTINGS, DOCUMENTS, CELLS, HELD_CELLS = 1 << 20, 1 << 14, 1 << 13, 1 << 24
SLICE = 1 << 20

_TERM, _BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
_JAVA_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _forward(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, terms, tfs) of each document: all its terms counted, the looked-for ones listed."""
    for batch in batches:
        sizes, terms, tfs, ends = [], [], [], [0]
        for text in batch.column("text").cast(pa.large_binary()):
            times: Counter = Counter()
            if text.is_valid:
                for piece in pieces(text.as_py().lower(), SLICE, _BREAK):  # of bytes, lower() maps A-Z only
                    times.update(_TERM.findall(piece))
            own = sorted((numbers[t], times[t]) for t in times.keys() & numbers.keys())
            terms.extend(t for t, _ in own)
            tfs.extend(n for _, n in own)
            sizes.append(times.total())
            ends.append(len(terms))
        lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind)) for values, kind in ((terms, pa.int32()), (tfs, pa.int64())))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])


class Top:
    """The k best (score, document id) so far; higher scores first, equal ones by ascending id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            better = scores >= self.scores[-1]
            scores, ids = scores[better], ids[better]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]

    def open(self, bounds: np.ndarray, first_ids: np.ndarray) -> np.ndarray:
        """Which intervals, by bound and least id, may still hold one of the best."""
        if len(self.scores) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (first_ids < self.ids[-1]) & (bounds > 0))


class Shard:
    """Posting lists of some documents with their sparse tables."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        doc = np.repeat(place, sizes)
        self.width = np.int64(len(ids) + 1)
        keys = terms * self.width + doc
        by_term = np.argsort(keys)
        self.keys, self.docs = keys[by_term], doc[by_term]
        tfs, norm = tfs[by_term], np.repeat(norms, sizes)[by_term]
        self.impacts = weights[terms[by_term]] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * norm))
        self.tables = [np.arange(len(keys), dtype=np.int32)]
        longest = int(np.bincount(terms).max(initial=0))
        while 2 ** len(self.tables) <= longest:
            half, last = 2 ** (len(self.tables) - 1), self.tables[-1]
            ahead = np.concatenate([last[half:], last[-half:]])  # what would reach over the end is never asked for
            self.tables.append(np.where(self.impacts[last] >= self.impacts[ahead], last, ahead))
        self.tables = np.stack(self.tables)

    def largest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, impact) of the largest impact of stretches [low, high) of posting lists; an empty one has impact 0."""
        full = high > low
        low, high = np.where(full, low, 0), np.where(full, high, 1)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        one, other = self.tables[level, low], self.tables[level, high - (1 << level)]
        place = np.where(self.impacts[one] >= self.impacts[other], one, other)
        return place, np.where(full, self.impacts[place], 0)

    def search(self, terms: np.ndarray, top: Top) -> None:
        """Add to ``top`` the documents that are among the best for an item with these terms."""
        low, high = np.searchsorted(self.keys, terms * self.width), np.searchsorted(self.keys, (terms + 1) * self.width)
        terms, low, high = terms[high > low], low[high > low], high[high > low]
        if not len(terms):
            return
        n, starts = max(1, CELLS // len(terms)), terms * self.width
        open_ = self._bounded(low[None], high[None], np.zeros(1, np.int64))
        while True:
            low, high, first, bound, split = open_
            stay = top.open(bound, self.ids[first])
            if not stay.any():
                return
            low, high, first, bound, split = (x[stay] for x in open_)
            taken = np.argpartition(-bound, n)[:n] if len(bound) > n else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[taken] = False
            doc = self.docs[split[taken]]
            at = np.searchsorted(self.keys, starts + doc[:, None])
            inside = at < high[taken]
            has = inside & (self.docs[np.where(inside, at, 0)] == doc[:, None])
            top.add(np.where(has, self.impacts[np.where(has, at, 0)], 0).sum(axis=1), self.ids[doc])
            sides = (np.concatenate([low[taken], at + has]), np.concatenate([at, high[taken]]), np.concatenate([first[taken], doc + 1]))
            some = (sides[1] > sides[0]).any(axis=1)
            new = self._bounded(*(x[some] for x in sides))
            open_ = tuple(np.concatenate([x[rest], y]) for x, y in zip((low, high, first, bound, split), new, strict=True))

    def _bounded(self, low: np.ndarray, high: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        place, impact = self.largest(low, high)
        split = place[np.arange(len(low)), impact.argmax(axis=1)] if len(low) else np.empty(0, np.int32)
        return low, high, first, impact.sum(axis=1), split


def _shards(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[pa.Table]:
    """Rows put together to at most ``docs`` documents and about POSTINGS postings."""
    held: list[pa.RecordBatch] = []
    count = postings = 0
    for batch in batches:
        first = 0
        ends = np.concatenate([[0], np.cumsum(batch.column("terms").value_lengths().to_numpy())])
        while first < batch.num_rows:
            by_postings = int(np.searchsorted(ends, ends[first] + POSTINGS - postings, "right")) - 1
            last = max(first + 1, min(batch.num_rows, first + docs - count, by_postings)) if not count else min(batch.num_rows, first + docs - count, by_postings)
            if last > first:
                held.append(batch.slice(first, last - first))
                count, postings, first = count + last - first, postings + ends[last] - ends[first], last
            if first < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, count, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _ranked(batches: Iterator[pa.RecordBatch], items: pa.Array, terms: list[np.ndarray], weights: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    best = [Top(k) for _ in terms]
    most = max(1, min(DOCUMENTS, HELD_CELLS // max([1, *map(len, terms)])))
    for rows in _shards(batches, most):
        lists = rows.column("terms").combine_chunks()
        numbers = lists.flatten().to_numpy().astype(np.int64)
        shard = Shard(rows.column("doc_id").to_numpy(), rows.column("norm").to_numpy(), lists.value_lengths().to_numpy(), numbers,
                      rows.column("tfs").combine_chunks().flatten().to_numpy(), weights)
        for own, top in zip(terms, best, strict=True):
            shard.search(own, top)
    found = np.array([len(top.ids) for top in best], np.int64)
    if found.sum():
        yield pa.RecordBatch.from_arrays(
            [items.take(pa.array(np.repeat(np.arange(len(items)), found))), pa.array(np.concatenate([t.ids for t in best])),
             pa.array(np.concatenate([t.scores for t in best]))], ["item_id", "doc_id", "score"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) of the items with any term: each term once, whatever rows it comes from."""
    found = F.regexp_extract_all(F.translate("text", *_LOWER), F.lit(_JAVA_TERM), F.lit(0))
    each = items.where("item_id is not null").select("item_id", F.explode(found).alias("term")).distinct()
    return each.groupBy("item_id").agg(F.collect_list("term").alias("terms"))


def _norm(n_docs: int, length: int) -> Column:
    """100 - 50 + ((50 * n * N) div L), with room for the product."""
    product = F.lit(50).cast("decimal(3,0)") * F.col("n").cast("decimal(15,0)") * F.lit(n_docs).cast("decimal(19,0)")
    return F.call_function("div", product, F.lit(length).cast("decimal(19,0)")).cast("long") + 50


@scoped("ranked")
def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of ``items`` (item_id, text) the ``k`` best of ``docs`` (doc_id long, text).

    Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased. N documents have a term, L is the number of all
    terms, n that of a document, df the number of documents with a term. A document scores, for each distinct term of the item,
    w * ((10^9 * tf) div (1000 * tf + 20 * m)) with w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 50 + ((50 * n * N) div L).
    Only scores above 0 count; equal ones go by ascending doc_id.

    * Null and empty texts have no terms; documents without terms are in no statistic, items without terms have no result.
    * Rows without a doc_id count in the statistics but are not returned; items without an id are left out.
    * Every row of ``docs`` is a document, repeated ones too; rows that repeat an item_id are one item with the terms of all.
    * Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    looked_for = item_terms(items.select("item_id", F.col("text").cast("string").alias("text")))
    path = shared_path(spark, "found")
    shape = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id long, score long"
    spark.createDataFrame([], shape).write.parquet(path)
    weight = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8)
    for block in in_blocks(looked_for, BLOCK_BYTES, weight, "item-terms"):
        rows = block.toArrow()
        lists = rows.column("terms").combine_chunks()
        words = sorted(set(lists.flatten().to_pylist()))
        numbers = {word.encode(): i for i, word in enumerate(words)}
        terms = [np.array(sorted(numbers[t.encode()] for t in own), np.int64) for own in lists.to_pylist()]
        sent = spark.sparkContext.broadcast(numbers)
        forward = docs.mapInArrow(lambda batches, sent=sent: _forward(batches, sent.value), "doc_id long, n long, terms array<int>, tfs array<long>")
        forward = written(forward.where("n > 0"), "forward")
        sent.destroy()
        n_docs, length = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        held = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weighed = held.select("term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w")).toArrow()
        weights = np.zeros(len(words), np.int64)
        weights[weighed.column("term").to_numpy()] = weighed.column("w").to_numpy()
        sent = spark.sparkContext.broadcast((rows.column("item_id").combine_chunks(), terms, weights))
        listed = forward.where("doc_id is not null and size(terms) > 0").select("doc_id", _norm(n_docs, length).alias("norm"), "terms", "tfs")
        found = listed.mapInArrow(lambda batches, sent=sent: _ranked(batches, *sent.value, k), shape)
        found.write.mode("append").parquet(path)
        sent.destroy()
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = spark.read.schema(shape).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
