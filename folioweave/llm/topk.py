"""Exact top-k search by inner product: branch and bound over vertically laid out vectors.

Candidates are held dimension by dimension. A query adds up its products one block of dimensions at a time; after each, what
the remaining dimensions can add at most (by the Cauchy-Schwarz inequality, from the mass left in query and candidate) rules
candidates out, and those that survive are moved together before the next block. Queries travel in blocks of bounded size,
and every task reads its share of the candidates and returns its own best for each query of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.tables import in_blocks, scoped, shared_path, written

SCALE = 1024
#: Components of the queries of a block (of 8 bytes each), candidates laid out together, and dimensions added at a time.
BLOCK_COMPONENTS, CANDIDATES, DIMENSIONS = 1 << 20, 8192, 8
#: Survivors are moved together when at most this share of them is left.
COMPACT = 0.7

#: Sums of integers below this are exact in doubles.
_EXACT = float(1 << 53)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Best:
    """The k best (score, candidate id) of each query so far: larger scores first, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0, np.int64)] * queries
        self.ids = [np.empty(0, np.int64)] * queries

    def least(self, query: int) -> float:
        """The score that a further candidate must reach."""
        return float(self.scores[query][-1]) if len(self.scores[query]) == self.k else -np.inf

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        if len(scores) > 4 * self.k:
            enough = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[enough], ids[enough]
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[first], ids[first]


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in doubles: whole numbers, exact as long as x is."""
    return np.floor(scale * vectors)


def _long_scores(query: np.ndarray, layout: np.ndarray) -> np.ndarray:
    """Inner products of numbers of any size; what does not fit 64 bits becomes the nearest number that does."""
    exact = [sum(a * b for a, b in zip(map(int, query), map(int, column), strict=True)) for column in layout.T]
    return np.array([min(max(s, _LOW), _HIGH) for s in exact], np.int64)


class Layout:
    """Candidates, dimension by dimension in a given order, with the mass left behind each block of dimensions."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, order: np.ndarray):
        self.ids = ids
        self.columns = np.ascontiguousarray(vectors[:, order].T)
        self.largest = np.abs(self.columns).max(initial=0)
        self.cuts = list(range(0, len(order), DIMENSIONS))
        with np.errstate(over="ignore"):
            self.left = np.array([left_mass(self.columns[c:].T) for c in self.cuts[1:]])

    def search(self, query: np.ndarray, left: np.ndarray, own: int, row: int, best: Best) -> None:
        """Add the candidates that can still be among the best of ``query`` (in the same order of dimensions)."""
        alive = np.flatnonzero(self.ids != own)
        if not len(alive) or not len(query):
            best.add(row, np.zeros(len(alive), np.int64), self.ids[alive])
            return
        if self.largest * np.abs(query).max() * len(query) >= _EXACT:
            best.add(row, _long_scores(query, self.columns[:, alive]), self.ids[alive])
            return
        least, together = best.least(row), len(alive) == len(self.ids)
        so_far = np.zeros(len(alive))
        for i, cut in enumerate(self.cuts):
            block = slice(cut, cut + DIMENSIONS)
            so_far += query[block] @ (self.columns[block] if together else self.columns[block][:, alive])
            if i == len(self.cuts) - 1:
                break
            rest = self.left[i][alive] * left[i]
            if least == -np.inf and len(alive) >= best.k:  # as many candidates reach at least this
                least = np.partition(so_far - rest, len(alive) - best.k)[len(alive) - best.k]
            stay = so_far + rest >= least
            if stay.sum() <= COMPACT * len(alive):
                alive, so_far, together = alive[stay], so_far[stay], False
        reached = so_far >= least
        best.add(row, so_far[reached].astype(np.int64), self.ids[alive[reached]])


def left_mass(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms, rounded up: sums of up to millions of squares are off by less than the factor."""
    return np.sqrt(np.square(vectors).sum(axis=1)) * (1 + 1e-9) + 1e-3


class Queries:
    """A block of queries, by number of dimensions: dimensions in the order of the block's mass, which decides most."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: list[np.ndarray]):
        self.numbers, self.ids, self.by_size = numbers, ids, {}
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            own = np.stack([vectors[i] for i in rows])
            order = np.argsort(-np.square(own).sum(axis=0), kind="stable")
            own = own[:, order]
            left = np.array([left_mass(own[:, c:]) for c in range(DIMENSIONS, size, DIMENSIONS)]).reshape(-1, len(rows)).T
            self.by_size[int(size)] = rows, order, own, left

    def search(self, batches: Iterator[pa.RecordBatch], scale: int, k: int) -> Iterator[pa.RecordBatch]:
        best = Best(len(self.ids), k)
        for batch in batches:
            for first in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(first, CANDIDATES)
                lists = part.column("vector")
                sizes, ids = lists.value_lengths().to_numpy(), part.column("id").to_numpy()
                values, starts = whole(lists.flatten().to_numpy(), scale), np.concatenate([[0], np.cumsum(sizes)])
                for size, (rows, order, own, left) in self.by_size.items():
                    these = np.flatnonzero(sizes == size)
                    if len(these):
                        layout = Layout(values[starts[these][:, None] + np.arange(size)], ids[these], order)
                        for i, row in enumerate(rows):
                            layout.search(own[i], left[i], self.ids[row], row, best)
        found = np.array([len(s) for s in best.scores])
        if found.sum():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(self.numbers, found)), pa.array(np.repeat(self.ids, found)), pa.array(np.concatenate(best.ids)),
                 pa.array(np.concatenate(best.scores))], ["number", "query_id", "id", "score"])


def _usable(rows: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector")).where("id is not null").where(vector.isNotNull() & ~bad)


@scoped("top")
def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest inner product for each query row.

    ``rows`` are (vec_id long, embedding array); the rows where ``is_query`` holds (it may use vec_id) are the queries, and
    all rows of another vec_id their candidates. Components count as floor(scale * x). Scores are exact 64-bit integers,
    higher ones first, equal ones by ascending vec_id.

    * Null vectors, vectors with a null, NaN or infinite component and rows without a vec_id take no part.
    * Empty vectors have score 0 with each other. A query meets the vectors of its own length only.
    * Rows that repeat a vec_id are candidates each; repeated query rows are answered each, and never by rows of their own id.
    * A score beyond 64 bits becomes the nearest 64-bit number.
    * Other columns are ignored; an empty table, or one without queries, gives an empty result.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "embedding")
    # Every candidate is read once for each block of queries, so what all blocks have in common is done once.
    candidates = written(_usable(rows), "candidates")
    numbered = _usable(rows.where(is_query)).withColumn("number", F.monotonically_increasing_id())
    path = shared_path(spark, "found")
    shape = "number long, query_id long, id long, score long"
    for block in in_blocks(numbered, BLOCK_COMPONENTS, F.size("vector") + 1, "queries"):
        sent = block.toArrow()
        lists = sent.column("vector").combine_chunks()
        vectors = [whole(v.values.to_numpy(), scale) for v in lists]
        queries = spark.sparkContext.broadcast(Queries(sent.column("number").to_numpy(), sent.column("id").to_numpy(), vectors))
        found = candidates.mapInArrow(lambda batches, queries=queries: queries.value.search(batches, scale, k), shape)
        found.write.mode("append").parquet(path)
        queries.destroy()
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "id")
    ranked = spark.read.schema(shape).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
