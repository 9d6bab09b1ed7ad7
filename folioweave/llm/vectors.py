"""Near-duplicate embeddings by an exact metric range join.

Pivots part the vectors of a label into cells; the triangle inequality says which cells a vector must be copied to so that
every vector meets all its partners in its own cell; cells are then joined independently, in blocks. A task hands on a
count for each vector and a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.components import connected_components
from folioweave.llm.tables import written

#: Vectors to a pivot, while there are no more pivots than PIVOTS; the pivots are broadcast.
CELL_ROWS = 2_000
PIVOTS = 4_096
#: Rows of one side of a block of a cell's join.
BLOCK_ROWS = 2_048
#: Room for rounding in the pruning bounds, which only ever keeps more copies.
_SLACK = 1e-6


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of equally long lists, in double precision."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.empty((0, 1))
    raw = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _placed(batches: Iterator[pa.RecordBatch], pivots: dict, reach: float) -> Iterator[pa.RecordBatch]:
    """A row for each cell a vector goes to: its own first (core), then those whose vectors may be within reach.

    If y lies in cell j and within reach of x, then d(x, j) <= reach + d(y, j) <= reach + d(y, own) <= 2 reach + d(x, own).
    In Euclidean space, x must also lie within reach of the plane halfway between both pivots.
    """
    for batch in batches:
        keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist()))
        rows, cells, core = [], [], []
        for key in set(keys):
            mine = np.array([i for i, k in enumerate(keys) if k == key])
            centres = pivots.get(key)
            if centres is None:
                rows.append(mine)
                cells.append(np.zeros(len(mine), np.int64))
                core.append(np.ones(len(mine), bool))
                continue
            units = _units(batch.column("embedding").take(pa.array(mine)))
            square = np.maximum(0, 2 - 2 * units @ centres.T)
            own = square.argmin(axis=1)
            between = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[own]
            least = square[np.arange(len(mine)), own][:, None]
            near = np.sqrt(square) <= np.sqrt(least) + 2 * reach + _SLACK
            near &= square - least <= 2 * reach * between + _SLACK
            near[np.arange(len(mine)), own] = True
            row, cell = np.nonzero(near)
            rows.append(mine[row])
            cells.append(cell)
            core.append(own[row] == cell)
        if not rows:
            continue
        table = pa.Table.from_batches([batch]).take(pa.array(np.concatenate(rows)))
        table = table.append_column("cell", pa.array(np.concatenate(cells).astype(np.int32)))
        yield from table.append_column("core", pa.array(np.concatenate(core))).to_batches()


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (member, root) that connect what the matrix of links (left x right) connects."""
    a, b = [], []
    open_left, open_right = linked.any(axis=1), np.ones(len(right), bool)
    for start in np.flatnonzero(open_left):
        if not open_left[start]:
            continue
        open_left[start] = False
        front, group = np.array([start]), [left[[start]]]
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & open_right)
            open_right[new] = False
            rest = np.flatnonzero(open_left)
            front = rest[linked[np.ix_(rest, new)].any(axis=1)] if len(new) else rest[:0]
            open_left[front] = False
            group += [right[new], left[front]]
        members = np.unique(np.concatenate(group))
        a += members[1:].tolist()
        b += [members[0]] * (len(members) - 1)
    return a, b


def _joined(table: pa.Table, threshold: float) -> pa.Table:
    """Counts of the core vectors of one block against the members of another, and forest edges among them."""
    is_core = table.column("side").to_numpy(zero_copy_only=False) == 0
    ids, keys = table.column("id").to_numpy(), table.column("k1").to_numpy()
    units = _units(table.column("embedding"))
    weight = table.column("copies").to_numpy()
    left, right = np.flatnonzero(is_core), np.flatnonzero(~is_core)
    linked = units[left] @ units[right].T >= threshold
    count = linked @ weight[right].astype(np.float64)
    a, b = _spanning(linked & (keys[left][:, None] != keys[right][None, :]), ids[left], ids[right])
    n = len(left)
    return pa.table({
        "node": pa.array(np.concatenate([keys[left], np.array(a, np.int64)])),
        "links": pa.array(np.concatenate([count.astype(np.int64), np.zeros(len(a), np.int64)])),
        "other": pa.array(np.array([0] * n + b, np.int64), mask=np.arange(n + len(b)) < n),
    })


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors`` (vec_id long, embedding array, label).

    Vectors with equal labels are linked at a cosine of ``threshold`` or more, in double precision. n_links counts the
    other rows linked directly, component_id is the smallest vec_id reachable, kept says that it is the row's own.

    * Null, empty and zero vectors, vectors with null or non-finite components, and those without a label or vec_id
      link with nothing; a null vec_id has a null component_id and kept true. Vectors of different lengths are not linked.
    * Rows with equal label and vector are one class with a count, however many they are. Rows that repeat a vec_id are
      rows of their own in n_links and one node of the graph.
    * Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    vector = F.col("embedding")
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(vector), F.lit(False))
    keys = [F.when(usable, F.xxhash64(F.lit(s), "label", vector)).alias(k) for s, k in ((1, "k1"), (2, "k2"))]
    rows = all_rows.select("vec_id", *keys)
    known = all_rows.where(usable).select("vec_id", "label", "embedding", *(k for k in keys))
    classes = written(known.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    first = known.join(classes, ["k1", "k2"]).where("vec_id = id").dropDuplicates(["k1", "k2"])
    reps = written(first.select("id", "copies", "label", F.size("embedding").alias("size"), vector.cast("array<double>").alias("embedding"), "k1"), "vectors")
    total = reps.count()
    target = max(CELL_ROWS, -(-total // PIVOTS))
    parts = written(reps.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > target), "large-labels")
    drawn = reps.where(F.pmod(F.xxhash64("k1"), F.lit(target)) == 0).join(parts, ["label", "size"]).select("label", "size", "embedding").toArrow()
    pivots: dict = {}
    if len(drawn):
        where = pd.Series(zip(drawn.column("label").to_pylist(), drawn.column("size").to_pylist()))
        for key, places in where.groupby(where).groups.items():
            pivots[key] = np.unique(_units(drawn.column("embedding").take(pa.array(places))), axis=0)
    sent = spark.sparkContext.broadcast(pivots)
    schema = "id long, copies long, label string, size int, embedding array<double>, k1 long, cell int, core boolean"
    placed = reps.mapInArrow(lambda batches: _placed(batches, sent.value, reach), schema)
    placed = written(placed, "placed")
    cell = ["label", "size", "cell"]
    blocks = placed.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("core").cast("int")) / BLOCK_ROWS).cast("int").alias("m"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("n"))
    blocks = written(blocks.where("m > 0"), "blocks")
    dealt = placed.join(blocks, cell)
    mine = lambda n: F.pmod(F.xxhash64("k1"), F.col(n)).cast("int")
    cores = dealt.where("core").select(*cell, "id", "k1", "copies", "embedding", F.lit(0).alias("side"), mine("m").alias("i"),
                                       F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    members = dealt.select(*cell, "id", "k1", "copies", "embedding", F.lit(1).alias("side"),
                           F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), mine("n").alias("j"))
    groups = cores.unionByName(members).groupBy(*cell, "i", "j")
    found = written(groups.applyInArrow(lambda t: _joined(t, threshold), "node long, links long, other long"), "joined")
    links = found.where("other is null").groupBy(F.col("node").alias("k1")).agg((F.sum("links") - 1).alias("n_links"))
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    # Rows that repeat a vec_id with several vectors join their classes.
    twice = known.groupBy("vec_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("vec_id")
    stars = known.select("vec_id", "k1", "k2").join(twice, "vec_id").join(classes, ["k1", "k2"]).select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    component = written(connected_components(edges.union(stars)), "components")
    links = written(links, "counts")
    info = classes.join(links, "k1").join(component, "id", "left")
    info = written(info.select("k1", "k2", "n_links", F.coalesce("component", "id").alias("component_id")), "class-results")
    out = rows.join(info, ["k1", "k2"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(component_id == F.col("vec_id"), F.lit(True))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), kept.alias("kept"))
