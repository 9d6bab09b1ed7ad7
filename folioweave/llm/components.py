"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.tables import scoped, scrambled, written


@scoped("components")
def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a long, b long); component is its smallest reachable id.

    Rounds of contraction: every node joins its least neighbour in a pseudo-random order, edges are renamed and those
    inside a group go, until none is left. The random order makes the rounds logarithmic for chains and two for stars.
    A node's neighbours are only ever reduced to a minimum (combined before the shuffle) or met in an equi-join that
    adaptive execution splits, so a node with very many edges is no hot task. Edges with a null or equal ends are ignored.
    """
    start = edges.where("a != b").select("a", "b").distinct()
    left = written(start.select(scrambled(F.col("a")).alias("x"), scrambled(F.col("b")).alias("y"), "a", "b"), "edges")
    nodes = left.select(F.col("a").alias("id"), F.col("x").alias("label")).union(left.select("b", "y")).distinct()
    labels = written(nodes, "labels")
    left = left.select("x", "y")
    while not left.isEmpty():
        met = left.union(left.select("y", "x"))
        least = met.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("node"), F.least("x", "low").alias("up"))
        least = written(least, "parents")
        ends = [least.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "xy"]
        moved = left.join(ends[0], "x").join(ends[1], "y").where("up_x != up_y")
        left = written(moved.select(F.least("up_x", "up_y").alias("x"), F.greatest("up_x", "up_y").alias("y")).distinct(), "edges")
        up = least.where("node != up").select(F.col("node").alias("label"), "up")
        labels = written(labels.join(up, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "labels")
    low = written(labels.groupBy("label").agg(F.min("id").alias("component")), "lowest")
    return labels.join(low, "label").select("id", "component")
