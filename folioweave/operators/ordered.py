"""Order within a key, without handing a whole key to one task.

``row_number``, ``lag`` and ``lead`` over a partition key put all rows of the
key into one task. The functions here cut each key into chunks of its order
column, work inside the chunks, and add what lies in earlier or later chunks
from a table that has one row per chunk. A key with a third of all rows is then
spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key in the given order.

    A filter on ``row_number() = 1`` is applied before the shuffle as well
    (``WindowGroupLimit``), so each task sends at most one row per key.
    """
    return first_rows(df, keys, 1, *order)


def first_rows(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows per key in the given order, limited before the shuffle too."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")


def _chunk_windows(keys: Sequence[str]) -> tuple:
    by_key = Window.partitionBy(*keys)
    in_order = by_key.orderBy(_CHUNK)
    return by_key, in_order


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    pos: Column,
    chunk: Column,
    out: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """Add a dense 0-based number by ``pos`` within ``keys``, and the key's row count.

    ``chunk`` must not decrease as ``pos`` grows, and should keep the rows of
    one (key, chunk) to what a task can sort.
    """
    chunked = df.withColumn(_CHUNK, chunk)
    by_key, in_order = _chunk_windows(keys)
    earlier = F.sum("__n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        chunked.groupBy(*keys, _CHUNK)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, _CHUNK, F.coalesce(earlier, F.lit(0)).alias("__before"), F.sum("__n").over(by_key).alias("__total"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys, _CHUNK).orderBy(pos)) - 1
    result = (
        chunked.withColumn("__inside", inside)
        .join(offsets, [*keys, _CHUNK])
        .withColumn(out, F.col("__inside") + F.col("__before"))
    )
    if total:
        result = result.withColumn(total, F.col("__total"))
    return result.drop(_CHUNK, "__inside", "__before", "__total")


def _beside(df, keys, pos, chunk, value, out, forward: bool) -> DataFrame:
    chunked = df.withColumn(_CHUNK, chunk).withColumn("__v", F.struct(value.alias("v")))
    _, in_order = _chunk_windows(keys)
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(pos)
    edge = F.min_by("__v", pos) if forward else F.max_by("__v", pos)
    move = F.lead if forward else F.lag
    edges = (
        chunked.groupBy(*keys, _CHUNK).agg(edge.alias("__edge"))
        .select(*keys, _CHUNK, move("__edge").over(in_order).alias("__edge"))
    )
    return (
        chunked.withColumn("__inside", move("__v").over(inner))
        .join(edges, [*keys, _CHUNK])
        .withColumn(out, F.coalesce("__inside", "__edge")["v"])
        .drop(_CHUNK, "__v", "__inside", "__edge")
    )


def with_next(df: DataFrame, keys: Sequence[str], pos: Column, chunk: Column, value: Column, out: str) -> DataFrame:
    """Add ``value`` of the following row of the key; null on the last one."""
    return _beside(df, keys, pos, chunk, value, out, True)


def with_previous(df: DataFrame, keys: Sequence[str], pos: Column, chunk: Column, value: Column, out: str) -> DataFrame:
    """Add ``value`` of the preceding row of the key; null on the first one."""
    return _beside(df, keys, pos, chunk, value, out, False)
