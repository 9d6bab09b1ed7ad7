"""Tables cut out of a job's lineage, and joins against small sides."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import ensure_checkpoint_dir, removed

#: Bytes that a hinted broadcast may have; larger sides are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

#: The tables made in each open scope, outermost first. Jobs of one driver thread nest.
_scopes: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there.

    The rows are made once, the plan behind them ends here, and a lost executor re-reads the files.
    """
    path = shared_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def scoped(name: str) -> Callable:
    """A job whose result (a table, or a tuple of them) is written under ``name`` and whose other written tables are then deleted.

    A result that is itself a table the job has written stays as it is. Shuffle files go with the plans that made them, once
    the driver's collector has run; it is asked to at the end of each job, so that jobs one after the other do not pile up disk.
    """

    def around(job: Callable) -> Callable:
        @functools.wraps(job)
        def run(*args, **kwargs):
            spark = SparkSession.active()
            made: list[str] = []
            _scopes.append(made)
            kept: list[DataFrame] = []
            try:
                out = job(*args, **kwargs)
                for df in out if isinstance(out, tuple) else (out,):
                    kept.append(df if getattr(df, "written_to", None) in made else written(df, name))
            finally:
                _scopes.pop()
                results = [df.written_to for df in kept]
                removed(spark, [path for path in made if path not in results])
                out = None
                spark.sparkContext._jvm.System.gc()
            if _scopes:
                _scopes[-1].extend(results)
            return tuple(kept) if len(kept) > 1 else kept[0]

        return run

    return around


def in_blocks(df: DataFrame, most: int, weight: Column, name: str) -> Iterator[DataFrame]:
    """The rows of ``df`` in blocks of about ``most`` of the summed ``weight`` of a row (one row may weigh more)."""
    rows = written(df.withColumn("_weight", weight), name)
    total = rows.agg(F.sum("_weight")).first()[0] or 0
    n = max(1, -(-int(total) // most))
    dealt = written(rows.drop("_weight").repartition(n).withColumn("_block", F.spark_partition_id()), f"{name}-blocks")
    for block in range(n):
        yield dealt.where(F.col("_block") == block).drop("_block")


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, with a broadcast hint while its rows stay within BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def scrambled(id_: Column, salt: int = 0) -> Column:
    """A bijection of 64-bit numbers in a pseudo-random order: every step of xxHash64 over one long can be undone."""
    return F.xxhash64(id_.cast("long").bitwiseXOR(F.lit(salt).cast("long")))
