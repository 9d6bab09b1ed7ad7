"""Source health and stage metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def source_health(outcomes: DataFrame, stages: int = 5) -> DataFrame:
    """Per source: passed when no stage failed; errors joined, first 200 characters, or OK.

    ``outcomes`` has ``source``, ``stage``, ``stage_no``, ``error`` (null when
    the stage passed) and ``ts``. Each stage counts with its latest run, so the
    list per source holds at most ``stages`` entries.
    """
    last = outcomes.groupBy("source", "stage_no", "stage").agg(F.max(F.struct("ts", "error")).alias("run"))
    return (
        last.groupBy("source")
        .agg(
            F.max("run.ts").alias("tested_at"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("run.error").isNotNull(),
                        F.struct("stage_no", F.concat("stage", F.lit(": "), "run.error").alias("message")),
                    )
                )
            ).alias("errors"),
        )
        .select(
            "source", "tested_at", (F.size("errors") == 0).alias("passed"),
            F.when(F.size("errors") == 0, F.lit("OK"))
            .otherwise(F.substring(F.array_join(F.transform("errors", lambda e: e["message"]), "; "), 1, 200))
            .alias("message"),
        )
    )


def catalog_health(catalog: DataFrame, health: DataFrame) -> DataFrame:
    """Mark each source ✓, ✗ or ? (never tested)."""
    return catalog.join(health, "source", "left").withColumn(
        "mark", F.when(F.col("passed"), "✓").when(~F.col("passed"), "✗").otherwise("?")
    )


def stage_metrics(records: DataFrame) -> DataFrame:
    """Rows, characters, first and last record per stage."""
    return records.groupBy("stage").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.length("body")).alias("body_chars"),
        F.min_by("name", "ord").alias("first_name"),
        F.max_by("name", "ord").alias("last_name"),
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row and character counts gathered while the job itself runs, at no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.length("body")).alias("chars")), seen
