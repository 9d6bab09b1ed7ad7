"""Session settings and lineage cutting shared by all jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Runtime settings the jobs need, whoever made the session. Pages are large rows, so batches to Python are small.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(master: str | None = None, name: str = "folioweave", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` overrides by key.

    The shuffle partition count is left to adaptive execution: a generous
    initial number is coalesced at run time, so the same job fits a laptop and
    a cluster without a change in code.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session that was made elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: that of ``spark.checkpoint.dir``, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder, or one in the warehouse where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there.

    Iterative jobs call this once a round: the plan stays short and a lost
    executor re-reads the files instead of replaying every earlier round.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
