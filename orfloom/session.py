"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "orfloom", memory: str = "16g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in a local session without it.

    On a cluster every executor would write to a disk of its own, so a missing setting is an error there.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-orfloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables a job writes and reads back."""
    return f"{checkpoint_root(spark).rstrip('/')}/orfloom-{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, drop_shuffles: bool = False, compression: str | None = None) -> DataFrame:
    """The rows as a written table in the shared folder, so a lost executor does not lose them.

    Unlike a checkpoint this computes the rows once, and readers prune columns and know the table's size. With
    ``drop_shuffles`` Spark removes the shuffle files of the write when it ends, not when the driver's memory is next collected.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "stage")
    before = spark.conf.get(CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if drop_shuffles:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
