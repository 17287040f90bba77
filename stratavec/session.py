"""Session helpers: builder for local runs, scratch storage, input parallelism."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench.  A cluster brings its own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def _shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one disk, may fall
    back to the temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    # local-cluster has executors of its own, so it counts as a cluster
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.gettempdir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never used path below the shared folder."""
    return f"{_shared_folder(spark)}/stratavec-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows written once below the shared folder, for plans that read them several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so values fixed by partition ids survive lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a file scan that has fewer splits than the session has cores.

    A single-row-group file is one split and would run on one core.  A large
    input has more splits than cores and is left alone, so it is never shuffled.
    Call it on a bare scan: counting its partitions then runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
