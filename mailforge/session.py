"""Session helpers: local sessions, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mailforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; a temporary folder only on a local master (tests), on a cluster its absence is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mailforge-"))


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df marked for broadcast, if it has most rows at most; a larger one is an error, as it was meant to be small by contract."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table that is broadcast has more than {most} rows")
    return F.broadcast(df)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least: for small files of few row groups, before work that costs far more than moving the rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the files, which outlive any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(True)
