"""Cutting the lineage of iterative jobs, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without the setting, as in tests, gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer scan splits than cores over all cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """`cut` for tables that are joined round after round: the planner goes on with the size that was written.

    After a plain `cut` it goes on with its estimate, which for a join is the product of both sides. Rounds of such
    products are numbers of ever more digits, and those of twenty rounds fill the driver.
    """
    shared_dir(df.sparkSession)
    held = df.persist(StorageLevel.DISK_ONLY)
    held.count()
    out = held.select("*").checkpoint(eager=True)
    held.unpersist()
    return out


def table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back, so that later scans take only the columns they need."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
