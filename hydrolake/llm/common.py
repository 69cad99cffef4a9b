"""Helpers shared by the text operators: reading, lineage cuts, Arrow row mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch hands to a Python worker; long texts make larger batches heavy.
ARROW_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, through Spark's own readers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent a local session (tests) gets a temporary folder; a cluster
    without the setting is an error, since executors would not see the driver's files.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """`cut` for tables that are joined round after round: the planner goes on with the size that was written, not with products of estimates."""
    shared_dir(df.sparkSession)
    held = df.persist(StorageLevel.DISK_ONLY)
    held.count()
    out = held.select("*").checkpoint(eager=True)
    held.unpersist()
    return out


def tidy(spark: SparkSession) -> None:
    """From now on the shuffle files of a job go when it ends, and not when the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer scan splits than cores over all cores, so that small inputs run in parallel too."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", parts: int = 8, merge: bool = False) -> DataFrame:
    """Join on `key`, where `right` has a row for each key at most and `left` may have very many of one.

    Rows of `left` are dealt into `parts` by a hash of `by`, and `right` stands in each of them, so no task gets all of a hot key.
    `merge`: by sorting, even where `right` turns out small, so that the driver builds no table to broadcast; for joins that are made round after round.
    """
    dealt = left.withColumn("__part", F.pmod(F.xxhash64(F.lit(11), by), F.lit(parts)).cast("int"))
    copies = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies.hint("merge") if merge else copies, [key, "__part"], how).drop("__part")


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[dict]]], schema: pa.Schema | str, rows: int = 200) -> DataFrame:
    """Map blocks of at most `rows` input rows through a Python function over Arrow.

    `make` runs once per task and returns the block function, so that tables and caches are
    built once and not per block.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    if isinstance(schema, str):
        spark_schema = _parse_datatype_string(schema)
        assert isinstance(spark_schema, StructType)
        schema = to_arrow_schema(spark_schema)
    else:
        spark_schema = from_arrow_schema(schema)
    out_schema = schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if out := block(batch.slice(at, rows).to_pylist()):
                    yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    return df.mapInArrow(run, spark_schema)
