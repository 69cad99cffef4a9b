"""Monthly cells kept up to date from a stream of raw rows.

A cell is a sum of its parts (counts, sum, least, greatest), so each batch adds the cells of its own
rows and readers add them up. A batch writes to a folder of its own and overwrites it if it is run
again, so a retried batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hydrolake.functions import dims
from hydrolake.operators import measurements as M


def merge(parts: DataFrame) -> DataFrame:
    """Partial cells to cells."""
    return parts.groupBy(*M.KEY).agg(F.sum("n").alias("n"), F.sum("sum_value").alias("sum_value"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n_below_loq").alias("n_below_loq"), F.sum("n_lower_reliability").alias("n_lower_reliability"))


def follow(raw: DataFrame, path: str, checkpoint: str, min_year: int = dims.MIN_YEAR, once: bool = False) -> StreamingQuery:
    """Start adding the cells of a raw stream to the folder `path`; `once` ends when all present rows are in."""

    def add(batch: DataFrame, number: int) -> None:
        M.monthly_cells(M.kept(batch, min_year)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all batches."""
    return merge(spark.read.parquet(path).drop("batch"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the cells of all batches as one store, for readers of many batches."""
    read(spark, path).repartitionByRange("country", "site_id").write.mode("overwrite").partitionBy("country").parquet(target)
