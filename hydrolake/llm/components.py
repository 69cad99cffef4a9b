"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.llm import common
from hydrolake.llm.common import settle as cut
from hydrolake.llm.common import spread_join


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct edges (u, v), u > v, has one v only and is no other's v."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("lowest"))
    return nodes.filter("up > 1 OR (up = 1 AND lowest = 0)").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u long, v long) to (node, component), the component being its smallest node.

    Each round links every node's larger neighbours and then its smaller ones to its smallest
    neighbour; when every component is a star, no further round is made. The edges of a
    round are written to the shared checkpoint folder. Only counts reach the
    driver, and no join is a broadcast, since its memory would go with the rounds. The star of a large component is a hot key, so joins are dealt by more than the key. Loops and repeated edges are ignored; no edges give no rows.
    """
    # Not settled, as what leads to the edges may be large and a settled table's shuffle files go later.
    now = common.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    # A round has no more edges than the one before, so this many tasks do for all.
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, now.count() >> 16)
    now = now.coalesce(tasks)
    while not _are_stars(now):
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        # An edge's larger end goes to the smallest neighbour of the smaller end, or stays where that is a smallest itself.
        large = spread_join(now.select(F.col("v").alias("u"), F.col("u").alias("w")), least, "u", "w", "left", merge=True).select(F.col("w").alias("u"), F.coalesce("m", "u").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", "v", merge=True).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(small.filter("u > v").distinct().coalesce(tasks))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
