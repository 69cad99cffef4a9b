"""Compare the members of index buckets pairwise, in cells of bounded size.

A bucket holds the rows of one index key. Buckets of one row are dropped before anything is
gathered. A bucket of n rows is dealt into ceil(n / chunk) chunks by a hash, and every pair of
chunks is a cell: a task holds two chunks at most, whatever the size of the bucket, and no pair
of rows is ever a row of a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk.
CHUNK = 1024


def cells(index: DataFrame, chunk: int = CHUNK, useful: Column | None = None) -> DataFrame:
    """`index` (key long, fp long, more) to cells (key, i, j, members array of (side, fp, more)).

    Chunks i <= j meet in cell (i, j); `side` is 0 for members of chunk i, 1 for those of chunk j
    (in a cell (i, i) all have side 0). `useful`: a condition on an aggregate of the bucket beside
    its row count, for buckets that need not be compared.
    """
    more = [c for c in index.columns if c != "key"]
    sizes = index.groupBy("key").agg(F.count("*").alias("n"), *([F.max(useful).alias("useful")] if useful is not None else []))
    sizes = sizes.filter("n > 1" + (" AND useful" if useful is not None else "")).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    c = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("chunks")).cast("int")
    dealt = index.join(sizes, "key").withColumn("c", c).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    i, j = F.least("c", "other"), F.greatest("c", "other")
    return dealt.select("key", i.alias("i"), j.alias("j"), F.struct((F.col("c") > F.col("other")).cast("int").alias("side"), *more).alias("m")).groupBy("key", "i", "j").agg(F.collect_list("m").alias("members"))
