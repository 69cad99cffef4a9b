"""Sharding by extendible hashing, with DataFrame operations only.

Every row has a 60-bit hash of its key. The directory is indexed by the hash's leading bits: a shard
is a prefix whose rows fit the byte limit while those of the prefix one bit shorter don't, so only
oversized buckets split. Bytes are summed once for each cell of a grid of prefixes somewhat finer
than the limit needs; the sums of shorter prefixes follow from the cells. Where cells are still
oversized their rows are summed again on a finer grid. Rows whose keys share all 60 bits can't be
told apart by bits: they are dealt into blocks of some `BLOCK` limits, and each block is cut into
shards by its running bytes, so no task gets all rows of a hot key.

Cases: a null key is a key of its own; a null or empty text has no bytes and still belongs to a
shard; a row over the limit has a shard to itself among rows of its hash, the one shard over the
limit; repeated rows share a bucket and are cut by bytes; equal byte counts need no tie rule, since
prefixes are disjoint; other columns are kept, but for those named like a result, which it replaces; an empty
table has no shards.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.llm.common import cut, spread_join

#: Bits of the hash, bits by which the grid is finer than an even split, and the default limit.
BITS, FINER, MAX_BYTES = 60, 4, 1 << 20
#: Limits of bytes that one block of rows of a hash has on average.
BLOCK = 32
RESULT = ("shard", "depth", "shard_bytes", "shard_rows")


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; the text of null is empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    bits = F.lit(BITS) - depth
    return F.call_function("shiftright", h, bits.cast("int"))


def directory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Rows (h, bytes) to cells (grid, cell, depth, shard_bytes, shard_rows): the prefix of `depth` bits is the shard of a cell.

    The cells of a grid have equally many bits; cells that no prefix of up to 60 bits makes small
    enough have depth 60.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    grid, out = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / max_bytes))) + FINER), []
    start, left = 0, rows
    while True:
        cells = left.groupBy(_prefix(F.col("h"), grid).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        deep = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(start), F.lit(grid))).alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(grid) - F.col("depth")).cast("int")))
        sums = deep.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = F.col("shard_bytes") <= max_bytes if grid < BITS else (F.col("shard_bytes") <= max_bytes) | (F.col("depth") == BITS)
        # All cells lie below the first nodes, so a node's cells are dealt to several tasks.
        node = F.struct("depth", "prefix").alias("node")
        met = spread_join(deep.select("cell", node), sums.filter(fits).select(node, "shard_bytes", "shard_rows"), "node", "cell")
        first = met.select("cell", "node.depth", "shard_bytes", "shard_rows").groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("s"))
        out.append(first.select(F.lit(grid).alias("grid"), "cell", "s.*"))
        # Only the rows of cells that are still oversized go on to a finer grid.
        large = cells.filter(F.col("bytes") > max_bytes)
        n = large.count() if grid < BITS else 0
        if not n:
            break
        start, most = grid + 1, large.agg(F.max("bytes")).first()[0]
        left = left.join(large.select(F.col("cell").alias("c")), _prefix(F.col("h"), grid) == F.col("c"), "left_semi")
        grid = min(BITS, grid + math.ceil(math.log2(most / max_bytes)) + FINER)
    return reduce(DataFrame.unionByName, out)


def assign(df: DataFrame, key: Column, size: Column, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`df` with shard (its prefix bits as text, and numbers behind points where rows of one hash were cut), depth, shard_bytes and shard_rows."""
    kept = [c for c in df.columns if c not in RESULT]
    known = df.select(*kept, key_hash(key).alias("__h"), F.coalesce(size, F.lit(0)).cast("long").alias("__bytes"))
    cells = cut(directory(cut(known.select(F.col("__h").alias("h"), F.col("__bytes").alias("bytes"))), max_bytes))
    grids = sorted(r[0] for r in cells.select("grid").distinct().collect())
    placed = None
    for g in grids:
        own = cells.filter(F.col("grid") == g).select(F.col("cell").alias("__cell"), *[F.col(c).alias(f"__{c}") for c in RESULT[1:]])
        part = known.withColumn("__cell", _prefix(F.col("__h"), g)).withColumn("__deal", F.xxhash64("__h", "__bytes"))
        part = spread_join(part, own, "__cell", "__deal").drop("__cell", "__deal")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        return df.select(*kept, F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"))
    bits = F.lpad(F.conv(_prefix(F.col("__h"), F.col("__depth")).cast("string"), 10, 2), F.col("__depth"), "0")
    placed = placed.withColumn("__shard", F.when(F.col("__depth") == 0, F.lit("")).otherwise(bits))
    large = F.col("__shard_bytes") > max_bytes
    if not cells.filter(F.col("shard_bytes") > max_bytes).isEmpty():
        # Rows are numbered where they lie; the numbers are written down, so that a lost executor can't change them.
        over = cut(placed.filter(large).withColumn("__row", F.monotonically_increasing_id()))
        over = over.withColumn("__block", F.pmod(F.xxhash64("__row"), F.ceil(F.col("__shard_bytes") / (BLOCK * max_bytes))))
        # A piece has the rows that lie wholly between two multiples of the limit; a row across one is a piece of its own.
        same = W.partitionBy("__h", "__block").orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
        over = over.withColumn("__last", F.sum("__bytes").over(same))
        over = over.withColumn("__piece", F.floor((F.col("__last") - F.col("__bytes")) / max_bytes)).withColumn("__spill", (F.floor((F.col("__last") - 1) / max_bytes) > F.col("__piece")).cast("int"))
        over = over.withColumn("__shard", F.concat_ws(".", "__shard", *[F.col(c).cast("string") for c in ("__block", "__piece", "__spill")]))
        own = W.partitionBy("__h", "__shard")
        over = over.withColumn("__shard_bytes", F.sum("__bytes").over(own)).withColumn("__shard_rows", F.count("*").over(own))
        placed = placed.filter(~large).unionByName(over.select(*placed.columns))
    return placed.select(*kept, *[F.col(f"__{c}").alias(c) for c in RESULT])


def text_bytes(column: str) -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def oracle(table: str, key: str, text: str, max_bytes: int = MAX_BYTES, depths: int = 24) -> str:
    """DuckDB SQL for (key, shard, depth, shard_bytes, shard_rows) where `depths` bits suffice and no key is cut."""
    return f"""
    WITH d AS (SELECT {key} AS k, coalesce(strlen({text}), 0) AS b, ('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM {table}),
    e AS (SELECT g.depth, h >> ({BITS} - g.depth)::BIGINT AS p, sum(b)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM d, (SELECT unnest(range(0, {depths + 1})) AS depth) g GROUP BY ALL),
    f AS (SELECT k, h, min(depth) AS depth FROM d, e WHERE d.h >> ({BITS} - e.depth)::BIGINT = e.p AND e.shard_bytes <= {max_bytes} GROUP BY k, h)
    SELECT k AS {key}, CASE WHEN f.depth = 0 THEN '' ELSE right(lpad(bin(h), {BITS}, '0')[1:f.depth::INT], f.depth::INT) END AS shard, f.depth::INT AS depth, e.shard_bytes, e.shard_rows
    FROM f JOIN e ON e.depth = f.depth AND e.p = f.h >> ({BITS} - f.depth)::BIGINT"""
