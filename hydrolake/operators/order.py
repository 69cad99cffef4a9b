"""Exact order statistics of many groups, of which some may hold nearly all rows.

A double has a whole number with the same order (`order_key`). The k-th smallest value of a group is found
digit by digit from the top: rows that share the digits found so far are counted by their next digit, and sums
of these counts tell which digit the k-th row has. A task counts; none orders or keeps a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.operators.lineage import cut

#: Rows up to which a group's median is taken in one aggregation; bits of a digit; groups whose states are broadcast.
LARGE, DIGIT, BROADCAST_GROUPS = 65_536, 16, 100_000
#: Bins of a group's range, the least half range that has them, and the values a group, in the mean, up to which those of the middle bins are written down.
BINS, TINY, WRITTEN = 4096, 1e-290, 1_000_000


def _scaled(x: Column, power: Column) -> Column:
    """x times two to a power, exactly: by two steps, so that neither leaves the range of doubles."""
    half = (power / 2).cast("int")
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def order_key(x: Column) -> Column:
    """A long in the order of finite doubles: exponent and mantissa of the size, with the sign of the number."""
    size = F.abs(x)
    guess = F.floor(F.log2(F.when(size > 0, size))).cast("int")
    # The logarithm may be off by one at powers of two.
    low = F.when(_scaled(size, -guess) < 1, guess - 1).when(_scaled(size, -guess) >= 2, guess + 1).otherwise(guess)
    exponent = F.greatest(low, F.lit(-1022))
    mantissa = _scaled(size, 52 - exponent).cast("long")  # below 2 ** 52 for the numbers next to zero
    bits = F.when(size == 0, F.lit(0).cast("long")).otherwise((exponent + 1022).cast("long") * (1 << 52) + mantissa)
    return F.when(x < 0, -bits).otherwise(bits)


def key_value(key: Column) -> Column:
    """The double of an `order_key`."""
    bits = F.abs(key)
    # Normal numbers have their leading bit in the mantissa and so one more in the exponent.
    at = F.greatest(F.shiftright(bits, 52) - 1, F.lit(0)).cast("int")
    mantissa = (bits - at.cast("long") * (1 << 52)).cast("double")
    return F.when(key < 0, -1.0).otherwise(1.0) * _scaled(mantissa, at - 1074)


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"__{c}"]) for c in by], F.lit(True))


def select(df: DataFrame, by: list[str], key: str, wanted: DataFrame) -> DataFrame:
    """(by, which, key): of each group the key of the 0-based `rank` in rows `wanted` (by, which, rank). Groups may have null keys in `by`."""
    rows = df.select(*by, F.col(key).bitwiseXOR(F.lit(-(2**63))).alias("__u"))  # unsigned digits in the order of signed numbers
    state = wanted.select(*[F.col(c).alias(f"__{c}") for c in by], "which", "rank", F.lit(0).cast("long").alias("prefix"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        held = F.broadcast(state) if state.count() <= BROADCAST_GROUPS else state
        head = F.lit(0).cast("long") if shift == 64 - DIGIT else F.shiftrightunsigned("__u", shift + DIGIT)
        digit = F.shiftrightunsigned("__u", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        met = rows.join(held, _same(rows, state, by) & (head == state["prefix"]))
        names = [f"__{c}" for c in by]
        counts = met.groupBy(*names, "which", "rank", "prefix", digit.alias("digit")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy(*names, "which").orderBy("digit"))
        first = counts.withColumn("upto", upto).filter("upto > rank").groupBy(*names, "which", "prefix").agg(F.min(F.struct("digit", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))).alias("d"))
        grown = F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("d.digit"))
        state = cut(first.select(*names, "which", F.col("d.rank").alias("rank"), grown.alias("prefix")))
    return state.select(*[F.col(f"__{c}").alias(c) for c in by], "which", F.col("prefix").bitwiseXOR(F.lit(-(2**63))).alias("key"))


def _bin(v: Column, low: Column, high: Column) -> Column:
    """The number of v's bin, of `BINS` even ones between low and high; it never falls where v rises, whatever the rounding."""
    # Halves, as the width of a range may be beyond the largest double.
    width = high / 2 - low / 2
    place = F.try_divide(v / 2 - low / 2, width) * BINS
    return F.when(width >= TINY, F.least(F.floor(place), F.lit(BINS - 1)).cast("int")).otherwise(0)


def medians(df: DataFrame, by: list[str], value: str, large: int = LARGE) -> DataFrame:
    """(by, median) of the finite values of each group, exactly; the mean of the middle two of an even number.

    Groups of more than `large` values are counted in even bins between their smallest and largest value; the values of
    the bins that hold the middle two are searched digit by digit, and written down first where they are few. The
    other groups go through one aggregation.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL AND NOT isnan(__v) AND abs(__v) <> double('infinity')")
    sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")))
    big = sizes.filter(F.col("n") > large)
    n_big = big.count()
    if not n_big:
        return rows.groupBy(*by).agg(F.median("__v").alias("median"))
    names = big.select(*[F.col(c).alias(f"__{c}") for c in by], "__low", "__high")
    hold = lambda few: F.broadcast(few) if n_big <= BROADCAST_GROUPS else few
    keys = [f"__{c}" for c in by]
    told = rows.join(hold(names), _same(rows, names, by)).select(*by, "__v", _bin(F.col("__v"), F.col("__low"), F.col("__high")).alias("__bin"))
    counts = told.groupBy(*by, "__bin").agg(F.count("*").alias("__c")).withColumn("__upto", F.sum("__c").over(W.partitionBy(*by).orderBy("__bin")))
    total = F.sum("__c").over(W.partitionBy(*by))
    middle = F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("__n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(F.col("__n") / 2).alias("rank")))
    placed = counts.withColumn("__n", total).withColumn("w", F.explode(middle)).filter("w.rank >= __upto - __c AND w.rank < __upto")
    found = cut(placed.groupBy(*by).agg(F.min("__bin").alias("__first"), F.max("__bin").alias("__last"), F.min(F.col("__upto") - F.col("__c")).alias("__less"), F.max("__upto").alias("__upto"), F.first("__n").alias("__n")))
    # Between the two bins there is no value, so all that is in or between them is what their counts say.
    left = found.agg(F.sum(F.col("__upto") - F.col("__less"))).first()[0]
    bins = found.select(*[F.col(c).alias(f"__{c}") for c in by], "__first", "__last")
    inner = told.join(hold(bins), _same(told, bins, by) & F.col("__bin").between(F.col("__first"), F.col("__last"))).select(*by, "__v")
    if left <= WRITTEN * n_big:
        inner = cut(inner)
    wanted = found.select(*by, F.explode(middle).alias("w"), "__less").select(*by, "w.which", (F.col("w.rank") - F.col("__less")).alias("rank"))
    out = select(inner.select(*by, order_key(F.col("__v")).alias("key")), by, "key", wanted).withColumn("v", key_value(F.col("key")))
    both = out.groupBy(*by).agg((F.min("v") / 2 + F.max("v") / 2).alias("half"), F.min("v").alias("low"), F.max("v").alias("high"))
    mean = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("half"))
    medians_ = both.select(*by, mean.alias("median"))
    if sizes.filter(F.col("n") <= large).isEmpty():
        return medians_
    small = rows.join(hold(names), _same(rows, names, by), "left_anti")
    return small.groupBy(*by).agg(F.median("__v").alias("median")).unionByName(medians_)
