"""Correctly rounded sums of doubles by built-in aggregates.

A double is an integer times a power of two. Laid on a grid of limbs of `LIMB` bits it fills four
neighbouring limbs at most, so a group's values are added as four whole-number sums for each place on the
grid where one of them begins. A group has some such places, whatever its size; their sums are joined
limb by limb, carried, and rounded once, half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a limb. Sums of four trillion values keep within a long; more raise an error instead of a wrong sum.
LIMB = 20
_BASE = 1 << LIMB


def _pow2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def _with_pieces(df: DataFrame, x: Column) -> DataFrame:
    """Add `__at`, the place of a finite double on the grid (null for none), and its limbs `__s0` to `__s3` from there, lowest first.

    Each step is a column of its own, so none is worked out twice.
    """
    # The logarithm can be off by one at powers of two; one spare bit makes up for it.
    place = F.floor((F.floor(F.log2(F.abs("__x"))) - 53) / LIMB).cast("int")
    out = df.withColumn("__x", x).withColumn("__at", F.when(F.col("__x") != 0, place).when(F.col("__x") == 0, 0))
    shift = F.col("__at") * -LIMB
    half = (shift / 2).cast("int")
    out = out.withColumn("__rest", F.abs("__x") * _pow2(half) * _pow2(shift - half))  # both steps are exact; the result is a whole number
    sign = F.signum("__x")
    for k in (3, 2, 1):
        out = out.withColumn("__top", F.floor(F.col("__rest") / float(_BASE**k)))
        out = out.withColumns({f"__s{k}": (sign * F.col("__top")).cast("long"), "__rest": F.col("__rest") - F.col("__top") * float(_BASE**k)})
    return out.withColumn("__s0", (sign * F.col("__rest")).cast("long")).drop("__x", "__rest", "__top")


def _carried(limbs: str) -> Column:
    """The digits of an array of (k, s) from its least k on, and what is carried out four places above its greatest."""

    def carry(state: Column, k: Column) -> Column:
        own = F.aggregate(F.filter(limbs, lambda e: e["k"] == k), F.lit(0).cast("long"), lambda a, e: a + e["s"])
        return F.transform(F.array(state["c"] + own), lambda v: F.struct(F.shiftright(v, LIMB).alias("c"), F.concat(state["d"], F.array(v.bitwiseAND(F.lit(_BASE - 1)))).alias("d")))[0]

    order = F.sequence(F.array_min(F.transform(limbs, lambda e: e["k"])), F.array_max(F.transform(limbs, lambda e: e["k"])) + 4)
    return F.aggregate(order, F.struct(F.lit(0).cast("long").alias("c"), F.array().cast("array<bigint>").alias("d")), carry)


def _with_total(df: DataFrame, name: str) -> DataFrame:
    """Turn `__limbs`, an array of (k, s) that stands for the sum of s times 2 ** (LIMB k), into the nearest double."""
    out = df.withColumn("__c", F.when(F.size("__limbs") > 0, _carried("__limbs")))
    # What is left over at the top is 0, or -1 for a negative sum; that one is carried anew with all signs turned.
    turned = F.transform("__limbs", lambda e: F.struct(e["k"].alias("k"), (-e["s"]).alias("s")))
    out = out.withColumn("__minus", F.col("__c.c") < 0).withColumn("__limbs", F.when(F.col("__minus"), turned).otherwise(F.col("__limbs")))
    out = out.withColumn("__d", F.when(F.col("__minus"), _carried("__limbs")["d"]).otherwise(F.col("__c.d")))
    # Four digits of zero stand below, so that five can be taken from the top.
    out = out.withColumns({"__d": F.concat(F.array(*[F.lit(0).cast("long")] * 4), "__d"), "__low": F.array_min(F.transform("__limbs", lambda e: e["k"])) - 4})
    out = out.withColumn("__top", F.array_max(F.transform("__d", lambda d, i: F.when(d != 0, i).otherwise(0))))
    digit = lambda k: F.get("__d", F.col("__top") - k)
    out = out.withColumns({
        "__hi": digit(0) * _BASE + digit(1), "__lo": digit(2) * _BASE**2 + digit(3) * _BASE + digit(4), "__place": (F.col("__low") + F.col("__top") - 4) * LIMB,
        "__below": F.exists(F.slice("__d", 1, F.greatest(F.col("__top") - 4, F.lit(0))), lambda d: d != 0),
    })
    out = out.withColumn("__drop", F.greatest(F.length(F.bin("__hi")) + 3 * LIMB - 53, F.lit(-1074) - F.col("__place")))
    right = lambda x, n: F.call_function("shiftright", x, n)
    left = lambda x, n: F.call_function("shiftleft", x, n)
    drop = F.least("__drop", F.lit(62))
    # Digits below the least power of two of a double are zeros, so where more than the lower three go nothing is rounded.
    near = F.col("__drop") < 3 * LIMB
    kept = F.when(near, left(F.col("__hi"), 3 * LIMB - drop) + right(F.col("__lo"), drop)).otherwise(right(F.col("__hi"), F.least(F.col("__drop") - 3 * LIMB, F.lit(62))))
    out = out.withColumns({"__kept": kept, "__rest": F.col("__lo") - left(right(F.col("__lo"), drop), drop), "__half": left(F.lit(1).cast("long"), F.greatest(drop - 1, F.lit(0)))})
    up = near & ((F.col("__rest") > F.col("__half")) | ((F.col("__rest") == F.col("__half")) & (F.col("__below") | (F.col("__kept") % 2 == 1))))
    out = out.withColumns({"__kept": (F.col("__kept") + up.cast("long")).cast("double"), "__place": F.col("__place") + F.col("__drop")})
    first = (F.col("__place") / 2).cast("int")
    value = F.when(F.col("__top") < 4, F.lit(0.0)).otherwise(F.col("__kept") * _pow2(first) * _pow2(F.col("__place") - first))
    return out.withColumn(name, F.when(F.size("__limbs") > 0, F.when(F.col("__minus"), -value).otherwise(value)))


def exact_sum(df: DataFrame, by: list[str], value: str, name: str = "exact_sum", **more: tuple) -> DataFrame:
    """Correctly rounded sums of a column of doubles, null without values, the same in any order.

    `more` are aggregates that may be made of their own partial results: (first, again) pairs, such as
    (F.min("x"), F.min). Infinite values and NaN make the sum what adding them makes of it.
    """
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = _with_pieces(df.withColumn("__odd", F.when(~finite, x)), F.when(finite, x))
    sums = [F.sum(f"__s{k}").alias(f"__s{k}") for k in range(4)]
    first = rows.groupBy(*by, "__at").agg(*sums, F.sum("__odd").alias("__odd"), *[c[0].alias(k) for k, c in more.items()])
    own = F.array(*[F.struct((F.col("__at") + k).alias("k"), F.col(f"__s{k}").alias("s")) for k in range(4)])
    spots = F.collect_list(F.when(F.col("__at").isNotNull(), own))  # one entry a place on the grid, some hundred at most
    second = first.groupBy(*by).agg(F.flatten(spots).alias("__limbs"), F.sum("__odd").alias("__odd"), *[c[1](k).alias(k) for k, c in more.items()])
    out = _with_total(second, "__sum")
    return out.select(*by, F.coalesce("__odd", "__sum").alias(name), *more)
