"""Summaries of left-censored values per group."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hydrolake.functions import scalars as S
from hydrolake.operators.lineage import cut
from hydrolake.operators.order import medians

HIGH_SHARE, SMALL = 0.5, 20


#: Distinct values up to which one task folds a group; ranges that a larger group's values are dealt to, even by their number, and the accuracy of the edges.
LARGE, RANGES, ACCURACY = 65_536, 64, 1000


def kaplan_meier(df: DataFrame, by: str, value: str, censored: str, large: int = LARGE, ranges: int = RANGES) -> DataFrame:
    """Mean and median by Kaplan-Meier on flipped values; groups without a detected value are left out.

    Rows are counted per distinct value. Groups with few of them are folded each in one place, larger ones over
    ranges. The smallest value, if censored, counts as detected and is flagged.
    """
    rows = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"), F.col(censored).alias("c")).filter("v IS NOT NULL")
    per = cut(rows.groupBy("g", "v").agg(F.count("*").alias("n"), F.count_if(~F.col("c")).alias("d")))
    many = cut(per.groupBy("g").agg(F.count("*").alias("k")).filter(F.col("k") > large).select("g"))
    if many.isEmpty():
        out = _folded(per)
    else:
        named = many.select(F.col("g").alias("__g"))
        out = _folded(per.join(named, F.col("g").eqNullSafe(F.col("__g")), "left_anti")).unionByName(_ranged(per.join(named, F.col("g").eqNullSafe(F.col("__g")), "left_semi"), ranges))
    return out.withColumnRenamed("g", by)


def _folded(per: DataFrame) -> DataFrame:
    """Each group's distinct values in one array, from the top value down."""
    g = per.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("v", "n", "d")), asc=False).alias("xs"), F.sum("n").alias("n"), F.sum("d").alias("detected"), F.max("v").alias("top")).filter("detected > 0")
    last = F.element_at("xs", -1)
    # At risk are those not yet passed; events are the detected ones.
    steps = F.expr("""aggregate(xs, named_struct('left', n, 's', 1.0D, 'prev', top, 'area', 0.0D, 'median', cast(null as double), 'half', false),
      (a, x) -> CASE WHEN IF(x.v = element_at(xs, -1).v, x.n, x.d) = 0 THEN named_struct('left', a.left - x.n, 's', a.s, 'prev', a.prev, 'area', a.area, 'median', a.median, 'half', a.half)
      ELSE named_struct('left', a.left - x.n, 's', a.s * (1.0D - IF(x.v = element_at(xs, -1).v, x.n, x.d) / a.left), 'prev', x.v, 'area', a.area + a.s * (a.prev - x.v),
        'median', CASE WHEN a.half THEN (a.median + x.v) / 2 WHEN a.median IS NOT NULL THEN a.median WHEN a.s * (1.0D - IF(x.v = element_at(xs, -1).v, x.n, x.d) / a.left) <= 0.5D + 1e-9D THEN x.v END,
        'half', a.median IS NULL AND abs(a.s * (1.0D - IF(x.v = element_at(xs, -1).v, x.n, x.d) / a.left) - 0.5D) <= 1e-9D) END)""")
    out = g.withColumn("f", steps)
    return out.select("g", "n", (F.col("n") - F.col("detected")).alias("n_censored"), F.round(F.col("top") - F.col("f.area"), 6).alias("km_mean"), F.round("f.median", 6).alias("km_median"), (last["d"] < last["n"]).alias("smallest_censored"))


def _ranged(per: DataFrame, ranges: int) -> DataFrame:
    """Groups whose values are dealt to ranges between edges of even share, so that a task orders one range of a group.

    What is at risk below a range and the survival above it are sums and products over the ranges, which then go on
    inside each.
    """
    per = cut(per)
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    whole = per.groupBy("g").agg(F.sum("n").alias("total"), F.sum("d").alias("detected"), F.min("v").alias("least"), F.max("v").alias("top"), F.percentile_approx("v", shares, ACCURACY).alias("edges")).filter("detected > 0")
    whole = cut(whole)
    told = _null_safe(per, whole, "g").withColumn("range", F.size(F.filter("edges", lambda e: e < F.col("v"))))
    last = F.col("v") == F.col("least")
    told = cut(told.select("g", "v", "n", F.when(last, F.col("n")).otherwise(F.col("d")).alias("e"), "range", (last & (F.col("d") < F.col("n"))).alias("flagged")))
    # At risk at a value are the rows up to it, so those of lower ranges come first.
    sums = told.groupBy("g", "range").agg(F.sum("n").alias("m"), F.min("v").alias("first"), F.max("v").alias("final"))
    up = W.partitionBy("g").orderBy("range")
    sums = sums.withColumn("below", F.sum("m").over(up) - F.col("m")).withColumn("above_first", F.lead("first").over(up))
    inside = W.partitionBy("g", "range").orderBy("v")
    risk = _null_safe(told, sums.select("g", "range", "below", "above_first"), "g", "range")
    risk = risk.withColumn("risk", F.col("below") + F.sum("n").over(inside)).withColumn("next", F.coalesce(F.lead("v").over(inside), F.col("above_first")))
    risk = cut(risk.withColumn("kept", 1 - F.col("e") / F.col("risk")).drop("below", "above_first", "n"))
    # Survival goes down from the top value: the product of what higher ranges keep, then of higher values of the range.
    products = risk.groupBy("g", "range").agg(F.product("kept").alias("all"))
    down = W.partitionBy("g").orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    products = products.withColumn("before", F.coalesce(F.product("all").over(down), F.lit(1.0))).drop("all")
    falling = W.partitionBy("g", "range").orderBy(F.desc("v"))
    here = _null_safe(risk, products, "g", "range")
    above = F.col("before") * F.coalesce(F.product("kept").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))
    steps = here.withColumn("above", above).withColumn("s", F.col("above") * F.col("kept"))
    low = (F.col("e") > 0) & (F.col("s") <= 0.5 + 1e-9)
    steps = cut(steps.select("g", "v", "flagged", F.when(low, F.col("v")).alias("low"), (low & (F.abs(F.col("s") - 0.5) <= 1e-9)).alias("half"), (F.col("above") * (F.col("next") - F.col("v"))).alias("area")))
    out = steps.groupBy("g").agg(F.sum("area").alias("area"), F.max(F.struct("low", "half")).alias("median"), F.max("flagged").alias("smallest_censored"))
    # Where survival is a half exactly, the median is between that value and the next detected one below.
    at = out.filter("median.half").select(F.col("g").alias("k"), F.col("median.low").alias("at"))
    lower = steps.select("g", "low").join(at, F.col("g").eqNullSafe(F.col("k")) & (F.col("low") < F.col("at"))).groupBy("k").agg(F.max("low").alias("lower"))
    out = _null_safe(out, whole, "g").join(lower, F.col("g").eqNullSafe(F.col("k")), "left")
    median = F.when(F.col("lower").isNotNull(), (F.col("median.low") + F.col("lower")) / 2).otherwise(F.col("median.low"))
    return out.select("g", F.col("total").alias("n"), (F.col("total") - F.col("detected")).alias("n_censored"), F.round(F.col("top") - F.coalesce("area", F.lit(0.0)), 6).alias("km_mean"), F.round(median, 6).alias("km_median"), "smallest_censored")


def _null_safe(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """An inner join on columns that may be null."""
    named = right.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(named, on).drop(*[f"__{c}" for c in by])


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The quantile of the standard normal distribution."""
    return p.map(NormalDist().inv_cdf)


def plotting_positions(df: DataFrame, by: str, value: str, censored: str) -> DataFrame:
    """(group, v, seen, position): a row for each value, with its plotting position among values with several limits.

    The limits of a group are its censored values. They part its detected values into slots, slot j from the
    j-th limit on. The share below limit j is the product, over j and all slots above, of b / (a + b): a
    detected values in the slot, b values below its limit. Detected values of a slot are spread evenly
    between its limits' shares, those censored at a limit between none and its share. All of it is sums over
    counts of distinct values.
    """
    rows = df.select(F.col(by).alias("group"), F.col(value).cast("double").alias("v"), F.col(censored).alias("c")).filter("v IS NOT NULL")
    per = rows.groupBy("group", "v").agg(F.count_if(~F.col("c")).alias("d"), F.count_if("c").alias("h"))
    upto = W.partitionBy("group").orderBy("v")
    per = per.withColumn("slot", F.sum((F.col("h") > 0).cast("int")).over(upto)).withColumn("d_upto", F.sum("d").over(upto)).withColumn("h_upto", F.sum("h").over(upto))
    # The row of a limit is the first of its slot: what it has below are smaller detected values and all censored ones so far.
    first = F.struct("v", (F.col("d_upto") - F.col("d") + F.col("h_upto")).alias("b"), (F.col("d_upto") - F.col("d")).alias("before"))
    slots = per.groupBy("group", "slot").agg(F.sum("d").alias("a"), F.min(first).alias("f")).select("group", "slot", "a", F.col("f.b").alias("b"), F.col("f.before").alias("before"))
    down = W.partitionBy("group").orderBy(F.desc("slot"))
    share = F.product(F.when(F.col("slot") > 0, F.col("b") / (F.col("a") + F.col("b"))).otherwise(1.0)).over(down.rowsBetween(W.unboundedPreceding, 0))
    slots = slots.withColumn("low", F.when(F.col("slot") > 0, share).otherwise(0.0)).withColumn("high", F.coalesce(F.lag("low").over(down), F.lit(1.0)))
    placed = per.join(slots, ["group", "slot"])
    seen = placed.filter("d > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("d")))).select("group", "v", F.lit(True).alias("seen"), (F.col("low") + (F.col("high") - F.col("low")) * (F.col("d_upto") - F.col("d") - F.col("before") + F.col("k")) / (F.col("a") + 1)).alias("position"))
    hidden = placed.filter("h > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("h")))).select("group", "v", F.lit(False).alias("seen"), (F.col("low") * F.col("k") / (F.col("h") + 1)).alias("position"))
    return seen.unionByName(hidden)


def ros(df: DataFrame, by: str, value: str, censored: str) -> DataFrame:
    """Mean and median by regression on order statistics; both null where a line can't be fitted.

    The logarithms of detected values are regressed on the normal quantiles of their plotting positions, and
    censored values are read off that line. It takes three detected values, two of them different, all positive.
    """
    rows = plotting_positions(df, by, value, censored).withColumn("z", normal_quantile("position"))
    y = F.when(F.col("seen"), F.ln("v"))
    z = F.when(F.col("seen"), F.col("z"))
    least, most = F.min(F.when(F.col("seen"), F.col("v"))), F.max(F.when(F.col("seen"), F.col("v")))
    fit = rows.groupBy("group").agg(F.regr_slope(y, z).alias("slope"), F.regr_intercept(y, z).alias("at"), ((F.count_if("seen") >= 3) & (least > 0) & (least < most)).alias("fits"))
    filled = rows.join(fit, "group").select("group", F.when(F.col("fits"), F.when(F.col("seen"), F.col("v")).otherwise(F.exp(F.col("at") + F.col("slope") * F.col("z")))).alias("x"))
    filled = cut(filled)
    means = filled.groupBy("group").agg(F.avg("x").alias("ros_mean"))
    return means.join(medians(filled, ["group"], "x").withColumnRenamed("median", "ros_median"), "group", "left").withColumnRenamed("group", by)


def summarize(df: DataFrame, by: str, value: str, censored: str) -> DataFrame:
    """Median by Kaplan-Meier, mean by regression (else Kaplan-Meier; the plain one without censoring), and warnings."""
    out = kaplan_meier(df, by, value, censored).join(ros(df, by, value, censored), by)
    fitted = F.col("ros_mean").isNotNull() & ~F.isnan("ros_mean")
    plain = F.col("n_censored") == 0
    method = F.when(plain, "sample-mean").when(fitted, "ros-lognormal").otherwise("kaplan-meier")
    mean = F.when(~plain & fitted, F.col("ros_mean")).otherwise(F.col("km_mean"))
    warned = S.flags(ros_not_applicable=~plain & ~fitted, high_censoring=F.col("n_censored") / F.col("n") > HIGH_SHARE, small_sample=F.col("n") < SMALL, smallest_observation_censored=F.col("smallest_censored"))
    return out.select(by, "n", "n_censored", F.col("km_median").alias("median"), F.round(mean, 6).alias("mean"), method.alias("mean_method"), F.array_join(warned, ",").alias("warnings"))
