"""Comparison of two periods: per site, and per country over paired sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.functions import dims
from hydrolake.functions import scalars as S
from hydrolake.operators import measurements as M

Window = tuple[str, int, int]


def site_windows(cells: DataFrame, a: Window, b: Window, rules: DataFrame | None = None) -> DataFrame:
    """One row per site and series with both periods' statistics side by side (suffixes _a and _b).

    One aggregation with conditions for each period, so one shuffle of partial sums. Means stay within [low, high].
    `identity` is the country and category of the site's first cell inside the periods, by unit and month, also of
    units without a factor; those cells count for nothing else.
    """
    windows = {"a": a, "b": b}
    rows = M.with_pos(cells).filter(M._inside(F.col("pos"), [a, b]))
    if rules is not None:
        rows = rows.join(rules.select(*M.SERIES, "unit", "factor"), [*M.SERIES, "unit"], "left")
    else:
        rows = rows.withColumn("factor", F.lit(1.0))
    some, known = F.col("n") > 0, F.col("factor").isNotNull()
    aggregates = [F.min(F.struct("unit", "pos", "country", "category")).alias("identity")]
    for w, (_, first, last) in windows.items():
        inside = known & F.col("pos").between(first, last)
        of = lambda c, inside=inside: F.when(inside, c)
        aggregates += [
            F.coalesce(F.sum(of(F.col("n"))), F.lit(0)).alias(f"n_{w}"), F.coalesce(F.sum(of(F.col("n_below_loq"))), F.lit(0)).alias(f"n_below_loq_{w}"),
            F.sum(of(F.col("sum_value") * F.col("factor"))).alias(f"total_{w}"), F.min(F.when(inside & some, F.col("min") * F.col("factor"))).alias(f"low_{w}"),
            F.max(F.when(inside & some, F.col("max") * F.col("factor"))).alias(f"high_{w}"), F.array(*M.month_mask(F.col("pos"), inside & some, [windows[w]])).alias(f"month_mask_{w}"),
        ]
    out = rows.groupBy("site_id", *M.SERIES).agg(*aggregates)
    for w in windows:
        mean = F.greatest(F.least(F.col(f"total_{w}") / F.col(f"n_{w}"), F.col(f"high_{w}")), F.col(f"low_{w}"))
        out = out.withColumns({f"mean_{w}": F.when(F.col(f"n_{w}") > 0, mean), f"records_{w}": F.col(f"n_{w}") + F.col(f"n_below_loq_{w}"), f"months_{w}": M.mask_size(F.col(f"month_mask_{w}"))})
    return out.drop("total_a", "total_b")


def pair_reason(n_a: Column, records_a: Column, n_b: Column, records_b: Column, least: int) -> Column:
    """Why a site is not paired; null if it is."""
    return F.when(records_a == 0, "absent-in-period-a").when(records_b == 0, "absent-in-period-b").when((n_a < least) | (n_b < least), "insufficient-samples")


def pair_sites(wide: DataFrame, least: int = dims.MIN_SAMPLES) -> DataFrame:
    """Sites with records in a period, with the reason that keeps them out of a comparison."""
    known = wide.filter((F.col("records_a") > 0) | (F.col("records_b") > 0))
    return known.withColumn("reason", pair_reason(F.col("n_a"), F.col("records_a"), F.col("n_b"), F.col("records_b"), least))


def compare_site(wide: DataFrame, a: Window, b: Window, unit: Column, limit: Column, is_lower: Column, least: int = dims.MIN_SAMPLES) -> DataFrame:
    """Change, assessment per period, crossing, status and flags of every site and series."""
    change = S.change(F.col("mean_a"), F.col("mean_b"), unit)
    status = {w: S.assess(F.col(f"mean_{w}"), limit, is_lower) for w in "ab"}
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    months = {"a": a[2] - a[1] + 1, "b": b[2] - b[1] + 1}
    partial = [(F.col(f"months_{w}") > 0) & (F.col(f"months_{w}") < months[w]) for w in "ab"]
    out = wide.withColumns(change).withColumn("status", F.when(enough, "ok").otherwise("insufficient-data")).withColumn("assessment_a", status["a"]).withColumn("assessment_b", status["b"])
    out = out.withColumn("crossed_limit", F.when(enough, S.crossing(F.col("assessment_a"), F.col("assessment_b"))))
    note = F.col("relative_percent_note")
    named = S.flags(
        partial_period=partial[0] | partial[1], below_loq_excluded_bias_upward=(F.col("n_below_loq_a") + F.col("n_below_loq_b")) > 0, periods_overlap=F.lit(a[1] <= b[2] and b[1] <= a[2]),
        relative_change_undefined=note.isin("baseline-zero", "baseline-missing", "comparison-missing"), relative_change_interval_scale=note == "interval-scale",
    )
    return out.withColumn("flags", F.array_join(named, ","))


def compare_country(paired: DataFrame, by: list[str], a: Window, b: Window, unit: Column, river: Column, limit: Column, is_lower: Column, data_range: DataFrame | None = None, few_sites: int = dims.FEW_SITES) -> DataFrame:
    """Paired sites of a group: mean of site means, its change, median of relative changes, directions, months, samples below the limit of quantification, and rivers over their limit.

    `paired` is `pair_sites` with the columns `by` and those that `unit` (the same in a group), `river` (the site is
    one) and `limit` (of a river) read. Months of the paired sites are joined bit by bit in the same aggregation. Sites that are not paired count by their reason. `data_range` has (by, first_pos, last_pos):
    where a group has none, there is no data for it.
    """
    ok = F.col("reason").isNull()
    relative = F.when(F.round("mean_a", dims.DECIMALS) != 0, 100 * F.try_divide(F.col("mean_b") - F.col("mean_a"), F.abs("mean_a")))
    rows = paired.withColumn("own_direction", S.change(F.col("mean_a"), F.col("mean_b"), F.lit(None).cast("string"))["direction"]).withColumn("own_relative", relative)
    judged = ok & river & limit.isNotNull()
    over = {w: judged & F.when(is_lower, F.col(f"mean_{w}") < limit).otherwise(F.col(f"mean_{w}") > limit) for w in "ab"}
    count = lambda c, name: F.count_if(S.holds(c)).alias(name)
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    share = lambda w: F.round(F.try_divide(total(f"n_below_loq_{w}").cast("double"), (total(f"n_{w}") + total(f"n_below_loq_{w}")).cast("double")), 6)
    words = {w: -(-(p[2] - p[1] + 1) // M.WORD) for w, p in (("a", a), ("b", b))}
    union = {w: F.array(*[F.coalesce(F.bit_or(F.when(ok, F.col(f"month_mask_{w}")[k])), F.lit(0).cast("long")) for k in range(n)]) for w, n in words.items()}
    agg = rows.groupBy(*by).agg(
        F.max(unit).alias("__unit"), *[M.mask_size(union[w]).alias(f"n_months_{w}") for w in "ab"],
        F.count("*").alias("n_considered"), count(ok, "n_paired"), count(F.col("reason") == "absent-in-period-a", "n_absent_a"), count(F.col("reason") == "absent-in-period-b", "n_absent_b"), count(F.col("reason") == "insufficient-samples", "n_insufficient"),
        F.avg(F.when(ok, F.col("mean_a"))).alias("mean_a"), F.avg(F.when(ok, F.col("mean_b"))).alias("mean_b"), F.round(F.median(F.when(ok, F.col("own_relative"))), dims.PERCENT_DECIMALS).alias("median_relative_percent"),
        count(ok & (F.col("own_direction") == "increased"), "n_increased"), count(ok & (F.col("own_direction") == "decreased"), "n_decreased"), count(ok & (F.col("own_direction") == "no-change"), "n_unchanged"),
        count(ok & F.col("own_relative").isNull(), "n_undefined"), *[total(f"n_{w}").alias(f"n_samples_{w}") for w in "ab"], *[total(f"n_below_loq_{w}").alias(f"n_below_loq_{w}") for w in "ab"], *[share(w).alias(f"below_loq_share_{w}") for w in "ab"],
        count(judged, "n_rivers_judged"), count(over["a"], "n_rivers_over_a"), count(over["b"], "n_rivers_over_b"), F.max(limit).alias("river_limit"),
    )
    out = agg
    if data_range is not None:
        out = _null_safe_left(out, data_range.select(*by, "first_pos", "last_pos"), by)
    else:
        out = out.withColumns({"first_pos": F.lit(a[1]), "last_pos": F.lit(b[2])})
    out = out.withColumns(S.change(F.col("mean_a"), F.col("mean_b"), F.col("__unit"))).drop("__unit")
    note, of = F.col("relative_percent_note"), {"a": a, "b": b}
    either = lambda c: c("a") | c("b")
    named = S.flags(
        no_data_for_scope=F.col("first_pos").isNull(), period_outside_data=either(lambda w: F.coalesce(F.lit(of[w][2]) > F.col("last_pos"), F.lit(True))), period_before_data=either(lambda w: S.holds(F.lit(of[w][2]) < F.col("first_pos"))),
        partial_period=either(lambda w: (F.col(f"n_months_{w}") > 0) & (F.col(f"n_months_{w}") < of[w][2] - of[w][1] + 1)), below_loq_excluded_bias_upward=either(lambda w: F.col(f"n_below_loq_{w}") > 0),
        periods_overlap=F.lit(a[1] <= b[2] and b[1] <= a[2]), few_sites=(F.col("n_paired") > 0) & (F.col("n_paired") < few_sites),
        relative_change_undefined=note.isin("baseline-zero", "baseline-missing", "comparison-missing"), relative_change_interval_scale=note == "interval-scale",
    )
    out = out.withColumn("status", F.when(F.col("n_paired") > 0, "ok").otherwise("insufficient-data")).withColumn("n_excluded", F.col("n_considered") - F.col("n_paired"))
    return out.withColumn("flags", F.array_join(named, ",")).withColumn("mean_a", F.round("mean_a", 6)).withColumn("mean_b", F.round("mean_b", 6)).drop("first_pos", "last_pos")


def _null_safe_left(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """A left join whose keys may be null."""
    right = right.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(right, on, "left").drop(*[f"__{c}" for c in by])


def period_stats(spans: DataFrame, first: int, last: int, by: list[str]) -> DataFrame:
    """Cells with spans (first_month, last_month, n, total, low, high, n_below_loq): those inside the period, and how many cross its edge."""
    touches = (F.col("first_month") <= last) & (F.col("last_month") >= first)
    inside = (F.col("first_month") >= first) & (F.col("last_month") <= last)
    some = inside & (F.col("n") > 0)
    total, n = F.sum(F.when(some, F.col("total"))), F.sum(F.when(inside, F.col("n")))
    low, high = F.min(F.when(some, F.col("low"))), F.max(F.when(some, F.col("high")))
    below = F.coalesce(F.sum(F.when(inside, F.col("n_below_loq"))), F.lit(0))
    return spans.filter(touches).groupBy(*by).agg(F.coalesce(n, F.lit(0)).alias("n"), F.round(F.greatest(F.least(F.try_divide(total, n.cast("double")), high), low), 6).alias("mean"), low.alias("low"), high.alias("high"), below.alias("n_below_loq"), F.count_if(~inside).alias("n_partial"), F.round(F.try_divide(below.cast("double"), (F.coalesce(n, F.lit(0)) + below).cast("double")), 6).alias("below_loq_share"))


def annual_cells(records: DataFrame) -> DataFrame:
    """Period-summary records (start, end as month positions, value, comparator) to cells that span their months.

    '<' and '<=' are one value below the limit of quantification; other comparators and records without a span are left out.
    """
    below = F.col("comparator").isin("<", "<=")
    usable = F.col("first_month").isNotNull() & (F.col("last_month") >= F.col("first_month")) & (F.col("comparator").isNull() | below) & F.col("value").isNotNull()
    n = F.when(S.holds(below), 0).otherwise(1)
    value = F.when(~S.holds(below), F.col("value"))
    keep = [c for c in records.columns if c not in ("comparator", "value")]
    return records.filter(usable).select(*keep, n.alias("n"), F.coalesce(value, F.lit(0.0)).alias("total"), value.alias("low"), value.alias("high"), (1 - n).alias("n_below_loq"))
