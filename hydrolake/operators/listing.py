"""Search, pages, unions, overviews and calendar context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.functions import scalars as S
from hydrolake.operators.lineage import table


def search(sites: DataFrame, country: str | None = None, category: str | None = None, q: str | None = None, columns: tuple[str, ...] = ("site_id", "name")) -> DataFrame:
    """Sites that meet all given filters; `q`, cut at 64 characters, is contained in a column, ignoring case (of all of Unicode)."""
    out = sites
    if country:
        out = out.filter(F.col("country") == country.upper())
    if category:
        out = out.filter(F.col("category") == category)
    if q and q.strip():
        wanted = F.lower(F.lit(q.strip()[:64]))
        hit = F.lit(False)
        for c in columns:
            hit = hit | S.holds(F.contains(F.lower(F.col(c)), wanted))
        out = out.filter(hit)
    return out


#: Rows before the end of a page up to which ordering them in one place is cheaper than finding the page's range.
NEAR = 10_000


def page(df: DataFrame, order: list[Column | str], limit: int = 200, offset: int = 0, most: int = 500) -> DataFrame:
    """One ordered page, with total_matching and whether the page leaves rows out. The limit is kept within 1..most.

    A page near the beginning is the first rows of all tasks. For a page far behind, rows are dealt to ranges of the
    order and written down; counts of the ranges tell which ones hold the page, and only those are ordered. Equal rows
    stand in one range.
    """
    limit, offset = max(1, min(limit, most)), max(0, offset)
    total = df.agg(F.count("*").alias("total_matching"))
    if offset + limit <= NEAR:
        rows = df.orderBy(*order).offset(offset).limit(limit)
    else:
        rows = _seek(df, order, limit, offset)
    return rows.join(F.broadcast(total), F.lit(True), "left").withColumn("truncated", F.col("total_matching") > offset + limit)  # one total row


def _seek(df: DataFrame, order: list[Column | str], limit: int, offset: int) -> DataFrame:
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = table(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "page")
    found = {r["__range"]: r["count"] for r in dealt.groupBy("__range").count().collect()}  # a row a range
    before, skipped, wanted = 0, 0, []
    for k in sorted(found):
        if before + found[k] <= offset:
            skipped += found[k]
        elif before < offset + limit:
            wanted.append(k)
        before += found[k]
    return dealt.filter(F.col("__range").isin(*wanted)).orderBy(*order).offset(offset - skipped).limit(limit).drop("__range")


def overlaps(start: Column, end: Column, first_day: Column, last_day: Column) -> Column:
    """Whether [start, end) meets the inclusive window of days; an unreadable time never meets one."""
    return S.holds((F.to_timestamp(first_day) < end) & (F.date_add(last_day, 1).cast("timestamp") > start))


def union_sources(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Rows of all sources in the given order of sources (`source_rank`), columns by name, with their origin."""
    out = None
    for k, (name, df) in enumerate(sources):
        own = df.withColumn("origin", F.lit(name)).withColumn("source_rank", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def flag_union(*columns: Column) -> Column:
    """Sorted union of flag lists; null lists are empty."""
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*columns)))))


def overview(sites: DataFrame, limits: DataFrame) -> DataFrame:
    """Per country of sites (country, source, category): what can be said about it, sites, sources.

    Status: national-limits, eu-values-only, measurements-only or no-evaluable-water-data.
    """
    g = sites.groupBy("country").agg(F.count("*").alias("n_sites"), F.count_if(F.col("category") == "RW").alias("n_river"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    known = limits.groupBy("country").agg(F.count("*").alias("n_limits"))
    out = g.join(known, "country", "full_outer").withColumns({"n_sites": F.coalesce("n_sites", F.lit(0)), "n_river": F.coalesce("n_river", F.lit(0)), "n_limits": F.coalesce("n_limits", F.lit(0))})
    status = F.when(F.col("n_sites") == 0, "no-evaluable-water-data").when(F.col("n_river") == 0, "measurements-only").when(F.col("n_limits") > 0, "national-limits").otherwise("eu-values-only")
    return out.withColumn("status", status)


def applicability(evidence: DataFrame, indices: list[tuple[str, str, bool, bool]]) -> DataFrame:
    """Whether each index (name, data it needs, needs a place, needs a river) applies to each country, or why not.

    The indices are a handful of literals; evidence is (country, data array, n_located, n_located_river).
    """
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("index"), F.lit(d).alias("needs"), F.lit(p).alias("place"), F.lit(r).alias("river")) for n, d, p, r in indices]))
    rows = evidence.withColumn("s", spec).select("*", "s.*")
    reason = F.when(F.col("data").isNull(), "not-loaded").when(~F.array_contains("data", F.col("needs")), "no-data").when(F.col("river") & (F.col("n_located_river") == 0), "no-located-river-site").when(F.col("place") & (F.col("n_located") == 0), "no-located-site")
    return rows.select("country", "index", reason.isNull().alias("applies"), reason.alias("reason"))


def monthly_context(daily: DataFrame, first: str, last: str, how: str, low: float, high: float, by: str = "site") -> DataFrame:
    """Months of daily (by, day, value): sum or mean of plausible values, days, coverage, flags. Nothing is filled in.

    Every month of the window appears for every `by`; a month without values has none.
    """
    ok = F.col("value").between(low, high)
    days = daily.filter(F.col("day").between(F.lit(first), F.lit(last)))
    value = F.sum(F.when(ok, F.col("value"))) if how == "sum" else F.avg(F.when(ok, F.col("value")))
    month = lambda c: F.trunc(c, "month")
    got = days.groupBy(by, month(F.col("day")).alias("month")).agg(F.round(value, 2).alias("value"), F.countDistinct(F.when(ok, F.col("day"))).alias("n_days"), F.count_if(F.col("value").isNotNull() & ~ok).alias("n_implausible"))
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    spine = daily.select(by).distinct().withColumn("month", F.explode(F.sequence(month(start), month(end), F.expr("interval 1 month"))))
    whole = F.datediff(F.least(F.last_day("month"), end), F.greatest(F.col("month"), start)) + 1
    out = spine.join(got, [by, "month"], "left").fillna(0, ["n_days", "n_implausible"]).withColumn("days_in_window", whole)
    named = S.flags(partial_month=F.col("n_days") < F.dayofmonth(F.last_day("month")), period_outside_data=F.col("n_days") == 0, implausible_values_ignored=F.col("n_implausible") > 0)
    return out.withColumn("coverage", F.round(F.col("n_days") / F.col("days_in_window"), 3)).withColumn("flags", F.array_join(named, ",")).drop("n_implausible")


def observed_range(records: DataFrame, by: list[str]) -> DataFrame:
    """Values without a comparator: number, least, greatest; censored ones; first and last period."""
    plain = F.col("comparator").isNull()
    return records.groupBy(*by).agg(F.count_if(plain).alias("n"), F.min(F.when(plain, F.col("value"))).alias("min"), F.max(F.when(plain, F.col("value"))).alias("max"), F.count_if(~plain).alias("n_censored"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def near_points(points: DataFrame, places: DataFrame, half_km: float = 5.0) -> DataFrame:
    """Points (point, lat, lon) in the square of half side `half_km` around places (place, lat, lon), with their distance.

    Both sides are dealt to cells as large as the square, so the join is an equi-join on cells; places
    beyond 80 degrees or with a square across the antimeridian are left out.
    """
    step = half_km / 111.32
    cell = lambda c: F.floor(F.col(c) / step).cast("long")
    p = places.withColumn("dlon", step / F.cos(F.radians("lat"))).filter((F.abs("lat") <= 80) & (F.abs("lon") + F.col("dlon") <= 180))
    p = p.select("place", F.col("lat").alias("plat"), F.col("lon").alias("plon"), "dlon", F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1)).alias("row"))
    # Columns of a row of cells are as wide as the row's widest square.
    wide = lambda row: step / F.cos(F.radians(F.least((F.abs(row) + 2) * step, F.lit(81.0))))
    p = p.withColumn("w", wide(F.col("row"))).withColumn("column", F.explode(F.sequence(F.floor((F.col("plon") - F.col("dlon")) / F.col("w")).cast("long"), F.floor((F.col("plon") + F.col("dlon")) / F.col("w")).cast("long"))))
    q = points.withColumn("row", cell("lat")).withColumn("column", F.floor(F.col("lon") / wide(F.col("row"))).cast("long"))
    met = q.join(p, ["row", "column"]).filter((F.abs(F.col("lat") - F.col("plat")) <= step) & (F.abs(F.col("lon") - F.col("plon")) <= F.col("dlon")))
    return met.select("place", "point", F.round(S.haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")), 6).alias("km"))


MOST_FIGURES = 17


def figures(n: Column, low_precision: Column | None = None) -> Column:
    """The figures that n values bear: 3 from 20 on, else 2; 2 also for low precision or an unknown n."""
    large = S.holds(n >= 20) if low_precision is None else S.holds(n >= 20) & ~S.holds(low_precision)
    return F.when(large, 3).otherwise(2)


def approximate(low: Column, high: Column, n: Column) -> Column:
    """An outward-rounded range (low, high): the least value rounded down, the greatest up."""
    f = figures(n)
    return F.struct(S.round_figures(low, f, "down").alias("low"), S.round_figures(high, f, "up").alias("high"))


def approximate_value(value: Column, n: Column, low: Column, high: Column, low_precision: Column | None = None) -> Column:
    """The value with the figures that n values bear, or with as many more as it takes to lie in [low, high]; null bounds don't bind."""
    least = figures(n, low_precision)
    inside = lambda x: F.coalesce(x >= low, F.lit(True)) & F.coalesce(x <= high, F.lit(True))
    tried = F.transform(F.sequence(least, F.lit(MOST_FIGURES)), lambda k: S.round_figures(value, k))
    return F.coalesce(F.get(F.filter(tried, inside), F.lit(0)), value)


def precision_reasons(n: Column, partial: Column, below_share: Column, n_sites: Column, annual: Column) -> Column:
    """Why figures are few: fewer than 5 values, a part of the period, a quarter or more below detection, fewer than 5 sites, annual data only."""
    return S.flags(few_samples_in_a_period=n < 5, partial_period=partial, high_below_detection_share=below_share >= 0.25, few_paired_sites=n_sites < 5, annual_only_data=annual)
