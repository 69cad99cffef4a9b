"""Individual samples with a value and a status for each indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.functions import dims
from hydrolake.functions import scalars as S
from hydrolake.operators.measurements import WORD, mask_size, month_mask

KINDS = {"Q": "quantified", "C": "confirmed", "D": "below detection", "M": "missing", "U": "unknown status", "I": "not a count"}
STATUSES = {"confirmedValue": "C", "limitOfDetectionValue": "D", "missingValue": "M"}


def value_kind(value: Column, status: Column) -> Column:
    """Q, C, D, M, U or I. Only Q and C are concentrations."""
    number = S.finite(value.try_cast("double"))
    whole = S.holds((number >= 0) & (number == F.floor(number)))
    blank = F.coalesce(F.trim(status), F.lit("")) == ""
    code = S.lookup(status, STATUSES, F.lit("U"))
    return F.when(value.isNull() & blank, "M").when(~blank & (code == "M"), "M").when(~blank & value.isNull(), F.when(code == "U", "U").otherwise("M")).when(~whole, "I").when(blank, "Q").otherwise(code)


def normalise(raw: DataFrame) -> DataFrame:
    """Typed rows with kinds, and `reason`: uid, id, prefix, date, season, in that order; `row_flags` of kept rows."""
    date = S.parse_date(F.col("sample_date"))
    season = F.col("season").try_cast("int")
    country = S.normalise_country(F.substring(F.trim("bw_id"), 1, 2))
    reason = F.when(F.col("uid").isNull(), "uid").when(~S.holds(F.length(F.trim("bw_id")) >= 3), "id").when(~S.holds(F.substring(F.trim("bw_id"), 1, 2) == F.col("prefix")), "prefix").when(date.isNull(), "date").when(~S.holds(season.between(1900, 2100)), "season")
    row_flags = S.flags(new_year=(F.month(date) == 1) & (F.dayofmonth(date) == 1), other_season=F.year(date) != season, remarks=F.col("has_remarks") > 0)
    out = raw.select("uid", "prefix", country.alias("country"), F.trim("bw_id").alias("bw_id"), season.alias("season"), date.alias("date"), *[x for i in ("ec", "ie") for x in (value_kind(F.col(f"{i}_value"), F.col(f"{i}_status")).alias(f"{i}_kind"), F.col(f"{i}_value").alias(f"{i}_reported"))], row_flags.alias("row_flags"), reason.alias("reason"))
    value = lambda i: F.when(F.col(f"{i}_kind") != "I", S.finite(F.col(f"{i}_reported").try_cast("double"))).alias(f"{i}_value")
    return out.select("*", value("ec"), value("ie")).drop("ec_reported", "ie_reported")


def dedupe_uid(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each uid, with how many there were."""
    rest = [c for c in rows.columns if c != "uid" and c not in order]
    best = rows.groupBy("uid").agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("r"), F.count("*").alias("n_rows"))
    return best.select("uid", "r.*", "n_rows")


def long(rows: DataFrame) -> DataFrame:
    """One row for each sample and indicator: (bw_id, country, season, date, pos, indicator, kind, value, q)."""
    one = lambda i: F.struct(F.lit(i).alias("indicator"), F.col(f"{i}_kind").alias("kind"), F.col(f"{i}_value").alias("value"))
    out = rows.select("bw_id", "country", "season", "date", F.explode(F.array(one("ec"), one("ie"))).alias("s")).select("bw_id", "country", "season", "date", S.month_pos(F.year("date"), F.month("date")).alias("pos"), "s.*")
    return out.withColumn("q", F.when(F.col("kind").isin("Q", "C"), F.col("value")))


def month_cells(rows: DataFrame) -> DataFrame:
    """Quantified samples of each water, indicator and month."""
    return long(rows).filter("q IS NOT NULL").groupBy("bw_id", "indicator", "pos").agg(F.count("*").alias("n"), F.sum("q").alias("sum_value"), F.min("q").alias("min"), F.max("q").alias("max"))


def deal(rows: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Long rows dealt to the windows that hold them; windows may overlap."""
    label = F.array_compact(F.array(*[F.when(F.col("pos").between(a, b), F.lit(k)) for k, a, b in windows]))
    return long(rows).withColumn("window", F.explode(label))


def kind_counts(rows: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    return deal(rows, windows).groupBy("country", "indicator", "window", "kind").agg(F.count("*").alias("n"))


#: Kinds that are counted under one name, and the flag of each.
COUNTED = {"n_confirmed_high": ("C",), "n_detection_limit": ("D",), "n_missing": ("M",), "n_unrecognised": ("U", "I")}
KIND_FLAGS = {"n_confirmed_high": "confirmed_high_values_included", "n_detection_limit": "detection_limit_values_excluded", "n_missing": "missing_values_excluded", "n_unrecognised": "unrecognised_status_values_excluded"}


def _kinds(inside: Column | None = None) -> list[Column]:
    return [F.count_if(F.col("kind").isin(*k) if inside is None else inside & F.col("kind").isin(*k)).alias(name) for name, k in COUNTED.items()]


def indicator_stats(rows: DataFrame, date_from: str | None = None, date_to: str | None = None, season: int | None = None, limit: int = 200) -> DataFrame:
    """Per water and indicator, of the samples of some days or a season: samples by kind, least, greatest, mean, exact median, and flags.

    A water without such samples has none and says so, and whether the days lie outside its samples;
    `truncated` is flagged where a listing of `limit` samples would not hold them all.
    """
    inside = F.lit(True)
    for c in ((F.col("date") >= F.lit(date_from).cast("date")) if date_from else None, (F.col("date") <= F.lit(date_to).cast("date")) if date_to else None, (F.col("season") == season) if season is not None else None):
        inside = inside if c is None else inside & S.holds(c)
    q = F.when(inside, F.col("q"))
    out = long(rows).groupBy("bw_id", "indicator").agg(F.count_if(inside).alias("n_rows"), F.count(q).alias("n"), F.min(q).alias("min"), F.max(q).alias("max"), F.round(F.avg(q), 6).alias("mean"), F.median(q).alias("median"), *_kinds(inside), F.min("date").alias("__first"), F.max("date").alias("__last"))
    outside = S.holds(F.lit(date_from).cast("date") > F.col("__last")) | S.holds(F.lit(date_to).cast("date") < F.col("__first"))
    named = S.flags(no_samples_in_range=F.col("n_rows") == 0, range_outside_data=(F.col("n_rows") == 0) & outside, truncated=F.col("n_rows") > limit, **{f: F.col(c) > 0 for c, f in KIND_FLAGS.items()})
    return out.withColumn("flags", F.array_join(named, ",")).drop("__first", "__last")


def window_scan(rows: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Per water, indicator and window: counts, total, extremes, months with values, median, and samples by kind."""
    months = F.countDistinct(F.when(F.col("q").isNotNull(), F.col("pos")))
    return deal(rows, windows).groupBy("country", "bw_id", "indicator", "window").agg(F.count("*").alias("n_rows"), F.count("q").alias("n"), F.sum("q").alias("total"), F.min("q").alias("low"), F.max("q").alias("high"), months.alias("months"), F.median("q").alias("median"), *_kinds())


def site_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bw_id").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("season").alias("first_season"), F.max("season").alias("last_season"))


def quantified_range(rows: DataFrame) -> DataFrame:
    """Per country and indicator: waters, quantified values and their dates."""
    return long(rows).groupBy("country", "indicator").agg(F.countDistinct("bw_id").alias("n_waters"), F.count("q").alias("n"), F.min(F.when(F.col("q").isNotNull(), F.col("date"))).alias("first_date"), F.max(F.when(F.col("q").isNotNull(), F.col("date"))).alias("last_date"))


def repeated_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bw_id", "date").agg(F.count("*").alias("n")).filter("n > 1")


def _side_flags(w: str, period: tuple[str, int, int], months: str) -> dict[str, Column]:
    """Flags of one period of a comparison; `first_pos` and `last_pos` are the months of the data."""
    return {
        "period_outside_data": F.col("first_pos").isNull() | (F.col("last_pos") < period[2]), "period_before_data": F.col("first_pos") > period[2],
        "partial_period": (F.col(f"{months}_{w}") > 0) & (F.col(f"{months}_{w}") < period[2] - period[1] + 1), **{f: F.col(f"{c}_{w}") > 0 for c, f in KIND_FLAGS.items()},
    }


def _with_flags(df: DataFrame, a: tuple[str, int, int], b: tuple[str, int, int], months: str, **more: Column) -> DataFrame:
    """`flags_a`, `flags_b` and `flags`, which has those of both periods and of the comparison."""
    note = F.col("relative_percent_note")
    of = {w: S.flags(**_side_flags(w, p, months)) for w, p in (("a", a), ("b", b))}
    top = S.flags(periods_overlap=F.lit(a[1] <= b[2] and b[1] <= a[2]), no_data_for_scope=F.col("first_pos").isNull(), relative_change_undefined=note.isin("baseline-zero", "baseline-missing", "comparison-missing"), **more)
    out = df.withColumn("flags_a", of["a"]).withColumn("flags_b", of["b"])
    return out.withColumn("flags", F.array_join(F.array_sort(F.array_union(F.array_union("flags_a", "flags_b"), top)), ",")).withColumns({f"flags_{w}": F.array_join(f"flags_{w}", ",") for w in "ab"})


def _changes(df: DataFrame) -> DataFrame:
    """The change of means, and under `median_` that of medians."""
    medians = S.change(F.col("median_a"), F.col("median_b"), F.lit("count"))
    return df.withColumns(S.change(F.col("mean_a"), F.col("mean_b"), F.lit("count"))).withColumns({f"median_{k}": c for k, c in medians.items()})


def compare(rows: DataFrame, a: tuple[str, int, int], b: tuple[str, int, int], least: int = dims.MIN_SAMPLES, everywhere: bool = False) -> DataFrame:
    """Per water and indicator: both periods' samples by kind, means, medians and extremes, their changes, status, why it is not paired, and flags.

    One aggregation with conditions for each period. With `everywhere` waters without samples in a period stand
    there too, and all have their first and last month with values and each period's months as bits.
    """
    from hydrolake.operators.periods import pair_reason

    key = ["country", "bw_id", "indicator"]
    pos, q, kind = F.col("pos"), F.col("q"), F.col("kind")
    aggregates = [F.min(F.when(q.isNotNull(), pos)).alias("first_pos"), F.max(F.when(q.isNotNull(), pos)).alias("last_pos")]
    for w, period in (("a", a), ("b", b)):
        inside = pos.between(*period[1:])
        own = F.when(inside, q)
        aggregates += [
            F.count(own).alias(f"n_{w}"), F.count_if(inside).alias(f"n_rows_{w}"), F.array(*month_mask(pos, inside & q.isNotNull(), [period])).alias(f"month_mask_{w}"),
            *[F.count_if(inside & kind.isin(*k)).alias(f"{c}_{w}") for c, k in COUNTED.items()],
            F.avg(own).alias(f"mean_{w}"), F.median(own).alias(f"median_{w}"), F.min(own).alias(f"low_{w}"), F.max(own).alias(f"high_{w}"),
        ]
    wide = long(rows).groupBy(*key).agg(*aggregates)
    if not everywhere:
        wide = wide.filter("n_rows_a + n_rows_b > 0")
    out = _changes(wide.withColumns({f"months_{w}": mask_size(F.col(f"month_mask_{w}")) for w in "ab"}))
    reason = pair_reason(F.col("n_a"), F.col("n_a"), F.col("n_b"), F.col("n_b"), least)
    out = out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("insufficient-data"))
    out = _with_flags(out, a, b, "months")
    return out if everywhere else out.drop("first_pos", "last_pos", "month_mask_a", "month_mask_b")


def compare_country(compared: DataFrame, by: list[str], a: tuple[str, int, int], b: tuple[str, int, int], few_sites: int = dims.FEW_SITES) -> DataFrame:
    """Paired waters of a group: mean of means, median of medians, their changes, directions, months, samples by kind of all waters, and flags.

    `compared` is `compare`'s result `everywhere`. One aggregation; the paired waters' months are joined bit by bit.
    """
    ok = F.col("reason").isNull()
    some = (F.col("n_a") > 0) | (F.col("n_b") > 0)
    relative = F.when(F.round("mean_a", dims.DECIMALS) != 0, 100 * F.try_divide(F.col("mean_b") - F.col("mean_a"), F.abs("mean_a")))
    count = lambda c, name: F.count_if(S.holds(c)).alias(name)
    own = lambda c: F.when(ok, F.col(c))
    words = {w: -(-(p[2] - p[1] + 1) // WORD) for w, p in (("a", a), ("b", b))}
    union = {w: F.array(*[F.coalesce(F.bit_or(own(f"month_mask_{w}")[k]), F.lit(0).cast("long")) for k in range(n)]) for w, n in words.items()}
    seen = F.col("n_rows_a") + F.col("n_rows_b") > 0
    agg = compared.withColumn("own", F.when(ok, relative)).groupBy(*by).agg(
        count(some, "n_considered"), count(ok, "n_paired"), count((F.col("reason") == "absent-in-period-a") & some, "n_absent_a"), count(F.col("reason") == "absent-in-period-b", "n_absent_b"), count(F.col("reason") == "insufficient-samples", "n_insufficient"),
        F.avg(own("mean_a")).alias("mean_a"), F.avg(own("mean_b")).alias("mean_b"), F.median(own("median_a")).alias("median_a"), F.median(own("median_b")).alias("median_b"), F.round(F.median("own"), dims.PERCENT_DECIMALS).alias("median_site_relative_percent"),
        count(ok & (F.col("direction") == "increased"), "n_increased"), count(ok & (F.col("direction") == "decreased"), "n_decreased"), count(ok & (F.col("direction") == "no-change"), "n_unchanged"), count(ok & F.col("own").isNull(), "n_undefined"),
        *[F.coalesce(F.sum(own(f"n_{w}")), F.lit(0)).alias(f"n_samples_{w}") for w in "ab"], *[F.sum(f"{c}_{w}").alias(f"{c}_{w}") for w in "ab" for c in COUNTED],
        *[mask_size(union[w]).alias(f"n_months_{w}") for w in "ab"], F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.count_if(seen).alias("__seen"),
    )
    out = _changes(agg.filter("__seen > 0").drop("__seen"))
    out = _with_flags(out, a, b, "n_months", few_sites=(F.col("n_paired") > 0) & (F.col("n_paired") < few_sites)).drop("flags_a", "flags_b", "first_pos", "last_pos")
    out = out.withColumn("n_excluded", F.col("n_considered") - F.col("n_paired")).withColumn("status", F.when(F.col("n_paired") > 0, "ok").otherwise("insufficient-data"))
    return out.withColumn("mean_a", F.round("mean_a", 6)).withColumn("mean_b", F.round("mean_b", 6))


def link(waters: DataFrame, samples: DataFrame) -> DataFrame:
    """Waters known to either table, whether there are samples, and their range."""
    s = site_summary(samples).withColumn("has_samples", F.lit(True))
    return waters.join(s, "bw_id", "full_outer").withColumn("has_samples", F.coalesce("has_samples", F.lit(False)))


def page_chain(pages: DataFrame, first: int = 0, start: int | None = None) -> DataFrame:
    """Pages with `valid`: false from the first bad page of a prefix on.

    The page `first` follows the row `start`, every other one the last row of the page before it, which an equi-join
    finds; a page that is missing, stands there twice, is empty or ends with another row than it says is bad. No task
    reads a chain in order: the first bad place is a minimum.
    """
    begins = F.col("seq") == first
    ends = pages.groupBy("prefix", (F.col("seq") + 1).alias("seq")).agg(F.max("last_uid").alias("__before"), F.lit(True).alias("__any"))
    twice = pages.groupBy("prefix", "seq").agg((F.count("*") > 1).alias("__twice"))
    linked = pages.join(ends, ["prefix", "seq"], "left").join(twice, ["prefix", "seq"])
    follows = F.when(begins, F.col("after_uid").eqNullSafe(F.lit(start))).otherwise(S.holds(F.col("__any")) & F.col("after_uid").eqNullSafe(F.col("__before")))
    grows = F.col("after_uid").isNull() | (F.col("last_uid") > F.col("after_uid"))
    good = S.holds((F.col("seq") >= first) & follows & grows & (F.size("uids") > 0) & (F.get("uids", F.size("uids") - 1) == F.col("last_uid"))) & ~F.col("__twice")
    judged = linked.withColumn("__good", good)
    bad = judged.filter(~F.col("__good")).groupBy("prefix").agg(F.min("seq").alias("__bad"))
    out = judged.join(bad, "prefix", "left").withColumn("valid", F.col("__bad").isNull() | (F.col("seq") < F.col("__bad")))
    return out.select(*pages.columns, "valid")


def view(rows: DataFrame) -> DataFrame:
    """Display rows: value only of kinds Q and C, the reported one not of I and M, kinds spelled out."""
    out = long(rows)
    return out.select("bw_id", "date", "indicator", S.lookup(F.col("kind"), KINDS).alias("kind"), F.col("q").alias("value"), F.when(~F.col("kind").isin("I", "M"), F.col("value")).alias("reported_value"))
