"""Measurement rows to monthly cells, and rollups of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.functions import dims
from hydrolake.functions import scalars as S
from hydrolake.operators import exact

KEY = ["country", "site_id", "category", "determinand", "matrix", "unit", "year", "month"]
SERIES = ["determinand", "matrix"]
NAMES = {
    "countryCode": "country", "monitoringSiteIdentifier": "site_id", "parameterWaterBodyCategory": "category", "observedPropertyDeterminandCode": "determinand",
    "procedureAnalysedMatrix": "matrix", "resultUom": "unit", "phenomenonTimeSamplingDate": "date", "resultObservedValue": "value",
    "resultQualityObservedValueBelowLOQ": "below", "resultObservationStatus": "status", "metadata_observationStatus": "reliability",
}


def _typed(df: DataFrame, min_year: int) -> tuple[DataFrame, list[Column], Column]:
    """Rows with what several rules read, computed once; the result's columns; the first rule that drops a row."""
    codes = {d[0]: d for d in dims.DETERMINANDS}
    bad = lambda c, why: F.when(~S.holds(c), F.lit(why))
    malformed = F.col("_malformed") if "_malformed" in df.columns else F.lit(False)
    typed = df.select(
        S.normalise_country(F.col("countryCode")).alias("country"), F.trim("monitoringSiteIdentifier").alias("site_id"), F.col("parameterWaterBodyCategory").alias("category"), F.col("observedPropertyDeterminandCode").alias("determinand"),
        F.col("procedureAnalysedMatrix").alias("matrix"), F.trim("resultUom").alias("unit"), S.parse_date(F.col("phenomenonTimeSamplingDate")).alias("date"), S.number(F.col("resultObservedValue")).alias("number"),
        S.holds(F.col("resultQualityObservedValueBelowLOQ").isin(*dims.BELOW_LOQ)).alias("below_loq"), S.holds(F.col("metadata_observationStatus").isin(*dims.UNRELIABLE)).alias("unreliable"),
        S.holds(F.col("resultObservationStatus").isin(*dims.MISSING)).alias("missing"), S.holds(malformed).alias("malformed"),
    )
    code, date, value, below = map(F.col, ("determinand", "date", "number", "below_loq"))
    own = {k: "W,W-DIS" if d[8] is None else d[3] for k, d in codes.items()}
    both, one = [k for k, m in own.items() if m == "W,W-DIS"], {k: m for k, m in own.items() if m != "W,W-DIS"}
    low, high = S.lookup(code, {k: v[0] for k, v in dims.PLAUSIBLE.items()}), S.lookup(code, {k: v[1] for k, v in dims.PLAUSIBLE.items()})
    reason = F.coalesce(
        F.when(F.col("malformed"), "malformed"),
        bad(F.col("country").isNotNull(), "country"),
        bad(F.col("category").isin(*dims.CATEGORIES), "category"),
        bad(code.isin(*codes), "determinand"),
        bad((code.isin(both) & F.col("matrix").isin(*dims.MATRICES)) | (S.lookup(code, one) == F.col("matrix")), "matrix"),
        F.when(F.col("missing"), "missing-value"),
        bad(date.isNotNull(), "date"),
        bad(F.year(date) >= min_year, "before-min-year"),
        bad((F.col("unit") != "") & (F.col("site_id") != ""), "no-unit-or-site"),
        bad(below | value.isNotNull(), "no-value"),
        F.when(S.holds(~below & ((value < low) | (value > high))), "implausible"),
    )
    columns = [*map(F.col, ("country", "site_id", "category", "determinand", "matrix", "unit")), F.year(date).alias("year"), F.month(date).alias("month"), F.when(~below, value).alias("value"), F.col("below_loq"), F.col("unreliable")]
    return typed, columns, reason


def drop_reason(df: DataFrame, min_year: int = dims.MIN_YEAR) -> DataFrame:
    """Typed columns and `reason`, the first rule that drops a raw row (null: kept). One projection, no shuffle.

    Rows whose number is below the limit of quantification are kept without a value.
    """
    typed, columns, reason = _typed(df, min_year)
    return typed.select(*columns, reason.alias("reason"))


def kept(df: DataFrame, min_year: int = dims.MIN_YEAR) -> DataFrame:
    """The typed rows that no rule drops.

    Rules on plain columns are filters that reach the scan. The others stand in a generator: a filter on
    the reason would be pushed below the parsing and parse every column once more for each rule.
    """
    plain = F.col("parameterWaterBodyCategory").isin(*dims.CATEGORIES) & F.col("observedPropertyDeterminandCode").isin(*[d[0] for d in dims.DETERMINANDS])
    typed, columns, reason = _typed(df.filter(plain), min_year)
    return typed.select(F.explode(F.when(reason.isNull(), F.array(F.struct(*columns)))).alias("r")).select("r.*")


def monthly_cells(rows: DataFrame, exactly: bool = False) -> DataFrame:
    """Kept rows to cells: counts, sum, least and greatest of quantified values. One shuffle behind partial sums.

    With `exactly` the sums are correctly rounded, and so do not depend on the order of rows.
    """
    q = F.col("value").isNotNull()
    counts = {"n": F.count_if(q), "n_below_loq": F.count_if("below_loq"), "n_lower_reliability": F.count_if("unreliable")}
    ends = {"min": F.min("value"), "max": F.max("value")}
    order = [*KEY, "n", "sum_value", "min", "max", "n_below_loq", "n_lower_reliability"]
    if exactly:
        more = {k: (c, F.sum) for k, c in counts.items()} | {k: (c, getattr(F, k)) for k, c in ends.items()}
        cells = exact.exact_sum(rows, KEY, "value", "sum_value", **more).fillna(0.0, ["sum_value"])
    else:
        cells = rows.groupBy(*KEY).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum_value"), *[c.alias(k) for k, c in (counts | ends).items()])
    return cells.select(*order)


def with_pos(cells: DataFrame) -> DataFrame:
    return cells.withColumn("pos", S.month_pos(F.col("year"), F.col("month")))


def annual_series(cells: DataFrame) -> DataFrame:
    """Cells of a year summed; the mean is null without values."""
    return cells.groupBy(*[k for k in KEY if k != "month"]).agg(
        F.sum("n").alias("n"), F.round(F.try_divide(F.sum("sum_value"), F.sum("n").cast("double")), 6).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n_below_loq").alias("n_below_loq"),
    )


def monthly_series(cells: DataFrame, first: int, last: int, limit: int = 2000) -> DataFrame:
    """Cells of month positions first..last in order, `limit` at most a site and series, with the number of all that match."""
    w = W.partitionBy("site_id", *SERIES, "unit")
    rows = with_pos(cells).filter(F.col("pos").between(first, last))
    rows = rows.withColumn("total_matching", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("pos", "country", "category")))
    return rows.filter(F.col("place") <= limit).select("site_id", *SERIES, "unit", S.month_text(F.col("pos")).alias("month"), "n", F.round(F.try_divide("sum_value", F.col("n").cast("double")), 6).alias("mean"), "total_matching", "place")


def site_rollup(cells: DataFrame) -> DataFrame:
    """Per site: smallest country, category with the most records (ties by name), span of years, records."""
    records = F.col("n") + F.col("n_below_loq")
    per = cells.groupBy("site_id", "category").agg(F.min("country").alias("country"), F.sum(records).alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return per.groupBy("site_id").agg(F.min("country").alias("country"), F.min_by("category", F.struct(-F.col("records"), F.col("category"))).alias("category"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"), F.sum("records").alias("n_records"))


def one_country(cells: DataFrame) -> DataFrame:
    """Cells of each site's smallest country; `skipped` cells of its other countries are left out."""
    w = W.partitionBy("site_id")
    return cells.withColumn("own", F.min("country").over(w)).filter("country = own").drop("own")


def country_determinands(cells: DataFrame) -> DataFrame:
    """Sites and records of each country and determinand."""
    per = cells.groupBy("country", "determinand", "site_id").agg(F.sum(F.col("n") + F.col("n_below_loq")).alias("r"))
    return per.groupBy("country", "determinand").agg(F.count("*").alias("n_sites"), F.sum("r").alias("n_records"))


def country_ranges(cells: DataFrame) -> DataFrame:
    rows = with_pos(cells).groupBy("country").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return rows.select("country", S.month_text(F.col("a")).alias("first"), S.month_text(F.col("b")).alias("last"))


def country_summary(sites: DataFrame, cells: DataFrame) -> DataFrame:
    """Per country: sites by category, without a location, years, records, groups, months."""
    a = sites.groupBy("country").agg(F.count("*").alias("n_sites"), F.count_if(F.col("category") == "RW").alias("n_river"), F.count_if(F.col("category") == "LW").alias("n_lake"), F.count_if(F.col("lat").isNull()).alias("n_unlocated"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"), F.sum("n_records").alias("n_records"))
    group = S.lookup(F.col("determinand"), {d[0]: d[7] for d in dims.DETERMINANDS})
    b = with_pos(cells).groupBy("country").agg(F.array_sort(F.collect_set(group)).alias("groups"), F.countDistinct("pos").alias("n_months"))
    return a.join(b, "country", "left").withColumn("groups", F.array_join("groups", ","))


def clean_sites(raw: DataFrame) -> DataFrame:
    """Site rows with an id; UNKNOWN names and unusable or restricted coordinates are null. Adds `restricted` and `withheld`."""
    lat, lon = S.number(F.col("lat")), S.number(F.col("lon"))
    located = S.holds(lat.between(-90, 90) & lon.between(-180, 180))
    free = S.holds(F.trim("confidentialityStatus") == "F")
    name = F.trim("monitoringSiteName")
    keep = [c for c in raw.columns if c == "input_order"]
    return raw.filter(F.trim("monitoringSiteIdentifier") != "").select(
        S.normalise_country(F.col("countryCode")).alias("country"), F.trim("monitoringSiteIdentifier").alias("site_id"), F.when((name != "") & (F.upper(name) != "UNKNOWN"), name).alias("name"),
        F.when(located & free, lat).alias("lat"), F.when(located & free, lon).alias("lon"), (~free).alias("restricted"), (located & ~free).alias("withheld"), *keep,
    ).filter("country IS NOT NULL")


def merge_sites(rows: DataFrame) -> DataFrame:
    """One row per (country, site): a restricted one wins, else the first with coordinates, else the first; withheld if any was."""
    order = F.struct(~F.col("restricted"), F.col("lat").isNull(), F.col("input_order"))
    best = rows.groupBy("country", "site_id").agg(F.min_by(F.struct("name", "lat", "lon", "restricted"), order).alias("s"), F.max("withheld").alias("withheld"))
    return best.select("country", "site_id", "s.*", "withheld")


def enrich_sites(rollup: DataFrame, sites: DataFrame) -> DataFrame:
    """Rollup rows with their site's name and place; `known` is false without a site row."""
    return rollup.join(sites.withColumn("known", F.lit(True)), ["country", "site_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def site_view(sites: DataFrame) -> DataFrame:
    """Display rows of sites: the name falls back to the id; located or no-location."""
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return sites.select("country", "site_id", F.coalesce("name", "site_id").alias("name"), "lat", "lon", F.when(located, "located").otherwise("no-location").alias("location_status"))


def restricted_audit(sites: DataFrame, status: str = "status") -> DataFrame:
    """Per country and status: sites, and those that still carry coordinates though they may not."""
    leak = F.col("lat").isNotNull() & ~S.holds(F.trim(F.col(status)) == "F")
    return sites.groupBy("country", status).agg(F.count("*").alias("n_sites"), F.count_if(leak).alias("n_leaking"))


def mapped(cells: DataFrame) -> DataFrame:
    """Cells with their determinand's row; `mapped_name` only in the name's own matrix, else `unmapped_reason`. The 29 rows are broadcast."""
    dim = F.broadcast(dims.determinands(cells.sparkSession))
    out = cells.join(dim, cells["determinand"] == dim["code"], "left").drop("code")
    name = F.when((F.col("own_matrix") == F.col("matrix")) & F.col("expected_unit").isNull(), F.col("closed_name"))
    reason = F.when(name.isNull(), F.when(F.col("label").isNull(), "not in the store").when(F.col("closed_name").isNotNull(), F.coalesce("reason", F.lit("another matrix"))).otherwise(F.col("reason")))
    return out.withColumn("mapped_name", name).withColumn("unmapped_reason", reason)


def resolve_series(name: str) -> tuple[str, str] | None:
    """The (determinand, matrix) behind a name: a parameter's name its own matrix, the label of a mapped one the other matrix."""
    wanted = name.strip().lower()
    for code, _, closed, matrix, *_ in dims.DETERMINANDS:
        if closed and closed.lower() == wanted:
            return code, matrix
    for code, label, closed, matrix, *_ in dims.DETERMINANDS:
        if label.lower() == wanted:
            return code, matrix if closed is None else next(m for m in dims.MATRICES if m != matrix)
    return None


def codes_in_group(group: str) -> list[str]:
    return sorted(d[0] for d in dims.DETERMINANDS if d[7] == group)


def unit_weights(cells: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Cells and records of each unit of a series inside the windows."""
    inside = _inside(F.col("pos"), windows)
    return with_pos(cells).filter(inside).groupBy(*SERIES, "unit").agg(F.count("*").alias("n_rows"), F.sum(F.col("n") + F.col("n_below_loq")).alias("n_records"))


def _inside(pos: Column, windows: list[tuple[str, int, int]]) -> Column:
    out = F.lit(False)
    for _, a, b in windows:
        out = out | pos.between(a, b)
    return out


def unit_rules(weights: DataFrame) -> DataFrame:
    """The unit of each series (`target`) and the factor of each stored unit; a null factor leaves the unit out."""
    w = mapped(weights)
    top = W.partitionBy(*SERIES).orderBy(F.desc("n_records"), "unit")
    most = F.first("unit").over(top)
    target = F.coalesce("expected_unit", S.lookup(F.col("mapped_name"), {k: v[0] for k, v in dims.PARAMETERS.items()}), most)
    parts = S.parse_unit(F.col("unit"))
    exact = F.col("mapped_name").isNull()
    factor = F.when(exact, F.when(F.col("unit") == target, 1.0)).when(parts["basis"].eqNullSafe(F.col("basis")), S.unit_factor(parts["plain"], target) * F.col("basis_factor"))
    return w.withColumn("target", target).withColumn("factor", factor).select(*SERIES, "unit", "n_rows", "n_records", "target", "factor")


#: Months in a word of a mask.
WORD = 60


def month_mask(pos: Column, some: Column, windows: list[tuple[str, int, int]], window: Column | None = None) -> list[Column]:
    """Aggregates: the months of a window where `some` holds, as bits of as many longs as the longest window needs.

    Masks of several rows are joined by `bit_or`, so a union needs no distinct. `window` is the label of a row's window;
    without it there is one window.
    """
    first = F.lit(windows[0][1])
    if window is not None:
        for k, a, _ in windows[1:]:
            first = F.when(window == k, a).otherwise(first)
    at = pos - first
    words = -(-max(b - a + 1 for _, a, b in windows) // WORD)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (at - k * WORD).cast("int"))
    return [F.coalesce(F.bit_or(F.when(some & at.between(k * WORD, (k + 1) * WORD - 1), bit(k))), F.lit(0).cast("long")) for k in range(words)]


def mask_size(mask: Column) -> Column:
    """The months of a mask (an array of longs)."""
    return F.aggregate(mask, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def window_aggregate(cells: DataFrame, windows: list[tuple[str, int, int]], rules: DataFrame | None = None, by: tuple[str, ...] = ("site_id", "determinand", "matrix")) -> DataFrame:
    """Per site, series and window (label, first, last month): counts, sum, extremes and months with values (`month_mask`, `months`).

    Windows may overlap. A cell is dealt to its windows without a join. With `rules`, values are in
    the series' unit and cells of units without a factor are left out.
    """
    if not 0 < len(windows) <= 8:
        raise ValueError("one to eight windows")
    rows = with_pos(cells).filter(_inside(F.col("pos"), windows))
    if rules is not None:
        rows = rows.join(rules.select(*SERIES, "unit", "factor"), [*SERIES, "unit"]).filter("factor IS NOT NULL")
    else:
        rows = rows.withColumn("factor", F.lit(1.0))
    label = F.explode(F.array_compact(F.array(*[F.when(F.col("pos").between(a, b), F.lit(k)) for k, a, b in windows])))
    some = F.col("n") > 0
    return rows.withColumn("window", label).groupBy(*by, "window").agg(
        F.sum("n").alias("n"), F.sum("n_below_loq").alias("n_below_loq"), F.sum("n_lower_reliability").alias("n_lower_reliability"),
        F.sum(F.col("sum_value") * F.col("factor")).alias("total"), F.min(F.when(some, F.col("min") * F.col("factor"))).alias("low"),
        F.max(F.when(some, F.col("max") * F.col("factor"))).alias("high"), F.array(*month_mask(F.col("pos"), some, windows, F.col("window"))).alias("month_mask"),
    ).withColumn("months", mask_size(F.col("month_mask")))


def months_union(cells: DataFrame, by: tuple[str, ...] = ("country", "determinand")) -> DataFrame:
    """Months with values over all sites of a group: bits of one bitmap (32,768 months), so no task sees a group's months apart."""
    months = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("pos")))
    return with_pos(cells).filter("n > 0").groupBy(*by).agg(months.alias("n_months"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def first_identity(cells: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Country and category of each site and series' first cell inside the windows, by unit and month."""
    rows = with_pos(cells).filter(_inside(F.col("pos"), windows))
    first = rows.groupBy("site_id", *SERIES).agg(F.min(F.struct("unit", "pos", "country", "category")).alias("f"))
    return first.select("site_id", *SERIES, "f.country", "f.category")


def exact_sum(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Correctly rounded sums of doubles, the same in any order; groups without values are left out, and no group at all sums to null."""
    return exact.exact_sum(df.filter(F.col(value).isNotNull()), by, value)
