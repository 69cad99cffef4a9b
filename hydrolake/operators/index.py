"""Water-quality index over tests, limits by place and date, and nested observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.functions import dims
from hydrolake.functions import scalars as S
from hydrolake.operators import limits as limits_
from hydrolake.operators.lineage import cut

VETO = 1.0
ECLIPSABLE = ("Excellent", "Good", "Fair")


def scored(tests: DataFrame) -> DataFrame:
    """Tests (observed, limit_value, is_lower) with `exc` and `failed`; tests without finite numbers are left out."""
    lower = F.col("is_lower")
    failed = F.when(lower, F.col("observed") < F.col("limit_value")).otherwise(F.col("observed") > F.col("limit_value"))
    return tests.withColumn("exc", S.excursion(F.col("observed"), F.col("limit_value"), lower)).filter("exc IS NOT NULL").withColumn("failed", failed)


def ccme_wqi(tests: DataFrame, by: str = "site") -> DataFrame:
    """The index per site: scope, frequency and amplitude of failures, 0 to 100."""
    t = scored(tests).groupBy(by).agg(F.countDistinct("parameter").alias("np"), F.countDistinct(F.when(F.col("failed"), F.col("parameter"))).alias("nf"), F.count("*").alias("n_tests"), F.count_if("failed").alias("n_failed"), F.sum(F.when(F.col("failed"), F.col("exc")).otherwise(0.0)).alias("e"))
    f1, f2, nse = 100.0 * F.col("nf") / F.col("np"), 100.0 * F.col("n_failed") / F.col("n_tests"), F.col("e") / F.col("n_tests")
    f3 = nse / (0.01 * nse + 0.01)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.sqrt(f1 * f1 + f2 * f2 + f3 * f3) / 1.732))
    return t.select(by, F.col("np").alias("n_parameters"), "n_tests", "n_failed", F.round(score, 6).alias("wqi")).withColumn("class", S.classify_wqi(F.col("wqi")))


def veto(tests: DataFrame, by: str = "site") -> DataFrame:
    """Per site the parameters whose worst test is beyond twice its limit, worst first, and whether the class hides them."""
    worst = scored(tests).groupBy(by, "parameter").agg(F.max("exc").alias("worst"))
    fired = F.filter(F.array_sort(F.collect_list(F.struct((-F.col("worst")).alias("k"), "parameter"))), lambda x: x["k"] <= -VETO)
    v = worst.groupBy(by).agg(F.max("worst").alias("worst_excursion"), fired.alias("fired"))
    v = v.select(by, F.round("worst_excursion", 6).alias("worst_excursion"), F.array_join(F.transform("fired", lambda x: x["parameter"].cast("string")), ",").alias("veto_parameters"))
    out = v.join(ccme_wqi(tests, by).select(by, "class"), by)
    return out.withColumn("eclipsed", (F.col("veto_parameters") != "") & F.col("class").isin(*ECLIPSABLE))


def resolve_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` (parameter, regime, country, at) with the limit in force of a table of limits (see `limits.resolve`)."""
    return limits_.resolve(rows, limits)


limit_basis = limits_.basis
check_overrides = limits_.check_overrides


def overlay_limits(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Base limits (regime, country, parameter, unit, values) with overrides (..., source) in their place, or beside them.

    Raises, and changes nothing, if an override breaks a rule (see `check_overrides`) or stands twice.
    """
    key = limits_.KEY
    limits_.refuse_broken(overrides)
    b, o = base.select(*key, "unit", F.col("values").alias("base_values")), overrides.select(*key, "unit", F.col("values").alias("own"), "source")
    same = (b["regime"] == o["regime"]) & b["country"].eqNullSafe(o["country"]) & (b["parameter"] == o["parameter"])
    basis = F.when(F.col("own").isNotNull(), F.concat(F.lit("override: "), "source"))
    return b.join(o, same, "full_outer").select(*[F.coalesce(b[k], o[k]).alias(k) for k in [*key, "unit"]], F.coalesce("own", "base_values").alias("values"), basis.alias("basis"))


def verification(limits: DataFrame, signatures: DataFrame, key: list[str]) -> DataFrame:
    """unverified without a signature; verified if the unit and every value (within 1e-9) agree; else stale.

    Limits and signatures are (key, unit, values array of one or two).
    """
    s = signatures.select(*key, F.col("unit").alias("signed_unit"), F.col("values").alias("signed_values"))
    near = F.forall(F.zip_with("values", "signed_values", lambda x, y: F.abs(x - y) <= 1e-9), lambda ok: S.holds(ok))
    fits = F.col("unit").eqNullSafe(F.col("signed_unit")) & (F.size("values") == F.size("signed_values")) & near
    return limits.join(s, key, "left").withColumn("verification", F.when(F.col("signed_values").isNull(), "unverified").when(S.holds(fits), "verified").otherwise("stale")).drop("signed_unit", "signed_values")


def pair_oxygen(rows: DataFrame) -> DataFrame:
    """Oxygen rows (site, period, kind, value, usable) with their place and period's temperature and saturation deviation.

    The state is usable, ambiguous (several temperatures), unusable or no-temperature. Both kinds of
    rows meet in one aggregation per (site, period); temperatures are kept as least, greatest and counts.
    """
    t = rows.filter(F.col("kind") == "temperature").groupBy("site", "period").agg(F.min(F.when(F.col("usable"), F.col("value"))).alias("least"), F.max(F.when(F.col("usable"), F.col("value"))).alias("most"))
    o = rows.filter(F.col("kind") == "oxygen").select("site", "period", F.col("value").alias("oxygen"))
    out = o.join(t.withColumn("seen", F.lit(True)), ["site", "period"], "left")
    state = F.when(F.col("seen").isNull(), "no-temperature").when(F.col("least").isNull(), "unusable-temperature").when(F.col("least") != F.col("most"), "ambiguous-temperature").otherwise("exact")
    return out.withColumn("state", state).withColumn("deviation", F.round(F.when(state == "exact", S.saturation_deviation(F.col("oxygen"), F.col("least"))), 6)).drop("least", "most", "seen")


def site_status(locations: DataFrame, results: DataFrame, by: str = "site") -> DataFrame:
    """Every place: its class folded to good, moderate or poor, unavailable without a result; a reason where it can't be shown."""
    fold = F.when(F.col("class").isin("Excellent", "Good"), "good").when(F.col("class") == "Fair", "moderate").when(F.col("class").isNotNull(), "poor").otherwise("unavailable")
    return locations.join(results, by, "left").withColumn("status", fold).withColumn("skipped", F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no-position"))


def location_country(places: DataFrame, overrides: dict[str, str], depth: int = 5) -> DataFrame:
    """Places (id, description, parent) with `country`: override, else the end of the description, else the nearest ancestor's.

    At most `depth` ancestors are asked; each step is an equi-join on the parent.
    """
    tail = F.expr("right(trim(description), 200)")
    code, name = F.regexp_extract(tail, r"\((?:[^()]{0,80},\s*)?([A-Z]{2})\)\s*$", 1), F.regexp_extract(tail, r"[,(]\s*(Greece|Italy|Norway)\)?\.?\s*$", 1)
    own = F.coalesce(S.lookup(F.col("id"), overrides) if overrides else F.lit(None).cast("string"), S.normalise_country(F.when(code != "", code)), S.lookup(name, {"Greece": "GR", "Italy": "IT", "Norway": "NO"}))
    known = places.select("id", "parent", own.alias("country"))
    out, up = known.withColumn("next", F.col("parent")), known.select(F.col("id").alias("next"), F.col("parent").alias("after"), F.col("country").alias("theirs"))
    for _ in range(depth):
        step = out.join(up, "next", "left")
        out = step.select("id", "parent", F.coalesce("country", "theirs").alias("country"), F.when(F.coalesce("country", "theirs").isNull(), F.col("after")).alias("next"))
    return out.drop("next")


#: Type codes of places and the regime whose limits hold there.
REGIMES = {"420531007": "surface"}


def location_regime(id_col: Column, codes: Column, overrides: dict[str, str] | None = None) -> Column:
    """The regime of a place: its override, else that of the first known one of its type codes (an array), else drinking."""
    known = F.get(F.filter(F.transform(codes, lambda c: S.lookup(c, REGIMES)), lambda r: r.isNotNull()), 0)
    return F.coalesce(S.lookup(id_col, overrides) if overrides else F.lit(None).cast("string"), known, F.lit("drinking"))


OBSERVATION = (
    "id string, resourceType string, meta struct<profile: array<string>, tag: array<struct<code: string>>>, status string, code struct<coding: array<struct<system: string, code: string, display: string>>, text: string>, subject struct<reference: string>, "
    "performer array<struct<reference: string>>, effectiveDateTime string, effectivePeriod struct<start: string, `end`: string>, valueQuantity struct<value: double, comparator: string, unit: string, system: string, code: string>, "
    "component array<struct<code: struct<coding: array<struct<system: string, code: string>>>, valueQuantity: struct<value: double, comparator: string, unit: string, system: string, code: string>>>"
)
LOCATION = "id string, name string, description string, type array<struct<coding: array<struct<code: string>>>>, position struct<latitude: double, longitude: double>, partOf struct<reference: string>"
STATISTICS = ("average", "median", "minimum", "maximum", "std-dev")


def representative(obs: DataFrame) -> DataFrame:
    """Observations with `quantity` and `quantity_reason`: the median, else the average, else the single value.

    Statistics that break min <= median, average <= max are not trusted.
    """
    coded = lambda c: F.get(F.filter(F.transform(c["code"]["coding"], lambda x: x["code"]), lambda x: x.isin(*STATISTICS)), F.lit(0))
    found = F.filter(F.transform("component", lambda c: F.struct(coded(c).alias("k"), c["valueQuantity"].alias("q"))), lambda s: s["k"].isNotNull() & s["q"].isNotNull())
    # Each statistic is looked up once, in a projection of its own.
    last = lambda k: F.try_element_at(F.filter("__s", lambda s: s["k"] == k), F.lit(-1))["q"]
    own = ("minimum", "median", "average", "maximum")
    out = obs.withColumn("__s", found).withColumns({f"__{k}": last(k) for k in own})
    exact = lambda k: F.when(F.coalesce(F.col(f"__{k}.comparator"), F.lit("")) == "", S.finite(F.col(f"__{k}.value")))
    low, mid, avg, high = map(exact, own)
    broken = S.holds(low > high) | S.holds(low > mid) | S.holds(mid > high) | S.holds(low > avg) | S.holds(avg > high)
    summary = F.coalesce(F.size("component"), F.lit(0)) > 0
    quantity = F.when(~summary, F.col("valueQuantity")).when(~broken, F.coalesce("__median", "__average"))
    reason = F.when(~summary & F.col("valueQuantity").isNull(), "no-quantity").when(summary & broken, "qc-inconsistent").when(summary & F.col("__median").isNull() & F.col("__average").isNull(), "no-representative-statistic")
    return out.withColumn("quantity", quantity).withColumn("quantity_reason", reason).drop("__s", *[f"__{k}" for k in own])


def match_parameter(code: Column) -> Column:
    """The parameter that a nested code stands for: its codes and displays, then its text."""
    names = {k.lower(): k for k in dims.PARAMETERS} | {k.lower().replace(" ", "-"): k for k in dims.PARAMETERS} | dims.ALIASES
    asked = F.concat(F.flatten(F.transform(F.coalesce(code["coding"], F.array().cast("array<struct<system: string, code: string, display: string>>")), lambda c: F.array(c["code"], c["display"]))), F.array(code["text"]))
    return F.get(F.filter(F.transform(asked, lambda x: S.lookup(F.lower(F.trim(x)), names)), lambda x: x.isNotNull()), 0)


# Names of profiles, without the short name of their guide.
WATER_PROFILES = ("observation-with-component", "observation-indicators")
HEALTH_PROFILES = ("observation-health-measure",)


def has_profile(profiles: Column, known: tuple[str, ...], guide: str = "[a-z0-9]+") -> Column:
    """Whether a profile, or the last part of its URL, is one of `known` with the guide's short name behind it."""
    pattern = f"(^|/)({'|'.join(known)})-({guide})$"
    return S.holds(F.exists(profiles, lambda p: p.rlike(pattern)))


#: A test of oxygen by how far its saturation is from 100 percent.
SATURATION = limits_.SATURATION
#: Reasons that leave an observation out for its quality; a site where they are half of what could be scored is of low confidence.
QUALITY = ("qc-inconsistent", "non-finite-value", "unit-mismatch", "physically-impossible", "no-temperature-for-saturation", "ambiguous-temperature-for-saturation", "unusable-temperature-for-saturation", "invalid-quantity")
#: Reasons before a limit is known.
UNSCORABLE = ("health-measure", "other-profile", "no-subject", "no-parameter", "interpretive-only", "surface-limit-needs-hardness")
LEAST_PARAMETERS, MOST_EXCLUDED = 4, 0.5


def with_period(obs: DataFrame) -> DataFrame:
    """`period`, what two observations must share to be of one period: the UTC interval of their times, or their text where it is none."""
    from hydrolake.operators.text import partial_time

    start, end, one = F.col("effectivePeriod.start"), F.col("effectivePeriod.end"), F.col("effectiveDateTime")
    # Each time is read once, in a projection of its own.
    out = obs.withColumn("__start", partial_time(start, "UTC")).withColumn("__end", partial_time(end, "UTC")).withColumn("__one", partial_time(one, "UTC"))
    at = lambda c, text, side: F.coalesce(F.col(c)[side].cast("string"), text)
    span = F.concat_ws("/", F.coalesce(at("__start", start, "start"), F.lit("")), F.coalesce(at("__end", end, "end"), F.lit("")))
    instant = F.concat_ws("/", at("__one", one, "start"), at("__one", one, "end"))
    return out.withColumn("period", F.when(start.isNotNull() | end.isNotNull(), span).when(one.isNotNull(), instant)).drop("__start", "__end", "__one")


def site_index(
    obs: DataFrame, locations: DataFrame, countries: dict[str, str] | None = None, regimes: dict[str, str] | None = None, limits: DataFrame | None = None, signatures: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The whole pass over nested observations: (a row for each site, observations by outcome).

    Each observation gets one reason or is a test. In countries that judge oxygen by saturation, an oxygen
    value of a river meets the temperature of its site and period, and its deviation is the test. Sites get
    index, veto and confidence; those without a test have none of them. `countries` and `regimes` override
    what places say, and `limits` (see `limits.with_overrides`) the fixed ones. With `signatures` (regime, country,
    parameter, unit, values) a site also has `limit_basis`, the basis of each tested parameter and whether its limits
    are signed. Of outcomes, `n_by_bound` counts tests that a censored value passes.
    """
    wanted = ["site", "period", "parameter", "quantity", "quantity_reason", "health", "water", "at"]
    rows = representative(obs).withColumn("parameter", match_parameter(F.col("code"))).withColumn("site", F.regexp_extract(F.col("subject.reference"), r"([^/]+)$", 1))
    rows = rows.withColumn("health", has_profile(F.col("meta.profile"), HEALTH_PROFILES)).withColumn("water", has_profile(F.col("meta.profile"), WATER_PROFILES))
    rows = with_period(rows).withColumn("at", F.coalesce(F.col("effectivePeriod.end"), F.col("effectiveDateTime"))).select(*wanted)
    codes = F.flatten(F.transform("type", lambda t: F.transform(t["coding"], lambda c: c["code"])))
    places = location_country(locations.select("id", "description", F.regexp_extract(F.col("partOf.reference"), r"([^/]+)$", 1).alias("parent")), countries or {}).select(F.col("id").alias("site"), "country")
    types = locations.select(F.col("id").alias("site"), location_regime(F.col("id"), codes, regimes).alias("regime"))
    rows = rows.join(places, "site", "left").join(types, "site", "left").withColumn("regime", F.coalesce("regime", F.lit("drinking")))
    limits = limits_.limit_rows(obs.sparkSession) if limits is None else limits
    deviations = limits.filter((F.col("parameter") == SATURATION) & (F.col("regime") == "surface") & F.col("country").isNotNull())
    deviations = deviations.select("country", F.get("values", F.lit(0)).alias("allowed"))
    rows = resolve_limits(rows, limits).join(deviations, "country", "left")
    raw, comparator = F.col("quantity.value"), F.coalesce("quantity.comparator", F.lit(""))
    unit = S.lookup(F.col("parameter"), {k: v[0] for k, v in dims.PARAMETERS.items()})
    # Temperatures and the tests read a row several times; what they read is narrow and is written down once.
    rows = cut(rows.withColumn("observed", S.convert_unit(S.finite(raw), F.col("quantity.code"), unit)).withColumn("censored", comparator != "").withColumn("comparator", comparator).withColumn("finite", raw.isNull() | S.finite(raw).isNotNull()).withColumn("number", raw.isNotNull()).drop("quantity", "at"))
    kept = F.col("water") & ~F.col("health")
    fits = S.holds(~F.col("censored") & F.col("quantity_reason").isNull() & F.col("observed").between(0, 40))
    warm = rows.filter(kept & (F.col("parameter") == "Water temperature") & F.col("period").isNotNull()).groupBy("site", "period").agg(F.min(F.when(fits, F.col("observed"))).alias("least"), F.max(F.when(fits, F.col("observed"))).alias("most"), F.lit(True).alias("seen"))
    rows = rows.join(warm, ["site", "period"], "left")
    allowed = F.col("allowed")
    by_saturation = S.holds((F.col("parameter") == "Dissolved Oxygen") & (F.col("regime") == "surface") & allowed.isNotNull())
    two_sided = F.col("parameter").isin(*dims.RANGES)
    bound = S.range_limit(F.col("observed"), F.col("low_limit"), F.col("high_limit"))
    kind = F.when(~F.col("number"), "invalid").when((by_saturation | two_sided) & F.col("censored"), "indeterminate").when(by_saturation | two_sided, "exact").otherwise(S.classify_quantity(F.col("observed"), F.col("comparator"), F.col("limit_value"), F.col("is_lower")))
    temperature = F.when(F.col("seen").isNull(), "no-temperature-for-saturation").when(F.col("least").isNull(), "unusable-temperature-for-saturation").when(F.col("least") != F.col("most"), "ambiguous-temperature-for-saturation")
    possible = S.physically_possible(F.col("parameter"), F.col("observed"))
    tropical = (F.col("regime") == "surface") & (F.col("parameter") == "Water temperature") & F.col("country").isin(*dims.TEMPERATURE_INTERPRETIVE)
    reason = F.coalesce(
        F.when(F.col("health"), "health-measure"), F.when(~F.col("water"), "other-profile"), F.when(F.coalesce("site", F.lit("")) == "", "no-subject"), F.when(F.col("parameter").isNull(), "no-parameter"),
        F.when(S.holds(tropical), "interpretive-only"), F.when(F.col("limit_value").isNull(), "surface-limit-needs-hardness"), F.col("quantity_reason"), F.when(~F.col("finite"), "non-finite-value"),
        F.when(F.col("number") & F.col("observed").isNull(), "unit-mismatch"), F.when(by_saturation & ~F.col("censored") & F.col("number") & ~possible, "physically-impossible"),
        F.when(by_saturation & (kind == "exact"), temperature), F.when(kind == "indeterminate", "indeterminate"), F.when(kind == "invalid", "invalid-quantity"), F.when(~possible, "physically-impossible"),
    )
    deviation = S.saturation_deviation(F.col("observed"), F.col("least"))
    rows = cut(rows.select(
        "site", "country", "regime", F.when(by_saturation, SATURATION).otherwise(F.col("parameter")).alias("parameter"), F.when(by_saturation, deviation).otherwise(F.col("observed")).alias("observed"),
        F.when(by_saturation, allowed).when(two_sided, bound["limit_value"]).otherwise(F.col("limit_value")).alias("limit_value"), F.when(by_saturation, False).when(two_sided, bound["is_lower"]).otherwise(F.col("is_lower")).alias("is_lower"),
        reason.alias("reason"), (kind == "pass-by-bound").alias("by_bound"), F.when(~by_saturation, F.col("limit_source")).alias("limit_source"),
    ))
    scored_ = F.col("reason").isNull()
    counts = rows.groupBy(F.coalesce("reason", F.lit("scored")).alias("reason")).agg(F.count("*").alias("n"), F.count_if(scored_ & F.col("by_bound")).alias("n_by_bound"))
    tests = rows.filter(scored_).select("site", "parameter", "observed", "limit_value", "is_lower")
    mapped = scored_ | ~F.col("reason").isin(*UNSCORABLE)
    sites = rows.filter(scored_ | ~F.col("reason").isin(*UNSCORABLE[:3])).groupBy("site").agg(F.first("country").alias("country"), F.first("regime").alias("regime"), F.count("*").alias("n_observations"), F.count_if(mapped).alias("n_scorable"), F.count_if(F.col("reason").isin(*QUALITY)).alias("n_excluded"))
    scores = sites.join(ccme_wqi(tests), "site", "left").join(veto(tests).drop("class"), "site", "left").fillna(0, ["n_parameters", "n_tests", "n_failed"])
    if signatures is not None:
        scores = scores.join(_bases(rows.filter(scored_), limits, signatures), "site", "left")
    share = F.coalesce(F.try_divide(F.col("n_excluded").cast("double"), F.col("n_scorable").cast("double")), F.lit(0.0))
    low_confidence = (F.col("n_parameters") < LEAST_PARAMETERS) | (share >= MOST_EXCLUDED)
    return scores.withColumn("excluded_share", F.round(share, 6)).withColumn("confidence", F.when(F.col("n_tests") > 0, F.when(low_confidence, "low").otherwise("normal"))), counts


def _bases(tests: DataFrame, limits: DataFrame, signatures: DataFrame) -> DataFrame:
    """(site, limit_basis): parameter -> basis and verification of the limit that a site's tests were held against."""
    units = {k: v[0] for k, v in dims.PARAMETERS.items()} | {SATURATION: "%"}
    shown = limits.groupBy(*limits_.KEY).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("effective_from", F.lit("")).alias("d"), "values"))).alias("s"))
    steps = F.flatten(F.transform("s", lambda x: x["values"]))
    filled = lambda df: df.withColumn("country", F.coalesce("country", F.lit("")))
    state = verification(filled(shown.select(*limits_.KEY, S.lookup(F.col("parameter"), units).alias("unit"), steps.alias("values"))), filled(signatures), limits_.KEY)
    state = state.select(F.col("regime").alias("r"), F.col("country").alias("c"), "parameter", "verification")
    used = tests.select("site", "regime", F.coalesce("country", F.lit("")).alias("country"), "parameter", "limit_source").distinct()
    # The limit in force stands under the country, under all rivers or under drinking water, in that order.
    river = F.col("regime") == "surface"
    places = F.when(river, F.array(F.struct(F.lit(1).alias("k"), F.lit("surface").alias("r"), F.col("country").alias("c")), F.struct(F.lit(2).alias("k"), F.lit("surface").alias("r"), F.lit("").alias("c")), F.struct(F.lit(3).alias("k"), F.lit("drinking").alias("r"), F.lit("").alias("c"))))
    places = places.otherwise(F.array(F.struct(F.lit(1).alias("k"), F.lit("drinking").alias("r"), F.lit("").alias("c"))))
    asked = used.withColumn("p", F.explode(F.array_distinct(places))).select(*used.columns, "p.*").join(state, ["r", "c", "parameter"])
    first = asked.groupBy(*used.columns).agg(F.min_by("verification", "k").alias("verification"))
    text = F.concat(limit_basis(F.col("parameter"), F.col("regime"), F.nullif("country", F.lit("")), F.col("limit_source")), F.lit("; "), F.col("verification"))
    return first.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", text.alias("basis"))))).alias("limit_basis"))
