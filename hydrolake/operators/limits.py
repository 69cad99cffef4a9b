"""Limits as dated rows, overrides over them, and the limit in force for a place and a day.

A limit is a row (regime, country, parameter, effective_from, values, source): one value, or two for a range.
A null country holds for all, a null day from the beginning. Whatever reads limits reads such a table, so an
override reaches scores, comparisons and the basis that is shown alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.functions import dims
from hydrolake.functions import scalars as S

KEY = ["regime", "country", "parameter"]
SCHEMA = "regime string, country string, parameter string, effective_from string, values array<double>, source string"
#: Limit rows up to which the table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000
SATURATION = "Dissolved oxygen saturation deviation"


def limit_rows(spark: SparkSession, dated: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """The fixed limits. `dated` are drinking-water values (parameter, first day, value) instead of the fixed ones."""
    steps = [(p, d, v) for p, (d, v) in dims.DATED_LIMITS.items()] if dated is None else dated
    rows = [("drinking", None, p, None, list(dims.RANGES.get(p, (v,))), None) for p, (_, v, _) in dims.PARAMETERS.items()]
    rows += [("drinking", None, p, d, [v], None) for p, d, v in steps]
    rows += [("surface", None, p, None, [v], None) for p, v in dims.SURFACE_LIMITS.items()]
    rows += [("surface", c, p, None, [v], None) for c, own in dims.NATIONAL_LIMITS.items() for p, v in own.items()]
    rows += [("surface", c, SATURATION, None, [v], None) for c, v in dims.SATURATION_COUNTRIES.items()]
    return spark.createDataFrame(rows, SCHEMA)


def check_overrides(overrides: DataFrame) -> DataFrame:
    """Override rows (regime, country, parameter, unit, values, source) with `problem`, the first rule that a row breaks, else null.

    Regimes and parameters are the known ones; only rivers have a country, of two capital letters; the unit is
    exactly the parameter's; values are positive and finite. A river limit is one value. A drinking-water limit is
    two in order for a parameter with a range, one or two (now, and from its day on) for a dated one, else one,
    and none for a parameter that drinking water has no limit of. A source is named.
    """
    units = {k: v[0] for k, v in dims.PARAMETERS.items()} | {SATURATION: "%"}
    unit, river = S.lookup(F.col("parameter"), units), F.col("regime") == "surface"
    ranged, dated = F.col("parameter").isin(*dims.RANGES), F.col("parameter").isin(*dims.DATED_LIMITS)
    n = F.size("values")
    number = F.when(river | ~(ranged | dated), n == 1).when(ranged, n == 2).otherwise(n.between(1, 2))
    country = F.col("country").isNull() | (river & F.col("country").rlike("^[A-Z]{2}$"))
    bad = lambda c, why: F.when(~S.holds(c), F.lit(why))
    problem = F.coalesce(
        bad(F.col("regime").isin("surface", "drinking"), "regime"), bad(unit.isNotNull(), "parameter"), bad(country, "country"), bad(F.col("unit") == unit, "unit"),
        bad(river | (F.col("parameter") != SATURATION), "no-drinking-limit"), bad(number, "number-of-values"), bad(F.forall("values", lambda v: S.holds(S.finite(v) > 0)), "value"),
        bad(river | ~ranged | (F.get("values", F.lit(0)) < F.get("values", F.lit(1))), "order-of-values"), bad(F.trim("source") != "", "source"),
    )
    return overrides.withColumn("problem", problem)


def refuse_broken(overrides: DataFrame) -> None:
    """Raise if an override breaks a rule or stands twice."""
    wrong = check_overrides(overrides).filter("problem IS NOT NULL").count()
    twice = overrides.groupBy(*KEY).count().filter("count > 1").count()
    if wrong or twice:
        raise ValueError(f"{wrong} overrides break a rule, {twice} stand more than once")


def with_overrides(limits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Limit rows with overrides in their place or beside them, and their sources. Raises, and changes nothing, if one is broken.

    The first value replaces the undated row (both values do for a range), the second one the dated row.
    """
    refuse_broken(overrides)
    country = lambda df: df.withColumn("__c", F.coalesce("country", F.lit("")))
    key = ["regime", "__c", "parameter"]
    own = country(overrides).select(*key, F.col("values").alias("__v"), F.trim("source").alias("__s"))
    ranged = (F.col("regime") == "drinking") & F.col("parameter").isin(*dims.RANGES)
    undated = F.when(ranged, F.col("__v")).otherwise(F.slice("__v", 1, 1))
    later = F.when((F.size("__v") == 2) & ~ranged, F.slice("__v", 2, 1)).otherwise(F.col("values"))
    changed = country(limits).join(own, key, "left")
    values = F.when(F.col("__v").isNull(), F.col("values")).when(F.col("effective_from").isNull(), undated).otherwise(later)
    kept = changed.select(*KEY, "effective_from", values.alias("values"), F.coalesce("__s", "source").alias("source"))
    new = country(overrides).join(country(limits).select(*key).distinct(), key, "left_anti")
    return kept.unionByName(new.select(*KEY, F.lit(None).cast("string").alias("effective_from"), "values", F.trim("source").alias("source")))


def resolve(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` (parameter, regime, country, at) with `limit_value`, `is_lower`, `low_limit` and `high_limit` (of a range), `limit_source`.

    Rivers: none where hardness decides, else the country's, else that of all rivers, else the drinking-water one.
    Drinking water: the latest step whose day is not after `at`, else the undated value. The source is that of an
    override: the country's, the regime's, or that of drinking water used for a river.
    """
    spark = rows.sparkSession
    steps = F.array_sort(F.collect_list(F.struct(F.coalesce("effective_from", F.lit("")).alias("day"), "values", "source")))
    small = limits.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    grouped = limits.groupBy(*KEY).agg(steps.alias("steps"))
    of = lambda regime, name, where: grouped.filter((F.col("regime") == regime) & where)
    everywhere = F.col("country").isNull()
    drinking = hint(of("drinking", "d", everywhere).select("parameter", F.col("steps").alias("__d")))
    rivers = hint(of("surface", "r", everywhere).select("parameter", F.col("steps").alias("__r")))
    national = hint(of("surface", "n", ~everywhere).select("country", "parameter", F.col("steps").alias("__n")))
    lower = F.broadcast(dims.parameters(spark).select("parameter", "is_lower"))  # as many rows as the code names
    out = rows.join(lower, "parameter", "left").join(drinking, "parameter", "left").join(rivers, "parameter", "left").join(national, ["country", "parameter"], "left")
    in_force = lambda c: F.element_at(F.filter(c, lambda s: s["day"] <= F.coalesce("at", F.lit(""))), -1)
    undated = lambda c: F.get(F.filter(c, lambda s: s["day"] == ""), F.lit(0))
    # One value of a range stands for it where one is asked for: the parameter's own.
    single = lambda s: F.when(F.size(s["values"]) == 1, s["values"][0]).otherwise(S.lookup(F.col("parameter"), {k: v[1] for k, v in dims.PARAMETERS.items() if k in dims.RANGES}))
    out = out.withColumns({"__dn": in_force("__d"), "__du": undated("__d"), "__rn": in_force("__r"), "__nn": in_force("__n")})
    first = lambda c: F.when(F.col(c).isNotNull(), single(F.col(c)))
    river = F.when(~F.col("parameter").isin(*dims.NEEDS_HARDNESS), F.coalesce(first("__nn"), first("__rn"), first("__du")))
    surface = F.col("regime") == "surface"
    source = F.when(surface, F.coalesce(F.col("__nn.source"), F.col("__rn.source"), F.concat("__du.source", F.lit(" (drinking-water value used on a river site)")))).otherwise(F.coalesce(F.col("__dn.source"), F.col("__du.source")))
    ranged = F.size("__du.values") == 2
    return out.withColumns({
        "limit_value": F.when(surface, river).otherwise(F.coalesce(first("__dn"), first("__du"))), "limit_source": source,
        "low_limit": F.when(ranged, F.col("__du.values")[0]), "high_limit": F.when(ranged, F.col("__du.values")[1]),
    }).drop("__d", "__r", "__n", "__dn", "__du", "__rn", "__nn")


def basis(parameter: Column, regime: Column, country: Column, source: Column | None = None) -> Column:
    """Where a limit comes from; an override's `source` first."""
    national = F.lit(False)
    for c, own in dims.NATIONAL_LIMITS.items():
        national = national | ((country == c) & parameter.isin(*own))
    national = national | ((parameter == SATURATION) & country.isin(*dims.SATURATION_COUNTRIES))
    kind = F.when(parameter.isin(*dims.DRINKING_LEGAL), "legal").when(parameter.isin(*dims.DRINKING_INDICATOR), "legal indicator").otherwise("convention")
    river = F.when(S.holds(national), "national").when(parameter.isin(*dims.SURFACE_LIMITS), "legal").when(parameter.isin(*dims.NEEDS_HARDNESS), "not scored: hardness")
    own = F.when(regime == "surface", F.coalesce(river, F.when(kind == "convention", kind).otherwise(F.concat(F.lit("proxy, "), kind)))).otherwise(kind)
    return own if source is None else F.coalesce(F.concat(F.lit("override: "), source), own)
