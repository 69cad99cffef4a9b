"""Queries over indices, limits, censored values and ecology."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolake.functions import dims
from hydrolake.functions import scalars as S
from hydrolake.operators import censored as C
from hydrolake.operators import ecology as E
from hydrolake.operators import index as I
from hydrolake.operators import limits as L
from hydrolake.operators.order import medians
from hydrolake.plans.registry import Tables, query
from hydrolake.plans.views import EU, NATIONAL, PARAMETERS, select

TESTS = ["l_suppkey AS site", "l_linenumber AS parameter", "l_quantity AS observed", "CASE WHEN l_linenumber = 2 THEN 40.0 ELSE 46.0 - l_linenumber * 6.0 END AS limit_value", "l_linenumber = 2 AS is_lower"]
EXC = "CASE WHEN is_lower THEN CASE WHEN observed >= limit_value THEN 0.0 WHEN observed <= 0 THEN 999.0 ELSE limit_value / observed - 1 END ELSE CASE WHEN observed <= limit_value THEN 0.0 WHEN limit_value <= 0 THEN 999.0 ELSE observed / limit_value - 1 END END"
CLASS = "CASE WHEN wqi >= 95 THEN 'Excellent' WHEN wqi >= 80 THEN 'Good' WHEN wqi >= 65 THEN 'Fair' WHEN wqi >= 45 THEN 'Marginal' ELSE 'Poor' END"
SCORED = f"""scored AS (SELECT *, {EXC} AS exc, CASE WHEN is_lower THEN observed < limit_value ELSE observed > limit_value END AS failed FROM {select(TESTS, "lineitem")}),
s AS (SELECT site, count(DISTINCT parameter) AS n_parameters, count(*) AS n_tests, count(*) FILTER (WHERE failed) AS n_failed, 100.0 * count(DISTINCT CASE WHEN failed THEN parameter END) / count(DISTINCT parameter) AS f1, 100.0 * count(*) FILTER (WHERE failed) / count(*) AS f2, sum(CASE WHEN failed THEN exc ELSE 0 END) / count(*) AS nse FROM scored GROUP BY 1),
wqi AS (SELECT site, n_parameters, n_tests, n_failed, round(greatest(0, least(100, 100 - sqrt(f1 * f1 + f2 * f2 + (nse / (0.01 * nse + 0.01)) ** 2) / 1.732)), 6) AS wqi FROM s),
classed AS (SELECT *, {CLASS} AS class FROM wqi)"""


@query(f"WITH {SCORED} SELECT * FROM classed")
def a24_ccme_wqi(t: Tables):
    return I.ccme_wqi(t.view("lineitem", TESTS))


@query(f"""WITH {SCORED}, w AS (SELECT site, parameter, max(exc) AS worst FROM scored GROUP BY 1, 2), v AS (SELECT site, round(max(worst), 6) AS worst_excursion, coalesce(string_agg(CAST(parameter AS VARCHAR), ',' ORDER BY worst DESC, parameter) FILTER (WHERE worst >= 1.0), '') AS veto_parameters FROM w GROUP BY 1)
SELECT v.*, class, veto_parameters <> '' AND class IN ('Excellent', 'Good', 'Fair') AS eclipsed FROM v JOIN classed USING (site)""")
def a25_veto(t: Tables):
    return I.veto(t.view("lineitem", TESTS))


@query(f"SELECT site, parameter, observed, limit_value, round({EXC}, 6) AS excursion FROM {select(TESTS, 'lineitem')}")
def f3_excursion(t: Tables):
    rows = t.view("lineitem", TESTS)
    return rows.select("site", "parameter", "observed", "limit_value", F.round(S.excursion(F.col("observed"), F.col("limit_value"), F.col("is_lower")), 6).alias("excursion"))


NAMES = list(dims.PARAMETERS)
PICK = "CASE l_partkey % 19 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END AS parameter"
PLACED = ["l_orderkey AS id", "l_linenumber AS line", PICK, "CASE WHEN l_suppkey % 2 = 0 THEN 'surface' ELSE 'drinking' END AS regime", "CASE l_suppkey % 4 WHEN 0 THEN 'IT' WHEN 1 THEN 'GR' WHEN 2 THEN 'NO' END AS country", "CAST(CAST(l_shipdate AS DATE) AS STRING) AS at", "l_quantity AS observed"]
STEPS = [("Lead dissolved", "1998-01-01", 7.0), ("Lead dissolved", "2000-06-15", 5.0), ("Nitrate", "1999-03-01", 40.0)]
DATED = dims.values(STEPS, "dated", ("parameter", "effective_from", "value"))
RESOLVED = f"""resolved AS (SELECT p.*, par.is_lower, CASE WHEN regime = 'surface' THEN CASE WHEN p.parameter <> 'Cadmium dissolved' THEN coalesce(nat.value, eu.value, par.limit_value) END
  ELSE coalesce((SELECT arg_max(value, effective_from) FROM {DATED} WHERE dated.parameter = p.parameter AND effective_from <= p.at), par.limit_value) END AS limit_value
  FROM {select(PLACED, "lineitem")} p LEFT JOIN {PARAMETERS} ON par.parameter = p.parameter LEFT JOIN {NATIONAL} ON nat.country = p.country AND nat.parameter = p.parameter LEFT JOIN {EU} ON eu.parameter = p.parameter)"""


def resolved(t: Tables):
    return L.resolve(t.view("lineitem", PLACED), L.limit_rows(t.spark, STEPS)).drop("low_limit", "high_limit", "limit_source")


@query(f"WITH {RESOLVED} SELECT parameter, regime, country, is_lower, round(limit_value, 9) AS limit_value, count(*) AS n FROM resolved GROUP BY ALL")
def j6_resolve_limit(t: Tables):
    return resolved(t).groupBy("parameter", "regime", "country", "is_lower", F.round("limit_value", 9).alias("limit_value")).agg(F.count("*").alias("n"))


POSSIBLE = "CASE WHEN parameter = 'pH' THEN observed BETWEEN 0 AND 14 WHEN parameter = 'Water temperature' THEN true ELSE observed >= 0 END"


@query(f"WITH {RESOLVED} SELECT parameter, regime, CASE WHEN NOT ({POSSIBLE}) THEN 'excluded' WHEN limit_value IS NULL THEN 'not-scored' WHEN CASE WHEN is_lower THEN observed >= limit_value ELSE observed <= limit_value END THEN 'within-limit' ELSE 'exceeds-limit' END AS status, count(*) AS n FROM resolved GROUP BY ALL")
def f8_measurement_record(t: Tables):
    possible = S.physically_possible(F.col("parameter"), F.col("observed"))
    status = F.when(~possible, "excluded").otherwise(S.assess(F.col("observed"), F.col("limit_value"), F.col("is_lower")))
    return resolved(t).groupBy("parameter", "regime", status.alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT parameter, {POSSIBLE} AS possible, count(*) AS n FROM {select(PLACED, 'lineitem')} GROUP BY ALL")
def f5_physically_possible(t: Tables):
    return t.view("lineitem", PLACED).groupBy("parameter", S.physically_possible(F.col("parameter"), F.col("observed")).alias("possible")).agg(F.count("*").alias("n"))


def _basis() -> str:
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    kind = f"CASE WHEN parameter IN ({quote(dims.DRINKING_LEGAL)}) THEN 'legal' WHEN parameter IN ({quote(dims.DRINKING_INDICATOR)}) THEN 'legal indicator' ELSE 'convention' END"
    own = " OR ".join(f"(country = '{c}' AND parameter IN ({quote(p)}))" for c, p in dims.NATIONAL_LIMITS.items())
    return f"CASE WHEN regime = 'surface' THEN CASE WHEN {own} THEN 'national' WHEN parameter IN ({quote(dims.SURFACE_LIMITS)}) THEN 'legal' WHEN parameter = 'Cadmium dissolved' THEN 'not scored: hardness' WHEN {kind} = 'convention' THEN 'convention' ELSE 'proxy, ' || {kind} END ELSE {kind} END"


@query(f"SELECT parameter, regime, country, {_basis()} AS basis, count(*) AS n FROM {select(PLACED, 'lineitem')} GROUP BY ALL")
def f10_limit_basis(t: Tables):
    return t.view("lineitem", PLACED).groupBy("parameter", "regime", "country", I.limit_basis(F.col("parameter"), F.col("regime"), F.col("country")).alias("basis")).agg(F.count("*").alias("n"))


BASE = ["CASE WHEN p_partkey % 2 = 0 THEN 'surface' ELSE 'drinking' END AS regime", "CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'IT' ELSE 'GR' END END AS country", PICK.replace("l_partkey", "p_partkey"), "p_retailprice AS limit_value"]
OVER = "p_size > 20 AND p_brand < 'Brand#3'"


def limits(t: Tables, where: str | None = None):
    """A limit for each key, two values for pH in drinking water."""
    unit = S.lookup(F.col("parameter"), {k: v[0] for k, v in dims.PARAMETERS.items()})
    rows = t.view("part", BASE, where).groupBy("regime", "country", "parameter").agg(F.min("limit_value").alias("lo"), F.max("limit_value").alias("hi"))
    values = F.when((F.col("parameter") == "pH") & (F.col("regime") == "drinking"), F.array("lo", F.col("hi") + 1)).otherwise(F.array("lo"))
    return rows.select("regime", "country", "parameter", unit.alias("unit"), values.alias("values"))


def limits_sql(where: str | None = None) -> str:
    return f"(SELECT regime, country, g.parameter, par.unit, CASE WHEN g.parameter = 'pH' AND regime = 'drinking' THEN [lo, hi + 1] ELSE [lo] END AS values FROM (SELECT regime, country, parameter, min(limit_value) AS lo, max(limit_value) AS hi FROM {select(BASE, 'part', where)} GROUP BY 1, 2, 3) g LEFT JOIN {PARAMETERS} ON par.parameter = g.parameter)"


@query(f"""WITH b AS {limits_sql()}, o AS {limits_sql(OVER)}
SELECT coalesce(b.regime, o.regime) AS regime, coalesce(b.country, o.country) AS country, coalesce(b.parameter, o.parameter) AS parameter, coalesce(b.unit, o.unit) AS unit, coalesce(o.values, b.values) AS values, CASE WHEN o.values IS NOT NULL THEN 'override: own source' END AS basis FROM b FULL JOIN o ON b.regime = o.regime AND b.country IS NOT DISTINCT FROM o.country AND b.parameter = o.parameter""", lists=("values",))
def j7_overlay_limits(t: Tables):
    return I.overlay_limits(limits(t), limits(t, OVER).withColumn("source", F.lit("own source")))


BROKEN = [
    "p_partkey AS id", "CASE WHEN p_partkey % 10 = 1 THEN 'ground' WHEN p_partkey % 2 = 0 THEN 'surface' ELSE 'drinking' END AS regime", "CASE WHEN p_partkey % 10 = 2 THEN 'Italy' WHEN p_partkey % 10 = 3 THEN 'IT' WHEN p_partkey % 4 = 0 THEN 'GR' END AS country",
    "CASE p_partkey % 3 WHEN 0 THEN 'Nitrate' WHEN 1 THEN 'pH' ELSE 'Gold' END AS parameter", "CASE WHEN p_partkey % 3 = 1 THEN 'pH' WHEN p_partkey % 14 = 0 THEN 'ug/L' ELSE 'mg/L' END AS unit", "CAST(p_size - 5 AS DOUBLE) AS low", "CAST(p_size % 17 AS DOUBLE) AS high", "CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE 'text' END AS source",
]


@query(f"""WITH o AS (SELECT *, CASE WHEN parameter = 'pH' AND id % 5 > 0 OR id % 7 = 0 THEN [low, high] ELSE [low] END AS v, CASE WHEN regime = 'surface' THEN [1] WHEN parameter = 'pH' THEN [2] ELSE [1] END AS wanted FROM {select(BROKEN, "part")})
SELECT CASE WHEN regime NOT IN ('surface', 'drinking') THEN 'regime' WHEN parameter NOT IN ('pH', 'Nitrate') THEN 'parameter' WHEN country IS NOT NULL AND NOT (regime = 'surface' AND regexp_matches(country, '^[A-Z]{{2}}$')) THEN 'country' WHEN unit <> CASE parameter WHEN 'pH' THEN 'pH' ELSE 'mg/L' END THEN 'unit'
  WHEN NOT list_contains(wanted, len(v)) THEN 'number-of-values' WHEN len(list_filter(v, lambda x: x <= 0)) > 0 THEN 'value' WHEN regime = 'drinking' AND len(v) = 2 AND v[1] >= v[2] THEN 'order-of-values' WHEN trim(source) = '' THEN 'source' END AS problem, count(*) AS n FROM o GROUP BY 1""")
def j7_override_problems(t: Tables):
    rows = t.view("part", BROKEN).withColumn("values", F.when((F.col("parameter") == "pH") & (F.col("id") % 5 > 0) | (F.col("id") % 7 == 0), F.array("low", "high")).otherwise(F.array("low")))
    return I.check_overrides(rows).groupBy("problem").agg(F.count("*").alias("n"))


#: Overrides of a run: a national one, one of all rivers, two steps of a dated limit, a range.
RUN = [
    ("surface", "IT", "Nitrate", "mg/L", [20.0], "own study"), ("surface", None, "Lead dissolved", "ug/L", [30.0], "permit"),
    ("drinking", None, "Lead dissolved", "ug/L", [45.0, 15.0], "plan"), ("drinking", None, "pH", "pH", [3.0, 44.0], "plant"), ("drinking", None, "Sulphate", "mg/L", [12.0], "plant"),
]
RUN_TEXT = "CASE WHEN regime = 'surface' THEN CASE WHEN country = 'IT' AND parameter = 'Nitrate' THEN 'own study' WHEN parameter = 'Lead dissolved' THEN 'permit' WHEN parameter IN ('pH', 'Sulphate') THEN 'plant (drinking-water value used on a river site)' END ELSE CASE parameter WHEN 'Lead dissolved' THEN 'plan' WHEN 'pH' THEN 'plant' WHEN 'Sulphate' THEN 'plant' END END"
RUN_VALUE = "CASE WHEN regime = 'surface' THEN CASE WHEN country = 'IT' AND parameter = 'Nitrate' THEN 20.0 WHEN parameter = 'Lead dissolved' THEN 30.0 WHEN parameter = 'Sulphate' THEN 12.0 ELSE limit_value END ELSE CASE parameter WHEN 'Lead dissolved' THEN CASE WHEN plain.at >= '1996-01-01' THEN 15.0 ELSE 45.0 END WHEN 'Sulphate' THEN 12.0 ELSE limit_value END END"
OVERRIDDEN = f"""plain AS (SELECT p.*, p.id % 200 AS site, par.is_lower, CASE WHEN regime = 'surface' THEN CASE WHEN p.parameter <> 'Cadmium dissolved' THEN coalesce(nat.value, eu.value, par.limit_value) END WHEN p.parameter = 'Lead dissolved' AND p.at >= '1996-01-01' THEN 5.0 ELSE par.limit_value END AS limit_value
  FROM {select(PLACED, "lineitem")} p LEFT JOIN {PARAMETERS} ON par.parameter = p.parameter LEFT JOIN {NATIONAL} ON nat.country = p.country AND nat.parameter = p.parameter LEFT JOIN {EU} ON eu.parameter = p.parameter),
both_ AS (SELECT *, {RUN_VALUE} AS new_value, {RUN_TEXT} AS limit_source FROM plain),
sided AS (SELECT *, CASE WHEN parameter = 'pH' THEN CASE WHEN observed < 6.5 THEN 6.5 ELSE 9.5 END ELSE limit_value END AS v0, CASE WHEN parameter = 'pH' THEN observed < 6.5 ELSE is_lower END AS l0, CASE WHEN parameter = 'pH' THEN CASE WHEN observed < 3.0 THEN 3.0 ELSE 44.0 END ELSE new_value END AS v1, CASE WHEN parameter = 'pH' THEN observed < 3.0 ELSE is_lower END AS l1 FROM both_ WHERE limit_value IS NOT NULL)"""


def _index_sql(k: int) -> str:
    tests = f"(SELECT site, parameter, observed, v{k} AS limit_value, l{k} AS is_lower FROM sided)"
    return SCORED.replace(select(TESTS, "lineitem"), tests).replace("scored", f"scored{k}").replace("FROM s)", f"FROM s{k})").replace("\ns AS", f"\ns{k} AS").replace("wqi AS (SELECT site", f"wqi{k} AS (SELECT site").replace("FROM wqi)", f"FROM wqi{k})").replace("classed AS", f"classed{k} AS")


def overridden(t: Tables):
    fixed = L.limit_rows(t.spark, [("Lead dissolved", "1996-01-01", 5.0)])
    wanted = t.spark.createDataFrame(RUN, "regime string, country string, parameter string, unit string, values array<double>, source string")
    rows = t.view("lineitem", PLACED).withColumn("site", F.col("id") % 200)
    return rows, fixed, L.with_overrides(fixed, wanted)


@query(f"""WITH {OVERRIDDEN}, {_index_sql(0)}, {_index_sql(1)} SELECT site, a.n_failed, b.n_failed AS n_failed_override, a.wqi, b.wqi AS wqi_override, b.class AS class_override FROM classed0 a JOIN classed1 b USING (site)""")
def j7_overrides_change_index(t: Tables):
    """Sites' indices under the fixed limits and under a run's overrides."""
    rows, fixed, changed = overridden(t)

    def index(limits):
        found = L.resolve(rows, limits).filter("limit_value IS NOT NULL")
        ranged = F.col("low_limit").isNotNull()
        side = S.range_limit(F.col("observed"), F.col("low_limit"), F.col("high_limit"))
        return I.ccme_wqi(found.withColumns({"limit_value": F.when(ranged, side["limit_value"]).otherwise(F.col("limit_value")), "is_lower": F.when(ranged, side["is_lower"]).otherwise(F.col("is_lower"))}))

    new = index(changed).select("site", F.col("n_failed").alias("n_failed_override"), F.col("wqi").alias("wqi_override"), F.col("class").alias("class_override"))
    return index(fixed).select("site", "n_failed", "wqi").join(new, "site")


@query(f"WITH {OVERRIDDEN} SELECT parameter, regime, country, round(new_value, 9) AS limit_value, coalesce('override: ' || limit_source, {_basis()}) AS basis, count(*) AS n FROM both_ WHERE parameter <> 'pH' GROUP BY ALL")
def f10_basis_of_overrides(t: Tables):
    """What is shown as the basis of each limit in force under a run's overrides."""
    rows, _, changed = overridden(t)
    text = L.basis(F.col("parameter"), F.col("regime"), F.col("country"), F.col("limit_source"))
    return L.resolve(rows, changed).filter("parameter <> 'pH'").groupBy("parameter", "regime", "country", F.round("limit_value", 9).alias("limit_value"), text.alias("basis")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN [p_retailprice, p_retailprice + 1] ELSE [p_retailprice] END AS v FROM part), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'g/L' ELSE 'mg/L' END AS unit, CASE WHEN p_partkey % 8 = 0 THEN [p_retailprice, p_retailprice + CASE WHEN p_size > 25 THEN 1 ELSE 1.1 END] WHEN p_size > 25 THEN [p_retailprice] ELSE [p_retailprice + 0.1] END AS v FROM part WHERE p_partkey % 3 <> 0)
SELECT a.id, CASE WHEN b.id IS NULL THEN 'unverified' WHEN b.unit = 'mg/L' AND len(a.v) = len(b.v) AND len(list_filter(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2]) > 1e-9)) = 0 THEN 'verified' ELSE 'stale' END AS verification FROM a LEFT JOIN b ON a.id = b.id""")
def j8_verification_status(t: Tables):
    price, large = F.col("p_retailprice"), F.col("p_size") > 25
    own = t.part.select(F.col("p_partkey").alias("id"), F.lit("mg/L").alias("unit"), F.when(F.col("p_partkey") % 4 == 0, F.array(price, price + 1)).otherwise(F.array(price)).alias("values"))
    signed = F.when(F.col("p_partkey") % 8 == 0, F.array(price, price + F.when(large, 1.0).otherwise(1.1))).when(large, F.array(price)).otherwise(F.array(price + 0.1))
    signatures = t.part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, "g/L").otherwise("mg/L").alias("unit"), signed.alias("values"))
    return I.verification(own, signatures, ["id"]).select("id", "verification")


OXYGEN = ["user_id AS site", "CAST(ts AS DATE) AS period", "CASE event_type WHEN 'view' THEN 'oxygen' WHEN 'click' THEN 'temperature' WHEN 'signup' THEN 'temperature' ELSE 'other' END AS kind", "CASE WHEN event_type = 'view' THEN value / 10 ELSE floor(value / 4) END AS value", "value < 160 AS usable"]


@query(f"""WITH r AS {select(OXYGEN, "events")}, t AS (SELECT site, period, min(value) FILTER (WHERE usable) AS lo, max(value) FILTER (WHERE usable) AS hi FROM r WHERE kind = 'temperature' GROUP BY 1, 2),
x AS (SELECT o.site, o.period, o.value AS oxygen, CASE WHEN t.site IS NULL THEN 'no-temperature' WHEN lo IS NULL THEN 'unusable-temperature' WHEN lo <> hi THEN 'ambiguous-temperature' ELSE 'exact' END AS state, lo + 273.15 AS k FROM r o LEFT JOIN t ON o.site = t.site AND o.period = t.period WHERE o.kind = 'oxygen')
SELECT site, CAST(period AS VARCHAR) AS period, oxygen, state, round(CASE WHEN state = 'exact' AND k BETWEEN 273.15 AND 313.15 THEN abs(100 - 100 * oxygen / exp(-139.34411 + 1.575701e5 / k - 6.642308e7 / (k * k) + 1.243800e10 / (k * k * k) - 8.621949e11 / (k * k * k * k))) END, 6) AS deviation FROM x""")
def j9_pair_oxygen(t: Tables):
    return I.pair_oxygen(t.view("events", OXYGEN)).withColumn("period", F.col("period").cast("string"))


@query("SELECT user_id, round(value, 2) AS celsius, round(exp(-139.34411 + 1.575701e5 / k - 6.642308e7 / (k * k) + 1.243800e10 / (k * k * k) - 8.621949e11 / (k * k * k * k)), 6) AS saturation FROM (SELECT user_id, value, value + 273.15 AS k FROM events WHERE value <= 40)")
def f7_oxygen_saturation(t: Tables):
    return t.events.filter("value <= 40").select("user_id", F.round("value", 2).alias("celsius"), F.round(S.oxygen_saturation(F.col("value")), 6).alias("saturation"))


@query(f"""WITH {SCORED} SELECT s_suppkey AS site, s_acctbal AS lat, CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS lon, n_parameters, n_tests, n_failed, wqi, class, CASE WHEN class IN ('Excellent', 'Good') THEN 'good' WHEN class = 'Fair' THEN 'moderate' WHEN class IS NOT NULL THEN 'poor' ELSE 'unavailable' END AS status, CASE WHEN s_nationkey = 3 THEN 'no-position' END AS skipped
FROM supplier LEFT JOIN (SELECT * FROM classed WHERE site % 7 <> 0) c ON c.site = s_suppkey""")
def j10_site_status(t: Tables):
    places = t.view("supplier", ["s_suppkey AS site", "s_acctbal AS lat", "CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS lon"])
    return I.site_status(places, I.ccme_wqi(t.view("lineitem", TESTS)).filter("site % 7 <> 0"))


PLACES = ["c_custkey AS id", "CASE WHEN c_custkey % 11 = 0 THEN 'River of X (Campania, IT)' WHEN c_custkey % 11 = 1 THEN 'Spring, Greece.' WHEN c_custkey % 11 = 2 THEN 'Y (EL)' WHEN c_custkey % 11 = 3 THEN 'Z (FR)' ELSE c_name END AS description", "CASE WHEN c_custkey % 13 <> 0 THEN c_custkey - c_custkey % 13 + (c_custkey % 13) / 2 END AS parent"]
PLACES[2] = "CASE WHEN c_custkey % 13 <> 0 THEN c_custkey - 1 END AS parent"


@query(f"""WITH RECURSIVE p AS (SELECT id, parent, CASE id WHEN 5 THEN 'NO' ELSE coalesce({"CASE nullif(regexp_extract(right(description, 200), '[(](?:[^()]{0,80},[ ]*)?([A-Z]{2})[)][ ]*$', 1), '') WHEN 'IT' THEN 'IT' WHEN 'GR' THEN 'GR' WHEN 'EL' THEN 'GR' WHEN 'NO' THEN 'NO' END"}, CASE regexp_extract(right(description, 200), '[,(][ ]*(Greece|Italy|Norway)[)]?[.]?[ ]*$', 1) WHEN 'Greece' THEN 'GR' WHEN 'Italy' THEN 'IT' WHEN 'Norway' THEN 'NO' END) END AS country FROM {select(PLACES, "customer")}),
up AS (SELECT id, parent AS first, parent AS next, country, 0 AS d FROM p UNION ALL SELECT up.id, up.first, p.parent, p.country, d + 1 FROM up JOIN p ON p.id = up.next WHERE up.country IS NULL AND d < 5)
SELECT id, any_value(first) AS parent, max(country) AS country FROM up GROUP BY id""")
def j12_location_country(t: Tables):
    return I.location_country(t.view("customer", PLACES), {5: "NO"})


CODED = ["c_custkey AS id", "CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 3 = 1 THEN array('288520005', '420531007') ELSE array('288520005') END AS codes"]


@query("SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'surface' WHEN c_custkey = 8 THEN 'drinking' WHEN c_nationkey % 3 = 1 THEN 'surface' ELSE 'drinking' END AS regime FROM customer")
def j12_location_regime(t: Tables):
    return t.view("customer", CODED).select("id", I.location_regime(F.col("id"), F.col("codes"), {7: "surface", 8: "drinking"}).alias("regime"))


@query("""WITH c AS (SELECT l_suppkey AS sample, l_partkey % 40 AS taxon, sum(CASE WHEN l_linenumber = 7 THEN 0 WHEN l_quantity < 10 THEN 1 ELSE floor(l_quantity / 10) END)::DOUBLE AS c FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1, 2),
p AS (SELECT sample, c, sum(c) OVER (PARTITION BY sample) AS t FROM c WHERE c > 0), g AS (SELECT sample, count(*) AS richness, -sum(c / t * ln(c / t)) AS h, 1 - sum((c / t) ** 2) AS simpson, count(*) FILTER (WHERE c = 1) AS f1, count(*) FILTER (WHERE c = 2) AS f2 FROM p GROUP BY 1)
SELECT sample, richness, round(h, 6) AS shannon, round(simpson, 6) AS simpson, round(CASE WHEN richness >= 2 THEN h / ln(richness) END, 6) AS pielou, round(richness + f1 * (f1 - 1) / (2.0 * (f2 + 1)), 6) AS chao1 FROM g""")
def a27_diversity(t: Tables):
    rows = t.view("lineitem", ["l_suppkey AS sample", "l_partkey % 40 AS taxon", "CASE WHEN l_linenumber = 7 THEN 0 WHEN l_quantity < 10 THEN 1 ELSE floor(l_quantity / 10) END AS n"], "l_partkey % 3 = 0")
    return E.diversity(rows, "sample", "taxon", "n")


FAMILIES = ["l_suppkey AS sample", "'F' || CAST(l_partkey % 60 AS STRING) AS family", "CASE l_partkey % 5 WHEN 0 THEN 'Ephemeroptera' WHEN 1 THEN 'Plecoptera' WHEN 2 THEN 'Trichoptera' WHEN 3 THEN 'Diptera' ELSE 'Odonata' END AS `order`"]
FAMILIES_SQL = select(FAMILIES, "lineitem", "l_quantity > 40").replace("`order`", '"order"')


@query(f"""WITH f AS (SELECT DISTINCT * FROM {FAMILIES_SQL}), s AS (SELECT DISTINCT 'F' || CAST(p_partkey % 60 AS VARCHAR) AS family, (p_partkey % 60) % 10 + 1 AS score FROM part WHERE p_partkey % 60 < 50)
SELECT sample, sum(score)::BIGINT AS bmwp, round(sum(score) / nullif(count(score), 0), 6) AS aspt, round(count(*) FILTER (WHERE "order" IN ('Ephemeroptera', 'Plecoptera', 'Trichoptera')) / count(*), 6) AS ept_ratio FROM f LEFT JOIN s USING (family) GROUP BY 1""")
def a28_biotic(t: Tables):
    scores = t.view("part", ["'F' || CAST(p_partkey % 60 AS STRING) AS family", "p_partkey % 60 % 10 + 1 AS score"], "p_partkey % 60 < 50").distinct()
    return E.biotic(t.view("lineitem", FAMILIES, "l_quantity > 40"), scores, "sample")


CENSORED = ["l_suppkey AS site", "CASE WHEN l_linestatus = 'O' AND l_quantity < 20 THEN 10.0 * ceil(l_quantity / 10) ELSE l_quantity END AS value", "l_linestatus = 'O' AND l_quantity < 20 AS censored"]
KM = f"""per AS (SELECT site, value AS v, count(*) AS n, count(*) FILTER (WHERE NOT censored) AS d FROM {select(CENSORED, "lineitem")} GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN v = min(v) OVER (PARTITION BY site) THEN n ELSE d END AS e, sum(n) OVER (PARTITION BY site ORDER BY v) AS risk, max(v) OVER (PARTITION BY site) AS top, min(v) OVER (PARTITION BY site) AS bottom FROM per),
s AS (SELECT *, list_reduce(list_prepend(1.0::DOUBLE, list(1.0 - e / risk) OVER (PARTITION BY site ORDER BY v DESC)), lambda a, b: a * b) AS s FROM r WHERE e > 0),
g AS (SELECT *, coalesce(lag(s) OVER w, 1.0) AS before, coalesce(lag(v) OVER w, top) AS prev, lead(v) OVER w AS following FROM s WINDOW w AS (PARTITION BY site ORDER BY v DESC)),
km AS (SELECT site, round(max(top) - sum(before * (prev - v)), 6) AS km_mean, round(arg_max(CASE WHEN abs(s - 0.5) <= 1e-9 AND following IS NOT NULL THEN (v + following) / 2 ELSE v END, v) FILTER (WHERE s <= 0.5 + 1e-9), 6) AS km_median FROM g GROUP BY 1)"""


@query(f"WITH {KM} SELECT k.*, t.n, t.n_censored, t.smallest_censored FROM km k JOIN (SELECT site, sum(n)::BIGINT AS n, (sum(n) - sum(d))::BIGINT AS n_censored, bool_or(v = bottom AND d < n) AS smallest_censored FROM r GROUP BY 1 HAVING sum(d) > 0) t USING (site)")
def a29_km_left_censored(t: Tables):
    return C.kaplan_meier(t.view("lineitem", CENSORED), "site", "value", "censored")


@query("SELECT l_returnflag AS flag, median(l_extendedprice * (1 - l_discount)) AS median FROM lineitem GROUP BY 1")
def a12_medians_by_digits(t: Tables):
    """Medians of groups that hold a third of all rows each, found digit by digit."""
    return medians(t.view("lineitem", ["l_returnflag AS flag", "l_extendedprice * (1 - l_discount) AS v"]), ["flag"], "v", large=1000)


@query()
def a30_ros_left_censored(t: Tables):
    return C.ros(t.view("lineitem", CENSORED), "site", "value", "censored")


@query()
def a31_summarize_censored(t: Tables):
    return C.summarize(t.view("lineitem", CENSORED), "site", "value", "censored")


REACH = ["l_orderkey AS id", "l_linenumber AS line", "l_quantity AS km", "0.00001 * l_linenumber AS k", "0.2 + l_discount AS u", "l_tax * 100 AS d"]


@query(f"""SELECT id, line, round(1000 * 2 * k / (u + sqrt(u * u + 4 * k * d)), 9) AS decay_rate, round(exp(-1000 * 2 * k / (u + sqrt(u * u + 4 * k * d)) * km), 9) AS steady_ratio, round(exp(-(1000 * k / u - 1000 * 2 * k / (u + sqrt(u * u + 4 * k * d))) * km) - 1, 9) AS proxy_error, round(0.05 / 1000 * u * 86400, 9) AS implied_per_day FROM {select(REACH, "lineitem")}""")
def f18_reach_decay(t: Tables):
    rows = t.view("lineitem", REACH).withColumns({c: F.col(c).cast("double") for c in ("k", "u", "d")})
    form = E.reach(F.col("km"), F.col("k"), F.col("u"), F.col("d"), F.lit(0.05))
    return rows.select("id", "line", *[F.round(form[c], 9).alias(c) for c in ("decay_rate", "steady_ratio", "proxy_error", "implied_per_day")])
