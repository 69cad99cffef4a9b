"""Views that play the domain's tables with the given ones, as expressions that Spark and DuckDB both read."""

from __future__ import annotations

from hydrolake.functions import dims
from hydrolake.operators.lineage import spread
from hydrolake.plans.registry import Tables


def select(exprs: list[str], table: str, where: str | None = None) -> str:
    return f"(SELECT {', '.join(exprs)} FROM {table}" + (f" WHERE {where}" if where else "") + ")"


COUNTRY = "CASE {k} % 5 WHEN 0 THEN 'IT' WHEN 1 THEN 'EL' WHEN 2 THEN 'NO' WHEN 3 THEN 'gr ' ELSE 'FR' END"
MEASUREMENTS = [
    f"{COUNTRY.format(k='l_suppkey')} AS countryCode",
    "CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE 'S' || CAST(l_suppkey AS STRING) END AS monitoringSiteIdentifier",
    "CASE WHEN l_orderkey % 89 = 0 THEN 'GW' WHEN l_suppkey % 3 = 0 THEN 'LW' ELSE 'RW' END AS parameterWaterBodyCategory",
    "CASE WHEN l_orderkey % 83 = 0 THEN 'CAS_0' WHEN l_linenumber = 6 THEN 'EEA_3133-01-5' WHEN l_linenumber = 7 THEN 'CAS_7440-43-9' WHEN l_returnflag = 'A' THEN 'CAS_14797-55-8' WHEN l_returnflag = 'N' THEN 'EEA_3152-01-0' ELSE 'CAS_7723-14-0' END AS observedPropertyDeterminandCode",
    "CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN 'W-DIS' WHEN l_orderkey % 79 = 0 THEN 'S' ELSE 'W' END AS procedureAnalysedMatrix",
    "CASE WHEN l_partkey % 223 = 0 THEN ' ' WHEN l_linenumber = 6 THEN 'mg{O2}/L' WHEN l_linenumber = 7 THEN 'ug/L' WHEN l_returnflag = 'N' THEN 'pH' WHEN l_returnflag = 'A' THEN CASE WHEN l_partkey % 40 = 1 THEN 'mg{N}/L' WHEN l_partkey % 4 = 0 THEN 'ug{NO3}/L' ELSE 'mg{NO3}/L' END ELSE CASE WHEN l_partkey % 3 = 0 THEN 'ug{P}/L' ELSE 'mg{P}/L' END END AS resultUom",
    "CASE WHEN l_orderkey % 71 = 0 THEN '2000-13-01' WHEN l_orderkey % 2 = 0 THEN replace(CAST(CAST(l_shipdate AS DATE) AS STRING), '-', '') ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS phenomenonTimeSamplingDate",
    "CASE WHEN l_orderkey % 67 = 0 THEN 'n/a' WHEN l_returnflag = 'N' THEN CAST(l_quantity / 2 AS STRING) ELSE CAST(l_quantity / 4 AS STRING) END AS resultObservedValue",
    "CASE WHEN l_linestatus = 'O' AND l_partkey % 4 = 0 THEN '1' ELSE '0' END AS resultQualityObservedValueBelowLOQ",
    "CASE WHEN l_orderkey % 61 = 0 THEN 'M' ELSE 'A' END AS resultObservationStatus",
    "CASE l_linenumber WHEN 2 THEN 'U' WHEN 3 THEN 'V' ELSE 'A' END AS metadata_observationStatus",
]
MIN_YEAR = 1996
COUNTRY_SQL = "CASE upper(trim({c})) WHEN 'EL' THEN 'GR' WHEN 'GR' THEN 'GR' WHEN 'IT' THEN 'IT' WHEN 'NO' THEN 'NO' END"
CODES = ", ".join(f"'{d[0]}'" for d in dims.DETERMINANDS)
DIM = dims.values(dims.DETERMINANDS, "dim", dims.DETERMINAND_COLUMNS)
PARAMETERS = dims.values([(k, *v) for k, v in dims.PARAMETERS.items()], "par", ("parameter", "unit", "limit_value", "is_lower"))
NATIONAL = dims.values([(c, p, v) for c, own in dims.NATIONAL_LIMITS.items() for p, v in own.items()], "nat", ("country", "parameter", "value"))
EU = dims.values(list(dims.SURFACE_LIMITS.items()), "eu", ("parameter", "value"))

TYPED = f"""typed AS (SELECT {COUNTRY_SQL.format(c="countryCode")} AS country, trim(monitoringSiteIdentifier) AS site_id, parameterWaterBodyCategory AS category, observedPropertyDeterminandCode AS determinand,
  procedureAnalysedMatrix AS matrix, trim(resultUom) AS unit, coalesce(resultQualityObservedValueBelowLOQ IN ('1', 'true', 'TRUE', 'True'), false) AS below_loq, coalesce(metadata_observationStatus IN ('U', 'V'), false) AS unreliable,
  CASE WHEN regexp_matches(phenomenonTimeSamplingDate, '^[0-9]{{8}}$') THEN CAST(try_strptime(phenomenonTimeSamplingDate, '%Y%m%d') AS DATE) WHEN regexp_matches(phenomenonTimeSamplingDate, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN CAST(try_strptime(phenomenonTimeSamplingDate, '%Y-%m-%d') AS DATE) END AS d,
  CASE WHEN isfinite(TRY_CAST(trim(resultObservedValue) AS DOUBLE)) THEN TRY_CAST(trim(resultObservedValue) AS DOUBLE) END AS v, resultObservationStatus AS status FROM {select(MEASUREMENTS, "lineitem")}),
reasoned AS (SELECT country, site_id, category, determinand, matrix, unit, year(d)::INT AS year, month(d)::INT AS month, CASE WHEN NOT below_loq THEN v END AS value, below_loq, unreliable,
  CASE WHEN country IS NULL THEN 'country' WHEN category IS NULL OR category NOT IN ('RW', 'LW') THEN 'category' WHEN determinand IS NULL OR determinand NOT IN ({CODES}) THEN 'determinand'
    WHEN NOT EXISTS (SELECT 1 FROM {DIM} WHERE dim.code = typed.determinand AND CASE WHEN dim.expected_unit IS NULL THEN typed.matrix IN ('W', 'W-DIS') ELSE typed.matrix = dim.own_matrix END) THEN 'matrix'
    WHEN status IN ('L', 'M', 'N', 'O', 'W') THEN 'missing-value' WHEN d IS NULL THEN 'date' WHEN year(d) < {MIN_YEAR} THEN 'before-min-year' WHEN coalesce(unit, '') = '' OR coalesce(site_id, '') = '' THEN 'no-unit-or-site'
    WHEN NOT below_loq AND v IS NULL THEN 'no-value' WHEN NOT below_loq AND determinand = 'EEA_3152-01-0' AND (v < 0 OR v > 14) THEN 'implausible' END AS reason FROM typed)"""
CELLS = f"""{TYPED},
cells AS (SELECT country, site_id, category, determinand, matrix, unit, year, month, count(value) AS n, coalesce(sum(value), 0.0) AS sum_value, min(value) AS min, max(value) AS max, count(*) FILTER (WHERE below_loq) AS n_below_loq,
  count(*) FILTER (WHERE unreliable) AS n_lower_reliability, year * 12 + month - 1 AS pos FROM reasoned WHERE reason IS NULL GROUP BY country, site_id, category, determinand, matrix, unit, year, month)"""
#: The periods that comparisons look at.
A, B = ("a", 1997 * 12, 1998 * 12 + 5), ("b", 1998 * 12 + 3, 2000 * 12 + 11)


def measurements(t: Tables):
    return spread(t.lineitem).selectExpr(*MEASUREMENTS)


SITES = [
    f"{COUNTRY.format(k='(c_custkey % 100)')} AS countryCode", "'S' || CAST(c_custkey % 100 AS STRING) AS monitoringSiteIdentifier",
    "CASE WHEN c_custkey % 7 = 0 THEN 'UNKNOWN' ELSE c_name END AS monitoringSiteName",
    "CASE c_mktsegment WHEN 'BUILDING' THEN CASE WHEN c_nationkey = 1 THEN 'N' ELSE ' F ' END WHEN 'MACHINERY' THEN 'F' WHEN 'HOUSEHOLD' THEN CASE WHEN c_nationkey = 2 THEN NULL ELSE 'F' END ELSE 'F' END AS confidentialityStatus",
    "CAST(c_acctbal / 80 AS STRING) AS lat", "CASE WHEN c_nationkey = 5 THEN NULL ELSE CAST(c_nationkey * 8.0 AS STRING) END AS lon", "c_custkey AS input_order",
]
SITES_SQL = f"""clean AS (SELECT {COUNTRY_SQL.format(c="countryCode")} AS country, trim(monitoringSiteIdentifier) AS site_id, CASE WHEN trim(monitoringSiteName) <> '' AND upper(trim(monitoringSiteName)) <> 'UNKNOWN' THEN trim(monitoringSiteName) END AS name,
  CASE WHEN ok AND free THEN la END AS lat, CASE WHEN ok AND free THEN lo END AS lon, NOT free AS restricted, ok AND NOT free AS withheld, input_order FROM (SELECT *, TRY_CAST(lat AS DOUBLE) AS la, TRY_CAST(lon AS DOUBLE) AS lo,
  coalesce(TRY_CAST(lat AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(lon AS DOUBLE) BETWEEN -180 AND 180, false) AS ok, coalesce(trim(confidentialityStatus) = 'F', false) AS free FROM {select(SITES, "customer")}) WHERE {COUNTRY_SQL.format(c="countryCode")} IS NOT NULL),
sites AS (SELECT country, site_id, name, lat, lon, restricted, withheld FROM (SELECT *, row_number() OVER (PARTITION BY country, site_id ORDER BY NOT restricted, lat IS NULL, input_order) AS k, max(withheld) OVER (PARTITION BY country, site_id) AS w FROM clean) x, LATERAL (SELECT w AS withheld2) WHERE k = 1)"""
SITES_SQL = SITES_SQL.replace("SELECT country, site_id, name, lat, lon, restricted, withheld FROM (", "SELECT country, site_id, name, lat, lon, restricted, w AS withheld FROM (").replace(" x, LATERAL (SELECT w AS withheld2) WHERE", " WHERE")
