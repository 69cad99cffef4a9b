"""Queries over measurement rows and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolake.functions import dims
from hydrolake.functions import scalars as S
from hydrolake.operators import index as I
from hydrolake.operators import limits as L
from hydrolake.operators import measurements as M
from hydrolake.operators import periods as P
from hydrolake.operators.lineage import shared_path, table
from hydrolake.plans import views as V
from hydrolake.plans.registry import Tables, query
from hydrolake.sources import readers, writers

RULED = f"""{V.CELLS},
weights AS (SELECT determinand, matrix, unit, count(*) AS n_rows, sum(n + n_below_loq)::BIGINT AS n_records FROM cells WHERE pos BETWEEN {V.A[1]} AND {V.A[2]} OR pos BETWEEN {V.B[1]} AND {V.B[2]} GROUP BY ALL),
named AS (SELECT w.*, CASE WHEN dim.own_matrix = w.matrix AND dim.expected_unit IS NULL THEN dim.closed_name END AS mapped_name, dim.basis, dim.basis_factor, dim.expected_unit FROM weights w LEFT JOIN {V.DIM} ON dim.code = w.determinand),
targeted AS (SELECT *, coalesce(expected_unit, (SELECT unit FROM {V.PARAMETERS} WHERE par.parameter = mapped_name), first(unit) OVER (PARTITION BY determinand, matrix ORDER BY n_records DESC, unit)) AS target,
  CASE WHEN regexp_matches(unit, '^[A-Za-z]+[{{][^{{}}/]+[}}]/[A-Za-z]+$') THEN regexp_replace(unit, '[{{][^}}]*[}}]', '') ELSE unit END AS plain, CASE WHEN regexp_matches(unit, '^[A-Za-z]+[{{][^{{}}/]+[}}]/[A-Za-z]+$') THEN regexp_extract(unit, '[{{]([^}}]+)[}}]', 1) END AS own FROM named),
rules AS (SELECT determinand, matrix, t.unit, n_rows, n_records, target, CASE WHEN mapped_name IS NULL THEN CASE WHEN t.unit = target THEN 1.0::DOUBLE END WHEN own IS NOT DISTINCT FROM basis AND a.family = b.family THEN a.factor / b.factor * basis_factor END AS factor
  FROM targeted t LEFT JOIN (SELECT * FROM {dims.values([(k, *v) for k, v in dims.UNITS.items()], "u", ("name", "family", "factor"))}) a ON a.name = t.plain LEFT JOIN (SELECT * FROM {dims.values([(k, *v) for k, v in dims.UNITS.items()], "u", ("name", "family", "factor"))}) b ON b.name = t.target)"""
WINDOWED = f"""{RULED},
windows AS (SELECT * FROM (VALUES ('a', {V.A[1]}, {V.A[2]}), ('b', {V.B[1]}, {V.B[2]})) AS w("window", first_pos, last_pos)),
agg AS (SELECT c.site_id, c.determinand, c.matrix, w."window", sum(c.n)::BIGINT AS n, sum(n_below_loq)::BIGINT AS n_below_loq, sum(n_lower_reliability)::BIGINT AS n_lower_reliability, sum(sum_value * factor) AS total,
  min(CASE WHEN c.n > 0 THEN c.min * factor END) AS low, max(CASE WHEN c.n > 0 THEN c.max * factor END) AS high, count(DISTINCT CASE WHEN c.n > 0 THEN pos END) AS months, list(DISTINCT pos) FILTER (WHERE c.n > 0) AS month_set
  FROM cells c JOIN rules r ON r.determinand = c.determinand AND r.matrix = c.matrix AND r.unit = c.unit AND r.factor IS NOT NULL JOIN windows w ON c.pos BETWEEN first_pos AND last_pos GROUP BY ALL),
stats AS (SELECT *, CASE WHEN n > 0 THEN greatest(least(total / n, high), low) END AS mean, n + n_below_loq AS records FROM agg),
wide AS (SELECT site_id, determinand, matrix, {", ".join(f"coalesce(max({c}) FILTER (WHERE \"window\" = '{w}'), 0) AS {c}_{w}" for w in "ab" for c in ("n", "records", "n_below_loq", "months"))}, {", ".join(f"max({c}) FILTER (WHERE \"window\" = '{w}') AS {c}_{w}" for w in "ab" for c in ("mean", "low", "high", "month_set"))} FROM stats GROUP BY ALL),
paired AS (SELECT *, CASE WHEN records_a = 0 THEN 'absent-in-period-a' WHEN records_b = 0 THEN 'absent-in-period-b' WHEN n_a < 3 OR n_b < 3 THEN 'insufficient-samples' END AS reason FROM wide WHERE records_a > 0 OR records_b > 0)"""


def change_sql(a: str, b: str, unit: str) -> str:
    return f"""CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN round({b} - {a}, 6) + 0.0 END AS absolute, CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND round({a}, 6) <> 0 THEN round(100 * ({b} - {a}) / abs({a}), 4) + 0.0 END AS relative_percent,
  CASE WHEN {a} IS NULL THEN 'baseline-missing' WHEN {b} IS NULL THEN 'comparison-missing' WHEN round({a}, 6) = 0 THEN 'baseline-zero' WHEN {unit} IN ('Cel', 'pH') THEN 'interval-scale' END AS relative_percent_note,
  CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN round({a}, 6) = round({b}, 6) THEN 'no-change' WHEN {b} > {a} THEN 'increased' ELSE 'decreased' END AS direction"""


# A sum of whole multiples of 2 ** -60 is exact; its nearest double is the first guess plus what that leaves.
SIXTY = 1 << 60


def exact_sql(value: str, where: str, by: str, source: str) -> str:
    return f"SELECT {by}, g + (h - CAST(g * {SIXTY}.0 AS HUGEINT))::DOUBLE / {SIXTY}.0 AS exact_sum FROM (SELECT *, h::DOUBLE / {SIXTY}.0 AS g FROM (SELECT {by}, sum(CAST({value} * {SIXTY}.0 AS HUGEINT))::HUGEINT AS h FROM {source} WHERE {where} GROUP BY {by}))"


def cells_once(t: Tables):
    """Cells that a query reads twice: written down instead of made twice."""
    return table(cells(t), "cells")


def cells(t: Tables):
    return M.monthly_cells(M.kept(V.measurements(t), V.MIN_YEAR))


def rules(t: Tables, own):
    return M.unit_rules(M.unit_weights(own, [V.A, V.B]))


def sites(t: Tables):
    return M.merge_sites(M.clean_sites(t.view("customer", V.SITES)))


@query(f"WITH {V.TYPED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasoned GROUP BY 1")
def p1_drop_reasons(t: Tables):
    return M.drop_reason(V.measurements(t), V.MIN_YEAR).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {V.TYPED} SELECT country, site_id, category, determinand, matrix, unit, year, month, value, below_loq FROM reasoned WHERE reason IS NULL")
def p1_filter_measurements(t: Tables):
    return M.kept(V.measurements(t), V.MIN_YEAR).drop("unreliable")


@query(f"SELECT c AS code, {V.COUNTRY_SQL.format(c='c')} AS country, count(*) AS n FROM (SELECT {V.COUNTRY.format(k='c_custkey')} AS c FROM customer) GROUP BY ALL")
def p2_normalise_country(t: Tables):
    return t.view("customer", [f"{V.COUNTRY.format(k='c_custkey')} AS code"]).withColumn("country", S.normalise_country(F.col("code"))).groupBy("code", "country").agg(F.count("*").alias("n"))


@query(f"WITH {V.TYPED} SELECT determinand, count(*) FILTER (WHERE below_loq) AS n_below, count(value) AS n_values, round(avg(value), 6) AS mean FROM reasoned WHERE reason IS NULL GROUP BY 1")
def p3_below_loq_split(t: Tables):
    return M.kept(V.measurements(t), V.MIN_YEAR).groupBy("determinand").agg(F.count_if("below_loq").alias("n_below"), F.count("value").alias("n_values"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {V.CELLS} SELECT * EXCLUDE (pos) FROM cells")
def a1_monthly_cells(t: Tables):
    return cells(t)


@query(f"""WITH {V.CELLS}, x AS ({exact_sql("value", "reason IS NULL", ", ".join(M.KEY), "reasoned")})
SELECT {", ".join("c." + k for k in M.KEY)}, n, coalesce(exact_sum, 0.0) AS sum_value, min, max, n_below_loq, n_lower_reliability FROM cells c JOIN x ON {" AND ".join(f"c.{k} IS NOT DISTINCT FROM x.{k}" for k in M.KEY)}""")
def a1_exact_cells(t: Tables):
    """Cells whose sums are correctly rounded."""
    return M.monthly_cells(M.kept(V.measurements(t), V.MIN_YEAR), exactly=True)


@query(f"WITH {V.CELLS} SELECT country, site_id, category, determinand, matrix, unit, year, sum(n)::BIGINT AS n, round(sum(sum_value) / nullif(sum(n), 0), 6) AS mean, min(min) AS min, max(max) AS max, sum(n_below_loq)::BIGINT AS n_below_loq FROM cells GROUP BY ALL")
def a2_annual_series(t: Tables):
    return M.annual_series(cells(t))


@query(f"""WITH {V.CELLS}, m AS (SELECT *, count(*) OVER w AS total_matching, row_number() OVER (PARTITION BY site_id, determinand, matrix, unit ORDER BY pos, country, category) AS place FROM cells WHERE pos BETWEEN {V.A[1]} AND {V.B[2]} WINDOW w AS (PARTITION BY site_id, determinand, matrix, unit))
SELECT site_id, determinand, matrix, unit, printf('%04d-%02d', pos // 12, pos % 12 + 1) AS month, n, round(sum_value / nullif(n, 0), 6) AS mean, total_matching, place FROM m WHERE place <= 2000""")
def a2_monthly_series(t: Tables):
    return M.monthly_series(cells(t), V.A[1], V.B[2])


ROLLUP = "rollup AS (SELECT site_id, min(country) AS country, first(category ORDER BY r DESC, category) AS category, min(fy) AS first_year, max(ly) AS last_year, sum(r)::BIGINT AS n_records FROM (SELECT site_id, category, min(country) AS country, sum(n + n_below_loq) AS r, min(year) AS fy, max(year) AS ly FROM cells GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {V.CELLS}, {ROLLUP} SELECT * FROM rollup")
def a3_site_rollup(t: Tables):
    return M.site_rollup(cells(t))


@query(f"WITH {V.CELLS} SELECT country, determinand, count(DISTINCT site_id) AS n_sites, sum(n + n_below_loq)::BIGINT AS n_records FROM cells GROUP BY 1, 2")
def a4_country_determinands(t: Tables):
    return M.country_determinands(cells(t))


@query(f"WITH {V.CELLS} SELECT country, printf('%04d-%02d', min(pos) // 12, min(pos) % 12 + 1) AS first, printf('%04d-%02d', max(pos) // 12, max(pos) % 12 + 1) AS last FROM cells GROUP BY 1")
def a4_country_ranges(t: Tables):
    return M.country_ranges(cells(t))


@query(f"""WITH {V.CELLS}, {ROLLUP}, {V.SITES_SQL}, known AS (SELECT r.*, s.lat FROM rollup r LEFT JOIN sites s USING (country, site_id)),
x AS (SELECT country, count(*) AS n_sites, count(*) FILTER (WHERE category = 'RW') AS n_river, count(*) FILTER (WHERE category = 'LW') AS n_lake, count(*) FILTER (WHERE lat IS NULL) AS n_unlocated, min(first_year) AS first_year, max(last_year) AS last_year, sum(n_records)::BIGINT AS n_records FROM known GROUP BY 1),
y AS (SELECT country, array_to_string(list_sort(list(DISTINCT dim.group)), ',') AS groups, count(DISTINCT pos) AS n_months FROM cells JOIN {V.DIM} ON dim.code = determinand GROUP BY 1) SELECT * FROM x JOIN y USING (country)""")
def a5_country_summary(t: Tables):
    own = cells_once(t)
    return M.country_summary(M.enrich_sites(M.site_rollup(own), sites(t)), own)


@query(f"WITH {RULED} SELECT determinand, matrix, unit, n_rows, n_records, target, round(factor, 9) AS factor FROM rules")
def a6_unit_rules(t: Tables):
    return rules(t, cells(t)).withColumn("factor", F.round("factor", 9))


@query(f'WITH {WINDOWED} SELECT site_id, determinand, matrix, "window", n, n_below_loq, n_lower_reliability, round(total, 6) AS total, round(low, 6) AS low, round(high, 6) AS high, months FROM agg')
def a7_window_aggregate(t: Tables):
    own = cells_once(t)
    return M.window_aggregate(own, [V.A, V.B], rules(t, own)).withColumns({c: F.round(c, 6) for c in ("total", "low", "high")}).drop("month_mask")


@query(exact_sql("l_extendedprice", "true", "l_returnflag", "lineitem"))
def a8_exact_sum(t: Tables):
    return M.exact_sum(t.lineitem, ["l_returnflag"], "l_extendedprice")


@query(exact_sql("l_extendedprice * (1 - l_discount)", "l_orderkey % 3 > 0", "l_suppkey", "lineitem"))
def a8_exact_sum_of_products(t: Tables):
    rows = t.view("lineitem", ["l_suppkey", "l_extendedprice * (1 - l_discount) AS v"], "l_orderkey % 3 > 0")
    return M.exact_sum(rows, ["l_suppkey"], "v")


@query(f"WITH {V.CELLS} SELECT country, determinand, count(DISTINCT pos) AS n_months, min(pos) AS first_pos, max(pos) AS last_pos FROM cells WHERE n > 0 GROUP BY 1, 2")
def a9_months_with_data(t: Tables):
    return M.months_union(cells(t))


@query(f"""WITH spans AS (SELECT l_suppkey AS site, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS first_month, (year(l_shipdate) * 12 + month(l_shipdate) - 1 + l_linenumber % 3)::INT AS last_month, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS n, CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity END AS total, CASE WHEN l_linestatus <> 'O' THEN l_quantity END AS v, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS b FROM lineitem),
s AS (SELECT *, first_month >= {V.A[1]} AND last_month <= {V.A[2]} AS i FROM spans WHERE first_month <= {V.A[2]} AND last_month >= {V.A[1]})
SELECT site, coalesce(sum(n) FILTER (WHERE i), 0)::BIGINT AS n, round(greatest(least(sum(total) FILTER (WHERE i AND n > 0) / nullif(sum(n) FILTER (WHERE i), 0), max(v) FILTER (WHERE i)), min(v) FILTER (WHERE i)), 6) AS mean, min(v) FILTER (WHERE i) AS low, max(v) FILTER (WHERE i) AS high, coalesce(sum(b) FILTER (WHERE i), 0)::BIGINT AS n_below_loq, count(*) FILTER (WHERE NOT i) AS n_partial,
round(coalesce(sum(b) FILTER (WHERE i), 0) / nullif(coalesce(sum(n) FILTER (WHERE i), 0) + coalesce(sum(b) FILTER (WHERE i), 0), 0)::DOUBLE, 6) AS below_loq_share FROM s GROUP BY 1""")
def a17_period_stats(t: Tables):
    below = "CASE WHEN l_linestatus = 'O' THEN '<' END AS comparator"
    first = "(year(l_shipdate) * 12 + month(l_shipdate) - 1)"
    records = t.view("lineitem", ["l_suppkey AS site", f"CAST({first} AS INT) AS first_month", f"CAST({first} + l_linenumber % 3 AS INT) AS last_month", below, "l_quantity AS value"])
    return P.period_stats(P.annual_cells(records), V.A[1], V.A[2], ["site"])


@query("""SELECT l_suppkey AS site, count(*) AS n_cells, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n, sum(CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END)::BIGINT AS n_below_loq, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 6) AS total FROM lineitem WHERE l_linenumber < 7 AND l_returnflag <> 'R' GROUP BY 1""")
def a23_annual_only_cells(t: Tables):
    first = "(year(l_shipdate) * 12 + month(l_shipdate) - 1)"
    comparator = "CASE WHEN l_returnflag = 'R' THEN '>' WHEN l_linestatus = 'O' THEN '<=' END AS comparator"
    records = t.view("lineitem", ["l_suppkey AS site", f"CASE WHEN l_linenumber < 7 THEN CAST({first} AS INT) END AS first_month", f"CAST({first} + 11 AS INT) AS last_month", comparator, "l_quantity AS value"])
    return P.annual_cells(records).groupBy("site").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n"), F.sum("n_below_loq").alias("n_below_loq"), F.round(F.sum("total"), 6).alias("total"))


LIMITED = f"""limited AS (SELECT p.*, dim.closed_name, par.unit AS own_unit, par.limit_value, par.is_lower, ({V.COUNTRY_SQL.format(c=V.COUNTRY.format(k="CAST(substr(site_id, 2) AS BIGINT)"))}) AS country FROM paired p LEFT JOIN {V.DIM} ON dim.code = p.determinand AND dim.own_matrix = p.matrix AND dim.expected_unit IS NULL LEFT JOIN {V.PARAMETERS} ON par.parameter = dim.closed_name)"""


def with_limits(t: Tables, paired):
    """Paired sites with their country, parameter and drinking limit."""
    named = M.mapped(paired.withColumnRenamed("reason", "pair_reason")).withColumnRenamed("reason", "map_reason").withColumnRenamed("pair_reason", "reason")
    country = S.normalise_country(F.expr(V.COUNTRY.format(k="CAST(substr(site_id, 2) AS BIGINT)")))
    limits = F.broadcast(dims.parameters(t.spark).withColumnRenamed("unit", "own_unit"))
    return named.join(limits, F.col("mapped_name") == F.col("parameter"), "left").withColumn("country", country)


@query(f"""WITH {WINDOWED} SELECT determinand, coalesce(reason, 'paired') AS reason, count(*) AS n_sites FROM paired GROUP BY ALL""")
def j11_pair_sites(t: Tables):
    own = cells_once(t)
    return P.pair_sites(P.site_windows(own, V.A, V.B, rules(t, own))).groupBy("determinand", F.coalesce("reason", F.lit("paired")).alias("reason")).agg(F.count("*").alias("n_sites"))


def _assessed(m: str) -> str:
    return f"CASE WHEN limit_value IS NULL THEN 'not-scored' WHEN {m} IS NULL THEN 'indeterminate' WHEN CASE WHEN is_lower THEN {m} >= limit_value ELSE {m} <= limit_value END THEN 'within-limit' ELSE 'exceeds-limit' END"


@query(f"""WITH {WINDOWED}, {LIMITED}, judged AS (SELECT *, {_assessed("mean_a")} AS assessment_a, {_assessed("mean_b")} AS assessment_b, {change_sql("mean_a", "mean_b", "own_unit")} FROM limited)
SELECT site_id, determinand, matrix, n_a, n_b, round(mean_a, 11) AS mean_a, round(mean_b, 11) AS mean_b, round(mean_b - mean_a, 11) AS absolute, CASE WHEN relative_percent IS NOT NULL THEN round(100 * (mean_b - mean_a) / abs(mean_a), 9) END AS relative_percent, relative_percent_note, direction, assessment_a, assessment_b, CASE WHEN n_a >= 3 AND n_b >= 3 THEN 'ok' ELSE 'insufficient-data' END AS status,
CASE WHEN n_a < 3 OR n_b < 3 OR assessment_a NOT IN ('within-limit', 'exceeds-limit') OR assessment_b NOT IN ('within-limit', 'exceeds-limit') THEN NULL WHEN assessment_a = assessment_b THEN 'none' WHEN assessment_b = 'exceeds-limit' THEN 'within-to-exceeds' ELSE 'exceeds-to-within' END AS crossed_limit,
array_to_string(list_sort(list_filter([CASE WHEN (months_a > 0 AND months_a < {V.A[2] - V.A[1] + 1}) OR (months_b > 0 AND months_b < {V.B[2] - V.B[1] + 1}) THEN 'partial-period' END, CASE WHEN n_below_loq_a + n_below_loq_b > 0 THEN 'below-loq-excluded-bias-upward' END, 'periods-overlap', CASE WHEN relative_percent_note IN ('baseline-zero', 'baseline-missing', 'comparison-missing') THEN 'relative-change-undefined' END, CASE WHEN relative_percent_note = 'interval-scale' THEN 'relative-change-interval-scale' END], lambda x: x IS NOT NULL)), ',') AS flags FROM judged""")
def a18_compare_site(t: Tables):
    own = cells_once(t)
    wide = with_limits(t, P.pair_sites(P.site_windows(own, V.A, V.B, rules(t, own))))
    out = P.compare_site(wide, V.A, V.B, F.col("own_unit"), F.col("limit_value"), F.col("is_lower"))
    # Sums come in any order, so what is compared has more digits than the operator's own columns show.
    a, b = F.col("mean_a"), F.col("mean_b")
    exact = {"mean_a": F.round(a, 11), "mean_b": F.round(b, 11), "absolute": F.round(b - a, 11), "relative_percent": F.when(F.col("relative_percent").isNotNull(), F.round(100 * F.try_divide(b - a, F.abs(a)), 9))}
    return out.select("site_id", "determinand", "matrix", "n_a", "n_b", *[c.alias(k) for k, c in exact.items()], "relative_percent_note", "direction", "assessment_a", "assessment_b", "status", "crossed_limit", "flags")


FIRST = f"f AS (SELECT site_id, determinand, matrix, first(country ORDER BY unit, pos, country, category) AS country, first(category ORDER BY unit, pos, country, category) AS category FROM cells WHERE pos BETWEEN {V.A[1]} AND {V.A[2]} OR pos BETWEEN {V.B[1]} AND {V.B[2]} GROUP BY 1, 2, 3)"
SIDES = ", ".join(f"coalesce(sum(n_{w}) FILTER (WHERE ok), 0)::BIGINT AS n_samples_{w}, coalesce(sum(n_below_loq_{w}) FILTER (WHERE ok), 0)::BIGINT AS n_below_loq_{w}, round(sum(n_below_loq_{w}) FILTER (WHERE ok) / nullif(sum(n_{w} + n_below_loq_{w}) FILTER (WHERE ok), 0), 6) AS below_loq_share_{w}, len(list_distinct(flatten(coalesce(list(month_set_{w}) FILTER (WHERE ok AND month_set_{w} IS NOT NULL), [])))) AS n_months_{w}" for w in "ab")
COUNTRY_FLAGS = f"""array_to_string(list_sort(list_filter([CASE WHEN first_pos IS NULL THEN 'no-data-for-scope' END, CASE WHEN coalesce(last_pos < {V.B[2]}, true) THEN 'period-outside-data' END, CASE WHEN {V.A[2]} < first_pos THEN 'period-before-data' END, CASE WHEN (n_months_a > 0 AND n_months_a < {V.A[2] - V.A[1] + 1}) OR (n_months_b > 0 AND n_months_b < {V.B[2] - V.B[1] + 1}) THEN 'partial-period' END,
  CASE WHEN n_below_loq_a + n_below_loq_b > 0 THEN 'below-loq-excluded-bias-upward' END, 'periods-overlap', CASE WHEN n_paired BETWEEN 1 AND 4 THEN 'few-sites' END, CASE WHEN relative_percent_note IN ('baseline-zero', 'baseline-missing', 'comparison-missing') THEN 'relative-change-undefined' END, CASE WHEN relative_percent_note = 'interval-scale' THEN 'relative-change-interval-scale' END], lambda x: x IS NOT NULL)), ',') AS flags"""


@query(f"""WITH {WINDOWED}, {FIRST}, p AS (SELECT paired.*, f.country, f.category = 'RW' AS river, dim.closed_name, par.unit AS own_unit, par.is_lower, CASE WHEN dim.closed_name <> 'Cadmium dissolved' THEN coalesce(nat.value, eu.value, par.limit_value) END AS river_limit FROM paired JOIN f USING (site_id, determinand, matrix)
 LEFT JOIN {V.DIM} ON dim.code = determinand AND dim.own_matrix = matrix AND dim.expected_unit IS NULL LEFT JOIN {V.PARAMETERS} ON par.parameter = dim.closed_name LEFT JOIN {V.NATIONAL} ON nat.country = f.country AND nat.parameter = dim.closed_name LEFT JOIN {V.EU} ON eu.parameter = dim.closed_name),
r AS (SELECT *, reason IS NULL AS ok, CASE WHEN mean_a IS NOT NULL AND mean_b IS NOT NULL AND round(mean_a, 6) <> 0 THEN 100 * (mean_b - mean_a) / abs(mean_a) END AS rel, CASE WHEN mean_a IS NULL OR mean_b IS NULL THEN NULL WHEN round(mean_a, 6) = round(mean_b, 6) THEN 'no-change' WHEN mean_b > mean_a THEN 'increased' ELSE 'decreased' END AS dir FROM p),
g AS (SELECT country, determinand, matrix, max(own_unit) AS own_unit, count(*) AS n_considered, count(*) FILTER (WHERE ok) AS n_paired, count(*) FILTER (WHERE NOT ok) AS n_excluded, count(*) FILTER (WHERE reason = 'absent-in-period-a') AS n_absent_a, count(*) FILTER (WHERE reason = 'absent-in-period-b') AS n_absent_b, count(*) FILTER (WHERE reason = 'insufficient-samples') AS n_insufficient,
 avg(mean_a) FILTER (WHERE ok) AS ma, avg(mean_b) FILTER (WHERE ok) AS mb, round(median(rel) FILTER (WHERE ok), 4) AS median_relative_percent, count(*) FILTER (WHERE ok AND dir = 'increased') AS n_increased, count(*) FILTER (WHERE ok AND dir = 'decreased') AS n_decreased, count(*) FILTER (WHERE ok AND dir = 'no-change') AS n_unchanged, count(*) FILTER (WHERE ok AND rel IS NULL) AS n_undefined, {SIDES},
 count(*) FILTER (WHERE ok AND river AND river_limit IS NOT NULL) AS n_rivers_judged, {", ".join(f"count(*) FILTER (WHERE ok AND river AND CASE WHEN is_lower THEN mean_{w} < river_limit ELSE mean_{w} > river_limit END) AS n_rivers_over_{w}" for w in "ab")}, max(river_limit) AS river_limit FROM r GROUP BY 1, 2, 3),
h AS (SELECT g.*, first_pos, last_pos, {change_sql("ma", "mb", "own_unit")} FROM g LEFT JOIN (SELECT country, determinand, matrix, min(pos) AS first_pos, max(pos) AS last_pos FROM cells GROUP BY 1, 2, 3) d USING (country, determinand, matrix))
SELECT * EXCLUDE (ma, mb, own_unit, first_pos, last_pos) REPLACE (round(river_limit, 9)::DOUBLE AS river_limit), round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, CASE WHEN n_paired > 0 THEN 'ok' ELSE 'insufficient-data' END AS status, {COUNTRY_FLAGS} FROM h""")
def a19_compare_country(t: Tables):
    own = cells_once(t)
    key = ["country", *M.SERIES]
    named = M.mapped(P.pair_sites(P.site_windows(own, V.A, V.B, rules(t, own))).withColumnRenamed("reason", "pair_reason")).drop("reason").withColumnRenamed("pair_reason", "reason")
    placed = named.withColumns({"country": F.col("identity.country"), "category": F.col("identity.category")})
    asked = placed.withColumns({"parameter": F.col("mapped_name"), "regime": F.lit("surface"), "at": S.month_text(F.lit(V.B[2]))})
    limited = I.resolve_limits(asked, L.limit_rows(t.spark, [])).drop("low_limit", "high_limit", "limit_source").join(F.broadcast(dims.parameters(t.spark).select(F.col("parameter"), F.col("unit").alias("own_unit"))), "parameter", "left")
    data = M.with_pos(own).groupBy(*key).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return P.compare_country(limited, key, V.A, V.B, F.col("own_unit"), F.col("category") == "RW", F.col("limit_value"), F.col("is_lower"), data).withColumn("river_limit", F.round("river_limit", 9))


@query(f"WITH {RULED}, {FIRST} SELECT * FROM f")
def w5_first_row_identity(t: Tables):
    return M.first_identity(cells(t), [V.A, V.B])


@query(f"SELECT * EXCLUDE (input_order) FROM (WITH {V.SITES_SQL} SELECT * FROM clean)")
def s2_read_sites(t: Tables):
    return M.clean_sites(t.view("customer", V.SITES)).drop("input_order")


@query(f"WITH {V.SITES_SQL} SELECT * FROM sites")
def w4_merge_spatial_rows(t: Tables):
    return sites(t)


@query(f"WITH {V.CELLS}, {ROLLUP}, {V.SITES_SQL} SELECT r.*, name, lat, lon, restricted, withheld, s.site_id IS NOT NULL AS known FROM rollup r LEFT JOIN sites s ON s.country = r.country AND s.site_id = r.site_id")
def j4_enrich_sites(t: Tables):
    return M.enrich_sites(M.site_rollup(cells(t)), sites(t))


@query(f"""WITH s AS (SELECT {V.COUNTRY_SQL.format(c="countryCode")} AS country, confidentialityStatus AS status, TRY_CAST(lat AS DOUBLE) AS lat FROM {V.select(V.SITES, "customer")}) SELECT country, status, count(*) AS n_sites, count(*) FILTER (WHERE lat IS NOT NULL AND NOT coalesce(trim(status) = 'F', false)) AS n_leaking FROM s GROUP BY 1, 2""")
def p12_redact_location(t: Tables):
    raw = t.view("customer", V.SITES)
    return M.restricted_audit(raw.select(S.normalise_country(F.col("countryCode")).alias("country"), F.col("confidentialityStatus").alias("status"), S.number(F.col("lat")).alias("lat")))


@query(f"""WITH {V.CELLS}, two AS (SELECT site_id || CASE WHEN year % 2 = 0 THEN '' ELSE '' END AS site_id, CASE WHEN month = 1 THEN 'AA' ELSE country END AS country, n FROM cells) SELECT site_id, country, count(*) AS n_cells FROM (SELECT *, min(country) OVER (PARTITION BY site_id) AS own FROM two) WHERE own = country GROUP BY 1, 2""")
def w3_site_two_countries(t: Tables):
    moved = cells(t).withColumn("country", F.when(F.col("month") == 1, "AA").otherwise(F.col("country")))
    return M.one_country(moved).groupBy("site_id", "country").agg(F.count("*").alias("n_cells"))


@query(f"""WITH {V.CELLS} SELECT c.determinand, c.matrix, c.unit, CASE WHEN own_matrix = matrix AND expected_unit IS NULL THEN closed_name END AS mapped_name, dim.group, count(*) AS n FROM cells c LEFT JOIN {V.DIM} ON dim.code = c.determinand GROUP BY ALL""")
def j1_map_determinands(t: Tables):
    return M.mapped(cells(t)).groupBy("determinand", "matrix", "unit", "mapped_name", "group").agg(F.count("*").alias("n"))


@query(f"""WITH {V.CELLS} SELECT 'Cadmium and its compounds' AS name, count(*) AS n_cells FROM cells WHERE determinand = 'CAS_7440-43-9' AND matrix = 'W' UNION ALL SELECT 'nitrate', count(*) FROM cells WHERE determinand = 'CAS_14797-55-8' AND matrix = 'W' UNION ALL SELECT 'BOD5', count(*) FROM cells WHERE determinand = 'EEA_3133-01-5' AND matrix = 'W' UNION ALL SELECT 'organic-matter', count(*) FROM cells WHERE determinand IN ({", ".join(f"'{d[0]}'" for d in dims.DETERMINANDS if d[7] == dims.ORGANIC)})""")
def j2_resolve_series(t: Tables):
    rows = cells(t)
    named = F.lit(None).cast("string")
    for name in ("Cadmium and its compounds", "nitrate", "BOD5"):
        code, matrix = M.resolve_series(name)
        named = F.when((F.col("determinand") == code) & (F.col("matrix") == matrix), name).otherwise(named)
    group = F.when(F.col("determinand").isin(M.codes_in_group(dims.ORGANIC)), dims.ORGANIC)
    return rows.select(F.explode(F.array_compact(F.array(named, group))).alias("name")).groupBy("name").agg(F.count("*").alias("n_cells"))


@query(f"WITH {V.CELLS}, {V.SITES_SQL} SELECT determinand, count(*) AS n_cells, sum(n)::BIGINT AS n FROM cells WHERE site_id IN (SELECT site_id FROM sites WHERE country = 'IT') GROUP BY 1")
def j3_site_semi_join(t: Tables):
    return cells(t).join(sites(t).filter("country = 'IT'"), "site_id", "left_semi").groupBy("determinand").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n"))


@query(f"""WITH {V.CELLS}, j AS (SELECT country, unnest(['records', 'cells']) AS key, unnest([sum(n + n_below_loq)::BIGINT::VARCHAR, count(*)::VARCHAR]) AS value FROM cells GROUP BY country) SELECT * FROM j""")
def s7_provenance(t: Tables):
    per = cells(t).groupBy("country").agg(F.sum(F.col("n") + F.col("n_below_loq")).alias("records"), F.count("*").alias("cells"))
    return per.select("country", F.explode(F.create_map(F.lit("records"), F.col("records").cast("string"), F.lit("cells"), F.col("cells").cast("string"))).alias("key", "value"))


@query(f"""WITH {V.TYPED}, c AS (SELECT coalesce(reason, 'kept') AS k, count(*) AS n FROM reasoned GROUP BY 1)
SELECT 'counters' AS key, '{{' || string_agg(printf('"%s":%d', k, n), ',' ORDER BY k) || '}}' AS value FROM c UNION ALL SELECT * FROM (VALUES ('edition', '1'), ('min_year', '{V.MIN_YEAR}'))""")
def s7_provenance_table(t: Tables):
    """Settings and drop counters of a build, as the writer keeps them beside a store."""
    return writers.provenance(M.drop_reason(V.measurements(t), V.MIN_YEAR), edition="1", min_year=str(V.MIN_YEAR))


@query(f"WITH {V.SITES_SQL} SELECT country, site_id, coalesce(name, site_id) AS name, lat, lon, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'located' ELSE 'no-location' END AS location_status FROM sites")
def p16_site_view(t: Tables):
    return M.site_view(sites(t))


@query(f"WITH {V.TYPED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasoned GROUP BY 1")
def s1_read_measurements(t: Tables):
    """The rows land as CSV once and are read by their header."""
    path = shared_path(t.spark, "measurements")
    V.measurements(t).select(*reversed(list(M.NAMES))).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return M.drop_reason(readers.read_measurements(t.spark, path), V.MIN_YEAR).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {V.CELLS} SELECT * EXCLUDE (pos) FROM cells")
def s6_write_cells(t: Tables):
    """The store of cells, written in key order and read back."""
    path = shared_path(t.spark, "cells")
    writers.write_store(cells(t), path, ["country", "site_id", "determinand", "matrix", "unit", "year", "month"])
    back = t.spark.read.parquet(path)
    return back.select(*M.KEY, *[c for c in back.columns if c not in M.KEY])


@query("SELECT CASE CAST(s_nationkey AS INT) % 3 WHEN 0 THEN 'differs' ELSE 'ok' END AS state, count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier) GROUP BY 1")
def s9_verify_manifest(t: Tables):
    """Files of suppliers by nation against a manifest with some hashes changed."""
    path = shared_path(t.spark, "manifest")
    t.supplier.select("s_nationkey", F.to_json(F.struct("s_suppkey", "s_name")).alias("line")).repartition("s_nationkey").sortWithinPartitions("line").write.partitionBy("s_nationkey").text(path)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    nation = F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int")
    manifest = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), nation.alias("nation"), F.sha2("content", 256).alias("sha256"))
    listed = manifest.select(F.concat_ws("/", F.concat(F.lit("s_nationkey="), F.col("nation").cast("string")), "file").alias("name"), F.when(F.col("nation") % 3 == 0, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return readers.verify_manifest(t.spark, path, listed, depth=2).groupBy("state").agg(F.count("*").alias("n"))
