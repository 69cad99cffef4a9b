"""Measurement rows, cells and period comparisons on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from hydrolake.functions import dims
from hydrolake.functions import scalars as S
from hydrolake.operators import measurements as M
from hydrolake.operators import periods as P

RAW = ", ".join(f"{c} string" for c in M.NAMES)
GOOD = ("EL", "S1", "RW", "CAS_14797-55-8", "W", "mg{NO3}/L", "2015-03-01", "4.5", "0", "A", "A")


def raw(spark, *changes):
    names = list(M.NAMES)
    rows = []
    for change in changes:
        row = dict(zip(names, GOOD)) | change
        rows.append(tuple(row[n] for n in names))
    return spark.createDataFrame(rows, RAW)


def test_reasons_in_order(spark):
    cases = [
        ({}, None), ({"countryCode": "FR"}, "country"), ({"countryCode": None}, "country"), ({"parameterWaterBodyCategory": "GW"}, "category"), ({"observedPropertyDeterminandCode": "CAS_1"}, "determinand"),
        ({"procedureAnalysedMatrix": "S"}, "matrix"), ({"resultObservationStatus": "M"}, "missing-value"), ({"phenomenonTimeSamplingDate": "2015-02-30"}, "date"), ({"phenomenonTimeSamplingDate": "20090101"}, "before-min-year"),
        ({"resultUom": " "}, "no-unit-or-site"), ({"monitoringSiteIdentifier": None}, "no-unit-or-site"), ({"resultObservedValue": "x"}, "no-value"), ({"resultObservedValue": "NaN"}, "no-value"),
        ({"resultObservedValue": None, "resultQualityObservedValueBelowLOQ": "true"}, None), ({"observedPropertyDeterminandCode": "EEA_3152-01-0", "resultUom": "pH", "resultObservedValue": "14.5"}, "implausible"),
        ({"countryCode": "FR", "resultObservedValue": "x"}, "country"), ({"observedPropertyDeterminandCode": "EEA_3133-05-9"}, "matrix"),
    ]
    got = [r["reason"] for r in M.drop_reason(raw(spark, *[c for c, _ in cases])).collect()]
    assert got == [why for _, why in cases]


def cells(spark, *changes):
    return M.monthly_cells(M.kept(raw(spark, *changes)))


def test_cells_count_below_loq_apart(spark):
    rows = cells(spark, {}, {"resultObservedValue": "5.5", "metadata_observationStatus": "U"}, {"resultQualityObservedValueBelowLOQ": "1", "metadata_observationStatus": "V"}, {"phenomenonTimeSamplingDate": "20150401"}).orderBy("month").collect()
    assert [(r["n"], r["sum_value"], r["min"], r["max"], r["n_below_loq"], r["n_lower_reliability"]) for r in rows] == [(2, 10.0, 4.5, 5.5, 1, 2), (1, 4.5, 4.5, 4.5, 0, 0)]
    assert rows[0]["country"] == "GR"


def test_empty_input(spark):
    empty = raw(spark, {}).limit(0)
    own = M.monthly_cells(M.kept(empty))
    assert own.count() == 0
    assert M.site_rollup(own).count() == 0
    assert P.site_windows(own, ("a", 0, 5), ("b", 6, 9)).count() == 0


def test_rows_in_any_order_give_the_same_cells(spark):
    own = raw(spark, *[{"resultObservedValue": str(k / 4), "phenomenonTimeSamplingDate": f"20150{k % 9 + 1}11"} for k in range(40)])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(M.monthly_cells(M.kept(own))) == key(M.monthly_cells(M.kept(own.orderBy(F.rand(1)).repartition(7))))


def test_annual_of_months_equals_annual_of_rows(spark):
    own = raw(spark, *[{"resultObservedValue": str(k), "phenomenonTimeSamplingDate": f"20150{k % 9 + 1}11"} for k in range(1, 30)])
    r = M.annual_series(M.monthly_cells(M.kept(own))).collect()
    assert len(r) == 1 and r[0]["n"] == 29 and r[0]["mean"] == 15.0 and (r[0]["min"], r[0]["max"]) == (1.0, 29.0)


def test_unit_rules(spark):
    own = cells(spark, {}, {"resultUom": "ug{NO3}/L"}, {"resultUom": "mg{N}/L"}, {"observedPropertyDeterminandCode": "CAS_7723-14-0", "resultUom": "mg{P}/L"}, {"observedPropertyDeterminandCode": "CAS_16887-00-6", "resultUom": "mg/L"}, {"observedPropertyDeterminandCode": "CAS_16887-00-6", "resultUom": "g/L"})
    got = {(r["determinand"], r["unit"]): r["factor"] for r in M.unit_rules(M.unit_weights(own, [("a", 0, 99999)])).collect()}
    assert got[("CAS_14797-55-8", "mg{NO3}/L")] == 1.0 and got[("CAS_14797-55-8", "ug{NO3}/L")] == 1e-3 and got[("CAS_14797-55-8", "mg{N}/L")] is None
    assert math.isclose(got[("CAS_7723-14-0", "mg{P}/L")], dims.PO4_PER_P)
    # Equal weights: the alphabetically first unit is the series' unit.
    assert got[("CAS_16887-00-6", "g/L")] == 1.0 and got[("CAS_16887-00-6", "mg/L")] is None


def test_windows_overlap(spark):
    own = cells(spark, *[{"phenomenonTimeSamplingDate": f"2015{m:02d}05", "resultObservedValue": str(m)} for m in range(1, 13)])
    at = 2015 * 12
    got = {r["window"]: (r["n"], r["total"], r["months"]) for r in M.window_aggregate(own, [("x", at, at + 5), ("y", at + 3, at + 11)]).collect()}
    assert got == {"x": (6, 21.0, 6), "y": (9, 72.0, 9)}
    with pytest.raises(ValueError):
        M.window_aggregate(own, [])


def test_pairing_and_change(spark):
    def site(name, a, b):
        return [{"monitoringSiteIdentifier": name, "resultObservedValue": str(v), "phenomenonTimeSamplingDate": f"{y}0{k + 1}01"} for y, vs in ((2014, a), (2016, b)) for k, v in enumerate(vs)]

    rows = site("A", [1, 2, 3], [2, 4, 6]) + site("B", [4, 4, 4], [4, 4, 4]) + site("C", [1, 1], [1, 1, 1]) + site("D", [9, 9, 9], [])
    wide = P.site_windows(cells(spark, *rows), ("a", 2014 * 12, 2014 * 12 + 11), ("b", 2016 * 12, 2016 * 12 + 11))
    paired = P.pair_sites(wide)
    assert {r["site_id"]: r["reason"] for r in paired.collect()} == {"A": None, "B": None, "C": "insufficient-samples", "D": "absent-in-period-b"}
    a, b = ("a", 2014 * 12, 2014 * 12 + 11), ("b", 2016 * 12, 2016 * 12 + 11)
    r = P.compare_country(paired, ["determinand"], a, b, F.lit("mg/L"), F.col("site_id") == "A", F.lit(3.0), F.lit(False)).collect()[0]
    assert (r["n_considered"], r["n_excluded"], r["n_months_a"], r["n_months_b"], r["n_rivers_judged"], r["n_rivers_over_a"], r["n_rivers_over_b"], r["river_limit"]) == (4, 2, 3, 3, 1, 0, 1, 3.0)
    assert r["status"] == "ok" and {"few-sites", "partial-period"} <= set(r["flags"].split(",")) and "periods-overlap" not in r["flags"]
    assert (r["n_paired"], r["n_increased"], r["n_unchanged"], r["mean_a"], r["mean_b"], r["median_relative_percent"], r["flags"]) == (2, 1, 1, 3.0, 4.0, 50.0, "few-sites,partial-period")


@pytest.mark.parametrize("a, b, unit, note, direction", [(1.0, 2.0, "mg/L", None, "increased"), (0.0, 2.0, "mg/L", "baseline-zero", "increased"), (None, 2.0, "x", "baseline-missing", None), (1.0, None, "x", "comparison-missing", None), (7.0, 6.0, "pH", "interval-scale", "decreased"), (1.0, 1.0000001, "x", None, "no-change")])
def test_change(spark, a, b, unit, note, direction):
    row = spark.createDataFrame([(a, b, unit)], "a double, b double, u string").select(*[c.alias(k) for k, c in S.change(F.col("a"), F.col("b"), F.col("u")).items()]).first()
    assert (row["relative_percent_note"], row["direction"]) == (note, direction)


def test_exact_sum(spark):
    values = [1e16, 1.0, -1e16, 1e-9, 3.0] * 50
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double").repartition(5)
    got = {r["k"]: r["exact_sum"] for r in M.exact_sum(df, ["k"], "v").collect()}
    assert got == {"a": math.fsum(values)}


def test_resolve_series():
    assert M.resolve_series("cadmium DISSOLVED") == ("CAS_7440-43-9", "W-DIS")
    assert M.resolve_series("Cadmium and its compounds") == ("CAS_7440-43-9", "W")
    assert M.resolve_series("Chloride") == ("CAS_16887-00-6", "W")
    assert M.resolve_series("nothing") is None


def test_sites(spark):
    rows = spark.createDataFrame([("IT", "S1", "UNKNOWN", "F", "45.0", "9.0", 1), ("IT", "S1", "n", "N", "45.0", "9.0", 2), ("IT", "S2", "n", "F", None, "9", 1), ("IT", "S2", "m", "F", "1", "2", 2), ("IT", " ", "n", "F", "1", "2", 3), ("IT", "S3", "n", "F", "91", "2", 3)], "countryCode string, monitoringSiteIdentifier string, monitoringSiteName string, confidentialityStatus string, lat string, lon string, input_order int")
    got = {r["site_id"]: (r["name"], r["lat"], r["restricted"], r["withheld"]) for r in M.merge_sites(M.clean_sites(rows)).collect()}
    assert got == {"S1": ("n", None, True, True), "S2": ("m", 1.0, False, False), "S3": ("n", None, False, False)}


def test_queries_return_all_rows(spark):
    from hydrolake import plans

    sf = "/root/testdata/sf0.001"
    assert plans.queries()["k3_measurement_records"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    series = plans.queries()["a2_monthly_series"](spark, sf).groupBy("site_id", "determinand", "matrix", "unit").agg(F.count("*").alias("n"), F.max("total_matching").alias("total"))
    assert series.filter("n <> total").count() == 0 and series.agg(F.max("n")).first()[0] > 12
