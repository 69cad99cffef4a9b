"""Indices, samples, seasons, statistics, governance and readers on small hand-made rows."""

import hashlib
import math
import random
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydrolake.functions import scalars as S
from hydrolake.operators import bathing as B
from hydrolake.operators import censored as C
from hydrolake.operators import ecology as E
from hydrolake.operators import governance as G
from hydrolake.operators import index as I
from hydrolake.operators import listing as L
from hydrolake.operators import network as N
from hydrolake.operators import reliability as R
from hydrolake.operators import samples as X
from hydrolake.operators import text as T
from hydrolake.sources import readers, writers

TESTS = "site string, parameter string, observed double, limit_value double, is_lower boolean"


def test_wqi(spark):
    rows = [("a", "pH", 8.5, 8.0, False), ("a", "pH", 7.5, 8.0, False), ("a", "Nitrate", 12.0, 10.0, False), ("b", "x", 1.0, 2.0, False), ("c", "x", float("nan"), 2.0, False)]
    got = {r["site"]: r["wqi"] for r in I.ccme_wqi(spark.createDataFrame(rows, TESTS)).collect()}
    assert got["a"] == pytest.approx(30.453772, abs=1e-5) and got["b"] == 100.0 and "c" not in got


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.floats(0, 100), st.floats(0, 100)), min_size=1, max_size=20))
def test_wqi_bounds(spark, tests):
    r = I.ccme_wqi(spark.createDataFrame([("s", p, a, b, False) for p, a, b in tests], TESTS)).first()
    assert 0 <= r["wqi"] <= 100


def test_veto(spark):
    rows = [("a", "p", 30.0, 10.0, False), ("a", "q", 25.0, 10.0, False), ("a", "r", 15.0, 10.0, False)]
    r = I.veto(spark.createDataFrame(rows, TESTS)).first()
    assert r["veto_parameters"] == "p,q" and r["worst_excursion"] == 2.0


def test_kaplan_meier(spark):
    rows = [("g", 2.0, False), ("g", 3.0, True), ("g", 4.0, False), ("g", 5.0, False), ("h", 1.0, True), ("h", 2.0, False), ("none", 1.0, True)]
    got = {r["k"]: r for r in C.kaplan_meier(spark.createDataFrame(rows, "k string, v double, c boolean"), "k", "v", "c").collect()}
    assert (got["g"]["km_mean"], got["g"]["km_median"]) == (3.25, 3.0) and got["h"]["smallest_censored"] and "none" not in got


def test_ros_is_close_to_the_truth(spark):
    rnd = random.Random(4)
    values = [math.exp(rnd.gauss(0, 1)) for _ in range(400)]
    rows = [("g", max(v, 1.0), v < 1.0) for v in values]
    r = C.summarize(spark.createDataFrame(rows, "k string, v double, c boolean"), "k", "v", "c").first()
    assert r["mean_method"] == "ros-lognormal" and abs(r["mean"] - sum(values) / 400) < 0.15
    few = C.summarize(spark.createDataFrame([("g", 1.0, True), ("g", 2.0, False)], "k string, v double, c boolean"), "k", "v", "c").first()
    assert few["mean_method"] == "kaplan-meier" and "ros-not-applicable" in few["warnings"]


def test_diversity(spark):
    r = E.diversity(spark.createDataFrame([("s", "a", 2), ("s", "b", 2), ("s", "c", 0), ("one", "a", 5)], "s string, t string, n int"), "s", "t", "n")
    got = {x["s"]: x for x in r.collect()}
    assert got["s"]["shannon"] == pytest.approx(math.log(2), abs=1e-6) and got["s"]["simpson"] == 0.5 and got["s"]["pielou"] == 1.0 and got["one"]["pielou"] is None


def test_kinds(spark):
    cases = [("12", None, "Q"), ("12.0", "", "Q"), ("1.5", None, "I"), ("-1", None, "I"), (None, None, "M"), ("5", "missingValue", "M"), ("5", "confirmedValue", "C"), ("5", "limitOfDetectionValue", "D"), ("5", "odd", "U"), (None, "odd", "U"), ("x", None, "I")]
    got = spark.createDataFrame([(v, s) for v, s, _ in cases], "v string, s string").select(X.value_kind(F.col("v"), F.col("s"))).collect()
    assert [r[0] for r in got] == [k for *_, k in cases]


def test_page_chain_stops_at_the_first_bad_page(spark):
    rows = [("a", 0, None, 5, [4, 5]), ("a", 1, 5, 7, [7]), ("a", 2, 6, 9, [9]), ("a", 3, 9, 11, [11]), ("b", 1, None, 2, [2])]
    got = X.page_chain(spark.createDataFrame(rows, "prefix string, seq int, after_uid long, last_uid long, uids array<long>")).orderBy("prefix", "seq").collect()
    assert [r["valid"] for r in got] == [True, True, False, False, False]


def test_seasons(spark):
    rows = [("W1", "IT", 2000, "1 - Excellent"), ("W1", "IT", 2001, "2 - Good"), ("W2", "IT", 2000, "4 - Poor"), ("W2", "IT", 2001, "3 - Sufficient"), ("W3", "IT", 2000, "2 - Good"), ("W4", "IT", 2000, None), ("W4", "IT", 2001, "2 - Good")]
    r = B.compare_seasons(spark.createDataFrame(rows, "bw_id string, country string, season int, quality string"), 2000, 2001).first()
    assert (r["n_paired"], r["moved_up"], r["moved_down"], r["unchanged"], r["not_comparable"], r["only_in_a"]) == (3, 1, 1, 0, 1, 1)


def annotations(spark, n=120, observers=5, seed=3):
    rnd = random.Random(seed)
    truth = [rnd.choice("abc") for _ in range(n)]
    right = [0.9, 0.85, 0.8, 0.6, 0.5]
    rows = [(i, f"o{j}", t if rnd.random() < right[j] else rnd.choice("abc")) for i, t in enumerate(truth) for j in range(observers)]
    return spark.createDataFrame(rows, "spec int, observer string, label string"), truth


def plain_dawid_skene(rows, classes, rounds):
    """The same model in plain Python."""
    specs, obs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    post = {s: {c: sum(1 for r in rows if r[0] == s and r[2] == c) / sum(1 for r in rows if r[0] == s) for c in classes} for s in specs}
    for _ in range(rounds):
        prior = {c: (sum(post[s][c] for s in specs) + 1) / (len(specs) + len(classes)) for c in classes}
        cm = {o: {c: {x: (sum(post[r[0]][c] for r in rows if r[1] == o and r[2] == x) + 1) / (sum(post[r[0]][c] for r in rows if r[1] == o) + len(classes)) for x in classes} for c in classes} for o in obs}
        for s in specs:
            w = {c: math.log(prior[c]) + sum(math.log(cm[r[1]][c][r[2]]) for r in rows if r[0] == s) for c in classes}
            top = max(w.values())
            z = sum(math.exp(v - top) for v in w.values())
            post[s] = {c: math.exp(v - top) / z for c, v in w.items()}
    return post


def test_dawid_skene_equals_plain_python(spark):
    ann, truth = annotations(spark)
    post, priors, trace = R.dawid_skene(ann, ["a", "b", "c"], max_iter=3, tol=-1e9)
    want = plain_dawid_skene([tuple(r) for r in ann.collect()], ["a", "b", "c"], 3)
    assert all(math.isclose(r["p"], want[r["spec"]][r["class"]], abs_tol=1e-9) for r in post.collect())
    assert trace == sorted(trace) and math.isclose(sum(priors.values()), 1)
    label = {r["spec"]: r["label"] for r in R.top_label(post, ["a", "b", "c"]).collect()}
    assert sum(label[i] == t for i, t in enumerate(truth)) / len(truth) > 0.85


def test_one_coin_and_votes(spark):
    ann, truth = annotations(spark)
    post, _, trace = R.one_coin(ann, ["a", "b", "c"], max_iter=4)
    assert trace == sorted(trace)
    sums = [r[0] for r in post.groupBy("spec").agg(F.sum("p")).select("sum(p)").collect()]
    assert all(math.isclose(s, 1) for s in sums)
    tie = spark.createDataFrame([(1, "x", "b"), (1, "y", "a")], "spec int, observer string, label string")
    assert R.majority_vote(tie, ["b", "a"]).first()["label"] == "b"
    with pytest.raises(ValueError):
        R.one_coin(ann, ["a", "b"])


def test_conformal(spark):
    scores = spark.createDataFrame([(float(k) / 100,) for k in range(1, 20)], "score double")
    assert R.kth_score(scores, 0.1).first()["cutoff"] == 0.18
    assert R.kth_score(scores.limit(5), 0.1).first()["cutoff"] == 1.0
    post = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.4), (2, "a", 0.95), (2, "b", 0.05)], "spec int, class string, p double")
    cuts = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "class string, cutoff double")
    assert {r["spec"]: r["classes"] for r in R.prediction_sets(post, cuts).collect()} == {1: ["a", "b"], 2: ["a"]}
    with pytest.raises(ValueError):
        R.assert_disjoint(post, post, "spec")


def test_river(spark):
    chain = spark.createDataFrame([("A", "B", 2.0), ("B", "C", 3.0), ("C", "D", 1.0), ("A", "C", 9.0), ("X", "A", 1.0)], "src string, dst string, km double")
    got = {r["node"]: r["risk"] for r in N.river_risk(chain, "A", 1.0, 0.1).collect()}
    assert got == {"A": 1.0, "B": pytest.approx(math.exp(-0.2)), "C": pytest.approx(math.exp(-0.5)), "D": pytest.approx(math.exp(-0.6)), "X": 0.0}
    with pytest.raises(ValueError, match="cycle"):
        N.river_risk(spark.createDataFrame([("A", "B", 1.0), ("B", "A", 1.0)], chain.schema), "A", 1.0, 0.1)
    with pytest.raises(ValueError):
        N.river_risk(spark.createDataFrame([("A", "B", 0.0)], chain.schema), "A", 1.0, 0.1)


def test_chain(spark):
    rows = spark.createDataFrame([("c", k, f"x{k}") for k in range(5)] + [("d", 0, "y")], "chain string, seq int, content string")
    linked = G.append_chain(rows)
    first = linked.filter("chain = 'c' AND seq = 0").first()
    assert first["hash"] == hashlib.sha256(b"|x0").hexdigest() and first["prev_hash"] is None
    bad = linked.withColumn("content", F.when((F.col("chain") == "c") & (F.col("seq") == 3), "z").otherwise(F.col("content")))
    assert {r["chain"]: (r["ok"], r["checked"], r["first_bad"]) for r in G.verify_chain(bad).collect()} == {"c": (False, 3, 3), "d": (True, 1, None)}
    pruned = linked.filter("chain = 'c' AND seq > 1")
    assert G.verify_chain(pruned).first()["ok"]
    gap = linked.filter("chain = 'c' AND seq <> 2")
    assert G.verify_chain(gap).first()["first_bad"] == 3


def test_review(spark):
    rows = [("i", 0, "decide", "a", ["a"], False), ("i", 1, "submit", None, ["a", "b"], False), ("i", 2, "decide", "z", None, False), ("i", 3, "decide", "a", None, False), ("i", 4, "decide", "b", None, False), ("i", 5, "decide", "other", None, True), ("i", 6, "submit", None, ["a", "b"], False), ("j", 0, "submit", None, ["a"], False)]
    q = G.review_queue(spark.createDataFrame(rows, "item string, seq int, action string, label string, classes array<string>, override boolean"))
    assert [r["outcome"] for r in q.orderBy("item", "seq").collect()] == ["refused-unknown-item", "pending", "refused-label", "decided", "refused-decided", "decided", "refused-decided", "refused-singleton"]
    assert {r["item"]: (r["status"], r["label"]) for r in G.review_state(q).collect()} == {"i": ("decided", "other")}


def test_numbers_in_texts(spark):
    texts = spark.createDataFrame([("a", "It rose by 12.3 to 1,250 and 7 (100%)."), ("b", None)], "id string, text string")
    evidence = spark.createDataFrame([("a", 12.34), ("a", 1250.0), ("b", 7.0)], "id string, value double")
    assert [(r["raw"], r["problem"]) for r in T.ungrounded(texts, evidence).collect()] == [("7", "ungrounded")]


def test_mentions(spark):
    cases = {
        "twenty-three of forty, then Nine": [("twenty three", 23.0, 0, None), ("forty", 40.0, 0, None), ("Nine", 9.0, 0, None)],
        "six point two five mg/L": [("six point two five", 6.25, 2, "mg/L")], "at -4.50 °C, pH-7, (3)-2": [("-4.50", -4.5, 2, "Cel"), ("7", 7.0, 0, None), ("3", 3.0, 0, None), ("2", 2.0, 0, None)],
        "1.2e-3 g / L or 5 milligrams per liter, 5 mg/Lx": [("1.2e-3", 0.0012, 4, "g/L"), ("5", 5.0, 0, "mg/L"), ("5", 5.0, 0, None)], "\u22125 µg/m³ and 12 percent": [("-5", -5.0, 0, "ug/m3"), ("12", 12.0, 0, "%")], "a million": [("million", 1e6, 0, None)],
        "two hundred five six": [("two", 2.0, 0, None), ("hundred", 100.0, 0, None), ("five six", 11.0, 0, None)], "\uff15\uff0e\uff15 \u338e": [("5.5", 5.5, 1, None)], "10\u00b2 at \u2460": [("102", 102.0, 0, None), ("1", 1.0, 0, None)],
        "a hundred point five": [("hundred", 100.0, 0, None), ("five", 5.0, 0, None)], "- twenty one point zero two %": [("twenty one point zero two", 21.02, 2, "%")],
    }
    got = {}
    for r in T.mentions(spark.createDataFrame([(t, t) for t in cases], "id string, text string")).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["raw"], r["value"], r["decimals"], r["unit"]))
    assert got == cases


def test_grounding_rules(spark):
    facts = [("a", 0.25, None), ("a", 40.0, "%"), ("a", 6.0, "mg/L"), ("a", 0.125, None)]
    evidence = spark.createDataFrame(facts, "id string, value double, unit string")
    cases = {
        "25% of it": None, "25 mg/L": "ungrounded", "40 percent": None, "41 percent": "ungrounded", "6 mg/L": None, "6 ug/L": "unit-mismatch", "6": None, "two points": None, "2 samples": "ungrounded", "eleven points": "ungrounded", "0.13": None, "0.12": None, "0.11": "ungrounded", "4 of them": None,
    }
    texts = spark.createDataFrame([(t, t) for t in cases], "id string, text string")
    own = evidence.drop("id").crossJoin(texts.select("id"))
    counts = texts.select("id", F.lit(4).alias("n"))
    got = {r["id"]: r["problem"] for r in T.ungrounded(texts, own, counts=counts).collect()}
    assert got == {t: p for t, p in cases.items() if p}


def test_partial_times(spark):
    cases = ["2024", "2024-03", "2024-03-31", "2024-03-31T02:30:00", "2024-10-27T02:30:00", "2024-10-27T02:30:00+02:00", "2024-01-01T00:00:00Z", "x", "2024-02-30"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(T.partial_time(F.col("t"), "Europe/Rome").alias("p")).select(F.col("p.start").cast("string"), F.col("p.end").cast("string"), "p.issue").collect()
    assert tuple(got[2]) == ("2024-03-30 23:00:00", "2024-03-31 22:00:00", None)  # 23 hours
    assert [r[2] for r in got] == [None, None, None, "skipped-local-time", "repeated-local-time", None, None, "form", "no-such-time"]
    assert got[5][0] == "2024-10-27 00:30:00"


def test_country_from_ancestors(spark):
    rows = [(str(k), "Basin (Campania, IT)" if k == 0 else "x", None if k == 0 else str(k - 1)) for k in range(8)]
    got = {r["id"]: r["country"] for r in I.location_country(spark.createDataFrame(rows, "id string, description string, parent string"), {}).collect()}
    assert got["5"] == "IT" and got["6"] is None


def test_near_points_equal_the_full_join(spark):
    rnd = random.Random(2)
    at = lambda n: [(k, rnd.uniform(-82, 82), rnd.uniform(-179, 179) / 30) for k in range(n)]
    points, places = at(300), at(40)
    got = {(r["place"], r["point"]) for r in L.near_points(spark.createDataFrame(points, "point int, lat double, lon double"), spark.createDataFrame(places, "place int, lat double, lon double"), 300.0).collect()}
    step = 300 / 111.32
    want = {(p, q) for p, la, lo in places if abs(la) <= 80 and abs(lo) + step / math.cos(math.radians(la)) <= 180 for q, a, o in points if abs(a - la) <= step and abs(o - lo) <= step / math.cos(math.radians(la))}
    assert got == want and want


def test_uuid5_and_resources(spark):
    name = "7|A|1999"
    got = spark.createDataFrame([(7, "A", 1999, 2.0000004, "mg/L"), (7, "A", 1999, 2.0000004, "mg/L"), (8, "A", 1999, None, "mg/L")], "site int, parameter string, period int, value double, unit string")
    r = writers.observations(got, "site", "parameter", "value", "unit", "period").collect()
    assert len(r) == 1 and r[0]["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, name)) and '"value":2.0,' in r[0]["json"]


def test_readers(spark, tmp_path):
    from hydrolake.operators.measurements import NAMES

    names = list(NAMES)
    header = ",".join(reversed(names))
    good = dict(zip(names, ("IT", "S1", "RW", "CAS_14797-55-8", "W", "mg{NO3}/L", "2015-03-01", "4.5", "0", "A", "A")))
    lines = ["﻿" + header, ",".join(good[n] for n in reversed(names)), "A,A", ",".join(good[n] if n != "monitoringSiteIdentifier" else '"S\n2"' for n in reversed(names))]
    (tmp_path / "m.csv").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    df = readers.read_measurements(spark, f"file://{tmp_path}/m.csv")
    rows = df.collect()
    assert [r["_malformed"] for r in rows] == [False, True, False] and rows[2]["monitoringSiteIdentifier"] == "S\n2"
    with pytest.raises(ValueError, match="missing"):
        readers.read_sites(spark, f"file://{tmp_path}/m.csv")
    manifest = spark.createDataFrame([("m.csv", hashlib.sha256((tmp_path / "m.csv").read_bytes()).hexdigest()), ("n.csv", "0")], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in readers.verify_manifest(spark, f"file://{tmp_path}", manifest).collect()} == {"m.csv": "ok", "n.csv": "missing"}


def test_store_refuses_to_be_empty(spark, tmp_path):
    df = spark.createDataFrame([("IT", 2), ("GR", 1)], "country string, k int")
    writers.write_store(df, f"file://{tmp_path}/s", ["country", "k"])
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 2
    with pytest.raises(ValueError):
        writers.write_store(df.limit(0), f"file://{tmp_path}/t", ["k"])


def test_nested_observations(spark, tmp_path):
    def obs(i, **more):
        return {"id": i, "resourceType": "Observation", "status": "final", "meta": {"profile": ["http://x/observation-indicators-guide"]}, "code": {"coding": [{"code": "nitrate"}]}, "subject": {"reference": "Location/L1"}, "performer": [{"reference": "p"}], "effectiveDateTime": "2020-01-01"} | more

    import json

    q = lambda v, **m: {"value": v, "code": "mg/L", "system": "http://unitsofmeasure.org"} | m
    stat = lambda k, v: {"code": {"coding": [{"code": k}]}, "valueQuantity": q(v)}
    rows = [obs("a", valueQuantity=q(60.0)), obs("b", component=[stat("minimum", 1.0), stat("median", 5.0), stat("maximum", 9.0)]), obs("c", component=[stat("minimum", 7.0), stat("median", 5.0)]), obs("d"), obs("e", valueQuantity=q(5.0, comparator="<")), obs("f", valueQuantity=q(5.0), meta={"tag": [{"code": "demo"}], "profile": ["y"]})]
    for r in rows:
        (tmp_path / f"{r['id']}.json").write_text(json.dumps(r))
    df = readers.read_observations(spark, f"file://{tmp_path}/*.json")
    got = {r["id"]: (r["quantity"]["value"] if r["quantity"] else None, r["quantity_reason"]) for r in I.representative(df).collect()}
    assert got == {"a": (60.0, None), "b": (5.0, None), "c": (None, "qc-inconsistent"), "d": (None, "no-quantity"), "e": (5.0, None), "f": (5.0, None)}
    places = spark.createDataFrame([("L1", "n", "x (IT)", None, None, None)], readers.LOCATION)
    scores, counts = I.site_index(df, places)
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"scored": 3, "qc-inconsistent": 1, "no-quantity": 1, "other-profile": 1}
    r = scores.first()
    assert (r["n_tests"], r["n_failed"], r["confidence"]) == (3, 1, "low")
    reasons = {x["id"]: x["r"] for x in df.select("id", G.official_reason().alias("r")).collect()}
    assert reasons["f"] == "tag-demo" and reasons["a"] is None


def test_figures(spark):
    rows = [(1234.5, 3, 1230.0), (0.0, 2, 0.0), (-0.04567, 2, -0.046), (99.95, 3, 100.0)]
    got = spark.createDataFrame(rows, "x double, f int, w double").select(S.round_figures(F.col("x"), F.col("f")), "w").collect()
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in got)
    r = spark.range(1).select(L.approximate(F.lit(1.234), F.lit(9.871), F.lit(6)).alias("r")).select("r.*").first()
    assert (r["low"], r["high"]) == (pytest.approx(1.2), pytest.approx(9.9))


def test_units(spark):
    cases = [(1.0, "mg/L", "ug/L", 1000.0), (2.0, "ng/l", "ug/L", 0.002), (1.0, "mg/L", "uS/cm", None), (7.0, None, "pH", 7.0), (1.0, None, "mg/L", None)]
    got = spark.createDataFrame(cases, "v double, a string, b string, w double").select(S.convert_unit(F.col("v"), F.col("a"), F.col("b")), "w").collect()
    assert all((a is None and b is None) or math.isclose(a, b) for a, b in got)


def test_figures_of_exact_decimals(spark):
    rows = [(1.005, 3, 1.01, 1.0, 1.01), (-1.005, 3, -1.01, -1.01, -1.0), (0.9996, 3, 1.0, 0.999, 1.0), (123456789012.0, 2, 1.2e11, 1.2e11, 1.3e11), (1e-7, 2, 1e-7, 1e-7, 1e-7), (0.0, 2, 0.0, 0.0, 0.0), (float("nan"), 2, None, None, None)]
    x, f = F.col("x"), F.col("f")
    got = spark.createDataFrame([r[:2] for r in rows], "x double, f int").select(*[S.round_figures(x, f, m).alias(m) for m in ("nearest", "down", "up")]).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


def test_values_stay_in_their_range(spark):
    rows = [(0.9996, 6, 0.2, 0.9998, 0.9996), (12.34, 3, None, None, 12.0), (12.34, 25, 12.0, 13.0, 12.3), (1.0, 5, 1.0, 1.0, 1.0), (2.345, 4, 2.341, 2.349, 2.345)]
    got = spark.createDataFrame([r[:4] for r in rows], "v double, n int, low double, high double").select(L.approximate_value(F.col("v"), F.col("n"), F.col("low"), F.col("high")).alias("x")).collect()
    assert [r["x"] for r in got] == [r[4] for r in rows]


def plain_positions(values):
    """Plotting positions straight from their definition, for (value, censored) pairs."""
    limits = sorted({v for v, c in values if c})
    seen = sorted(v for v, c in values if not c)
    share = [0.0] * (len(limits) + 1) + [1.0]
    for j in range(len(limits), 0, -1):
        top = limits[j] if j < len(limits) else math.inf
        a = sum(limits[j - 1] <= v < top for v in seen)
        b = sum(v < limits[j - 1] for v in seen) + sum(c and v <= limits[j - 1] for v, c in values)
        share[j] = share[j + 1] * b / (a + b)
    out = []
    for j in range(len(limits) + 1):
        own = [v for v in seen if (j == 0 or v >= limits[j - 1]) and (j == len(limits) or v < limits[j])]
        out += [(v, True, share[j] + (share[j + 1] - share[j]) * k / (len(own) + 1)) for k, v in enumerate(own, 1)]
    for j, limit in enumerate(limits, 1):
        n = sum(c and v == limit for v, c in values)
        out += [(limit, False, share[j] * k / (n + 1)) for k in range(1, n + 1)]
    return sorted(out)


def test_plotting_positions(spark):
    rnd = random.Random(6)
    values = [(float(rnd.randint(1, 12)), rnd.random() < 0.4) for _ in range(80)]
    got = C.plotting_positions(spark.createDataFrame([("g", *v) for v in values], "v string, x double, slot boolean"), "v", "x", "slot").collect()
    want = plain_positions(values)
    assert [r[:2] for r in sorted((r["v"], r["seen"], r["position"]) for r in got)] == [w[:2] for w in want]
    assert all(math.isclose(a[2], b[2], abs_tol=1e-12) for a, b in zip(sorted((r["v"], r["seen"], r["position"]) for r in got), want))


def test_order_statistics_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGES", 8)
    rnd = random.Random(7)
    rows = [(g, rnd.choice([rnd.random(), 0.0, 1.0, 0.5, rnd.random() / 1000])) for g in "abc" for _ in range(rnd.randint(5, 120))]
    df = spark.createDataFrame(rows, "g string, score double")
    for alpha in (0.1, 0.25, 0.5):
        got = {r["g"]: r["cutoff"] for r in R.kth_score(df, alpha, ["g"]).collect()}
        for g in "abc":
            own = sorted(s for k, s in rows if k == g)
            k = math.ceil((len(own) + 1) * (1 - alpha) - 1e-9)
            assert got[g] == (1.0 if k > len(own) or len(own) < math.ceil(1 / alpha) else own[k - 1])
        every = sorted(s for _, s in rows)
        assert R.kth_score(df, alpha).first()["cutoff"] == every[math.ceil((len(every) + 1) * (1 - alpha) - 1e-9) - 1]


def test_overrides(spark):
    base = [("drinking", None, "Nitrate", "mg/L", [50.0]), ("drinking", None, "pH", "pH", [6.5, 9.5])]
    schema = "regime string, country string, parameter string, unit string, values array<double>"
    good = spark.createDataFrame([("surface", "IT", "Nitrate", "mg/L", [5.0], "law"), ("drinking", None, "pH", "pH", [7.0, 9.0], "own")], schema + ", source string")
    got = {(r["regime"], r["parameter"]): (r["values"], r["basis"]) for r in I.overlay_limits(spark.createDataFrame(base, schema), good).collect()}
    assert got == {("drinking", "Nitrate"): ([50.0], None), ("drinking", "pH"): ([7.0, 9.0], "override: own"), ("surface", "Nitrate"): ([5.0], "override: law")}
    with pytest.raises(ValueError, match="1 overrides"):
        I.overlay_limits(spark.createDataFrame(base, schema), good.withColumn("unit", F.when(F.col("parameter") == "pH", "pH").otherwise("ug/L")))
    with pytest.raises(ValueError, match="2 stand"):
        I.overlay_limits(spark.createDataFrame(base, schema), good.union(good))


def test_oxygen_is_judged_by_saturation(spark, tmp_path):
    import json

    def obs(i, code, value, unit, site="R", when="2020-05", **more):
        q = {"value": value, "code": unit, "system": "http://unitsofmeasure.org"} | more
        return {"id": i, "resourceType": "Observation", "status": "final", "meta": {"profile": ["http://x/observation-indicators-guide"]}, "code": {"coding": [{"code": code}]}, "subject": {"reference": f"Location/{site}"}, "effectiveDateTime": when, "valueQuantity": q}

    rows = [
        obs("a", "dissolved-oxygen", 9.0, "mg/L"), obs("b", "water-temperature", 20.0, "Cel"), obs("c", "dissolved-oxygen", 9.0, "mg/L", when="2020-06"), obs("d", "dissolved-oxygen", 9.0, "mg/L", when="2020-07"), obs("e", "water-temperature", 10.0, "Cel", when="2020-07"),
        obs("f", "water-temperature", 12.0, "Cel", when="2020-07"), obs("g", "dissolved-oxygen", 9.0, "mg/L", when="2020-08"), obs("h", "water-temperature", 60.0, "Cel", when="2020-08"), obs("i", "dissolved-oxygen", 9.0, "mg/L", comparator="<"), obs("j", "cadmium-dissolved", 1.0, "ug/L"),
        obs("k", "ph", 15.0, "pH"), obs("l", "nitrate", 1.0, "kg"), obs("m", "nitrate", 1.0, "mg/L", comparator="<"), obs("n", "dissolved-oxygen", 9.0, "mg/L", site="D"),
    ]
    for r in rows:
        (tmp_path / f"{r['id']}.json").write_text(json.dumps(r))
    df = readers.read_observations(spark, f"file://{tmp_path}/*.json")
    river = [{"coding": [{"code": "420531007"}]}]
    places = spark.createDataFrame([("R", "n", "x (IT)", river, None, None), ("D", "n", "x (IT)", None, None, None)], readers.LOCATION)
    scores, counts = I.site_index(df, places)
    assert {r["reason"]: (r["n"], r["n_by_bound"]) for r in counts.collect()} == {
        "scored": (3, 1), "interpretive-only": (4, 0), "no-temperature-for-saturation": (1, 0), "ambiguous-temperature-for-saturation": (1, 0), "unusable-temperature-for-saturation": (1, 0), "indeterminate": (1, 0),
        "surface-limit-needs-hardness": (1, 0), "physically-impossible": (1, 0), "unit-mismatch": (1, 0),
    }
    by = {r["site"]: r for r in scores.collect()}
    assert (by["R"]["n_tests"], by["R"]["regime"], by["R"]["country"], by["R"]["n_excluded"], by["R"]["n_scorable"]) == (2, "surface", "IT", 5, 8)
    assert by["R"]["confidence"] == "low" and (by["D"]["regime"], by["D"]["n_tests"]) == ("drinking", 1)


def test_reference_types(spark):
    cases = {"Location/1": "Location", "https://x.org/fhir/Location/1/_history/2": "Location", "urn:uuid:1": None, "#here": None, "Location": None, "x.org/Patient/7?a=b/c": "Patient"}
    got = spark.createDataFrame([(c,) for c in cases], "r string").select("r", G.reference_type(F.col("r")).alias("t")).collect()
    assert {r["r"]: r["t"] for r in got} == cases


def test_confusion_distance_and_runs(spark):
    ann = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "x", "b")], "spec int, observer string, label string")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "spec int, class string")
    cm = {(r["class"], r["label"]): r["p"] for r in R.confusion(ann, truth, classes=["a", "b"]).collect()}
    assert cm == {("a", "a"): 0.5, ("a", "b"): 0.5, ("b", "a"): 0.0, ("b", "b"): 1.0}
    exact = spark.createDataFrame([("x", "a", "a", 1.0), ("x", "b", "b", 1.0)], "observer string, class string, label string, p double")
    assert R.confusion_distance(R.confusion(ann, truth), exact).first()["distance"] == pytest.approx(math.sqrt(0.5))
    runs = R.over_runs(spark.createDataFrame([(1, 0.5, 0.25), (2, 1.0, 1.0)], "run int, a double, b double"), ["a"], "a", "b").first()
    assert (runs["a_mean"], runs["a_std"], runs["win_fraction"], runs["n_runs"]) == (0.75, 0.25, 0.5, 2)
