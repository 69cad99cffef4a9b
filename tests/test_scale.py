"""Operators that spread a hot group over tasks, against plain Python."""

import datetime
import hashlib
import json
import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from hydrolake.operators import bathing as B
from hydrolake.operators import censored as C
from hydrolake.operators import exact, governance as G
from hydrolake.operators import index as I
from hydrolake.operators import limits as L
from hydrolake.operators import listing, measurements as M
from hydrolake.operators import network as N
from hydrolake.operators import order as O
from hydrolake.operators import reliability as R
from hydrolake.operators import samples as X
from hydrolake.sources import readers, writers


def doubles(n, seed, most=1e300):
    rnd, out = random.Random(seed), []
    while len(out) < n:
        x = struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0]
        if math.isfinite(x) and abs(x) < most:
            out.append(x)
    return out


def test_exact_sums(spark):
    rnd = random.Random(1)
    groups = {0: doubles(80, 2), 1: [rnd.uniform(-1, 1) * 10 ** rnd.randint(-20, 20) for _ in range(60)], 2: [rnd.uniform(-1, 1) * 2.0 ** rnd.randint(-1074, -1000) for _ in range(40)]}
    x = [rnd.uniform(-1, 1) * 10 ** rnd.randint(-5, 5) for _ in range(30)]
    groups |= {3: [*x, *(-y for y in x), 2.0**-40], 4: [1.0, 2.0**-53], 5: [1.0, 2.0**-53, 2.0**-93], 6: [1.0 + 2.0**-52, 2.0**-53], 7: [0.0, -0.0], 8: [5e-324] * 3, 9: [1e300, -1e300, 3.0], 10: [2.0**53, 1.0, 1.0]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [(11, None), (12, float("inf")), (12, 1.0), (13, float("nan"))]
    rnd.shuffle(rows)
    got = {r["g"]: r["exact_sum"] for r in exact.exact_sum(spark.createDataFrame(rows, "g int, x double").repartition(3), ["g"], "x").collect()}
    assert {g: got[g] for g in groups} == {g: math.fsum(v) for g, v in groups.items()}
    assert got[11] is None and got[12] == math.inf and math.isnan(got[13])
    assert exact.exact_sum(spark.createDataFrame([], "g int, x double"), ["g"], "x").count() == 0


def test_order_keys_and_medians(spark):
    values = [*doubles(500, 3, math.inf), 0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, *(2.0**k for k in range(-1074, 1024, 7))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", O.order_key(F.col("v"))).withColumn("b", O.key_value(F.col("k"))).collect()
    assert all(r["b"] == r["v"] for r in rows)
    placed = sorted(rows, key=lambda r: r["v"])
    assert all(a["k"] < b["k"] or a["v"] == b["v"] for a, b in zip(placed, placed[1:]))
    rnd = random.Random(4)
    groups = {"a": [rnd.choice([1.5, 2.5, -3.0, rnd.gauss(0, 1e9)]) for _ in range(501)], "b": [rnd.gauss(0, 1) for _ in range(400)], None: [float(rnd.randint(0, 5)) for _ in range(300)], "c": [7.0]}
    df = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own] + [("d", None), ("a", float("nan"))], "g string, v double").repartition(3)
    got = {r["g"]: r["median"] for r in O.medians(df, ["g"], "v", large=100).collect()}
    assert got == {k: pytest.approx(statistics.median(v), rel=1e-15) for k, v in groups.items()}


def test_kaplan_meier_over_ranges(spark):
    rnd = random.Random(5)
    rows = [(f"g{g}", float(rnd.randint(1, 8)) if rnd.random() < 0.6 else rnd.random() * 9, rnd.random() < 0.3) for g in range(12) for _ in range(rnd.randint(1, 40))]
    rows += [("half", float(x), False) for x in (1, 2, 3, 4)] + [("low", 1.0, True), ("low", 2.0, False), (None, 1.0, False), (None, 3.0, False)]
    df = spark.createDataFrame(rows, "k string, v double, c boolean")
    folded = {tuple(r) for r in C.kaplan_meier(df, "k", "v", "c").collect()}
    for large, ranges in ((0, 5), (10, 64)):
        assert {tuple(r) for r in C.kaplan_meier(df, "k", "v", "c", large=large, ranges=ranges).collect()} == folded


def test_masks_of_months(spark):
    rows = [("a", p, p % 3 > 0) for p in range(24000, 24150, 2)] + [("b", 24149, True), ("b", 23999, True)]
    df = spark.createDataFrame(rows, "k string, pos int, ok boolean")
    got = {r["k"]: r["n"] for r in df.groupBy("k").agg(M.mask_size(F.array(*M.month_mask(F.col("pos"), F.col("ok"), [("w", 24000, 24149)]))).alias("n")).collect()}
    assert got == {"a": len({p for k, p, ok in rows if k == "a" and ok}), "b": 1}


def test_consent_sweep(spark):
    rnd, day = random.Random(6), datetime.datetime(2020, 1, 1)
    at = lambda: day + datetime.timedelta(days=rnd.randrange(400))
    consents = []
    for _ in range(60):
        a = at()
        consents.append((rnd.choice("xyz"), rnd.choice(["s", "t"]), a, rnd.choice([None, a, a + datetime.timedelta(days=rnd.randrange(90))])))
    records = [(k, rnd.choice(["x", "y", "z", None]), rnd.choice(["s", "t"]), at()) for k in range(200)] + [(900, "x", "s", None)]
    want = sorted(k for k, s, c, t in records if any(s == a and c == b and t is not None and g <= t and (r is None or t < r) for a, b, g, r in consents))
    c = spark.createDataFrame(consents, "subject string, scope string, granted_at timestamp, revoked_at timestamp")
    r = spark.createDataFrame(records, "id int, subject string, scope string, at timestamp")
    got = G.consent_active(r, c)
    assert got.columns == r.columns and sorted(x["id"] for x in got.collect()) == want
    with pytest.raises(ValueError):
        G.consent_active(r, c.withColumn("revoked_at", F.col("granted_at") - F.expr("interval 1 day")))


def test_links_of_chains_equal_a_walk(spark):
    def link(before, content):
        return hashlib.sha256(f"{before or ''}|{content}".encode()).hexdigest()

    rnd, rows, want = random.Random(7), [], {}
    for chain in range(40):
        own, before = [], None
        for seq in range(rnd.randint(1, 8)):
            own.append([chain, seq, f"c{seq}", before, link(before, f"c{seq}")])
            before = own[-1][4]
        harm = rnd.choice(["none", "content", "prev", "drop", "fork", "prune", "unhashed"])
        k = rnd.randrange(len(own))
        if harm == "content":
            own[k][2] += "!"
        elif harm == "prev":
            own[k][3] = "0" * 64
        elif harm == "drop" and len(own) > 2:
            del own[1]
        elif harm == "fork" and len(own) > 2:
            own[2][3], own[2][4] = own[0][4], link(own[0][4], own[2][2])
        elif harm == "prune":
            own = own[k:]
        elif harm == "unhashed":
            own.insert(0, [chain, -1, "old", None, None])
        seen = [r for r in own if r[4]]
        bad = next((i for i, r in enumerate(seen) if r[4] != link(r[3], r[2]) or (i and r[3] != seen[i - 1][4])), None)
        want[chain] = (bad is None, len(seen) if bad is None else bad, None if bad is None else seen[bad][1])
        rows += own
    rnd.shuffle(rows)
    got = G.verify_chain(spark.createDataFrame([tuple(r) for r in rows], "chain int, seq int, content string, prev_hash string, hash string"))
    assert {r["chain"]: (r["ok"], r["checked"], r["first_bad"]) for r in got.collect()} == want


def test_contracted_rivers(spark):
    chain = [(f"n{k}", f"n{k + 1}", 1.0) for k in range(300)] + [("n10", "side", 5.0), ("side", "n200", 500.0), ("n300", "m", 2.0), ("far", "n50", 1.0)]
    got = {r["node"]: r["km"] for r in N.river_risk(spark.createDataFrame(chain, "src string, dst string, km double"), "n5", 1.0, 0.1).collect()}
    assert got["n5"] == 0 and got["n300"] == 295 and got["m"] == 297 and got["side"] == 10 and got["n0"] is None and got["far"] is None and got["n4"] is None and got["n6"] == 1
    for loop in ([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("s", "t", 1.0)], [("s", "a", 1.0), ("a", "b", 1.0), ("b", "a", 1.0)]):
        with pytest.raises(ValueError, match="cycle"):
            N.river_risk(spark.createDataFrame(loop, "src string, dst string, km double"), "s", 1.0, 0.1)


def test_far_pages(spark, monkeypatch):
    rows = [(k * 7919 % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int")
    monkeypatch.setattr(listing, "NEAR", 50)
    for offset in (0, 45, 333, 990, 2000):
        got = listing.page(df, [F.desc("a"), F.col("b")], 20, offset).collect()
        assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1]))[offset : offset + 20]
        assert all(r["total_matching"] == 1000 and r["truncated"] == (offset + 20 < 1000) for r in got)


def test_page_files(spark, tmp_path):
    def page(prefix, seq, after, uids, **more):
        rows = [{"UID": u, "season": "2020", "bathingWaterIdentifier": f"{prefix}X", "sampleDate": "2020-06-01", "escherichiaColiValue": "5"} for u in uids]
        body = {"format": 1, "prefix": prefix, "template_sha256": "t", "seq": seq, "after_uid": after, "last_uid": uids[-1] if uids else after, "rows": rows} | more
        (tmp_path / f"{prefix}-{seq:05d}.json").write_text(json.dumps(body, indent=1))

    page("IT", 1, 0, [1, 2]), page("IT", 2, 2, [5]), page("IT", 3, 5, [9, 11])
    page("GR", 1, 0, [3]), page("GR", 2, 4, [6]), page("GR", 3, 6, [7])
    page("NO", 2, 0, [1]), page("FR", 1, 0, [2], last_uid=8), page("DE", 1, 0, [])
    chain = X.page_chain(readers.read_sample_pages(spark, f"file://{tmp_path}"), 1, 0)
    assert {(r["prefix"], r["seq"]): r["valid"] for r in chain.collect()} == {("IT", 1): True, ("IT", 2): True, ("IT", 3): True, ("GR", 1): True, ("GR", 2): False, ("GR", 3): False, ("NO", 2): False, ("FR", 1): False, ("DE", 1): False}
    counts = lambda n: spark.createDataFrame([("IT", 5), ("GR", n)], "prefix string, n long")
    rows = readers.samples_of(chain, counts(1))
    assert sorted(r["uid"] for r in rows.collect()) == [1, 2, 3, 5, 9, 11]
    kept = X.normalise(rows)
    assert kept.filter("reason IS NULL").count() == 6 and {r["ec_kind"] for r in kept.collect()} == {"Q"}
    with pytest.raises(ValueError, match="GR"):
        readers.samples_of(chain, counts(3))


def test_classification_files(spark, tmp_path):
    head = ["﻿quality", "season", *[c for c in readers.CLASSIFICATION_COLUMNS if c not in ("quality", "season")], "extra"]
    row = {"quality": "1 - Excellent", "season": "2020", "countryCode": "EL", "bathingWaterIdentifier": " W1 ", "groupIdentifier": "G", "bathingWaterName": 'A "quoted"\nname', "bathingWaterType": "lake", "geographicalConstraint": "", "lon": "20", "lat": "40", "bwProfile": "ftp://x", "monitoringCalendar": "c", "management": "m", "extra": "e"}
    cells = ['"' + str(row[h.lstrip("﻿")]).replace('"', '""') + '"' for h in head]
    (tmp_path / "c.csv").write_text(",".join(head) + "\r\n" + ",".join(cells) + "\r\n", encoding="utf-8")
    got = B.clean(readers.read_classifications(spark, f"file://{tmp_path}/c.csv")).first()
    assert (got["country"], got["bw_id"], got["season"], got["group_id"], got["type"], got["constraint"], got["profile"], got["lat"], got["reason"]) == ("GR", "W1", 2020, "G", "lake", None, None, 40.0, None)
    assert got["name"] == 'A "quoted"\nname'
    (tmp_path / "d.csv").write_text("quality,season\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_classifications(spark, f"file://{tmp_path}/d.csv")


@pytest.mark.parametrize("size", [16, 40, 1 << 20])
def test_quoted_records_of_many_splits(spark, tmp_path, size):
    """Whatever the splits, the records are those of a reader that takes the file as one."""
    import csv
    import io

    rnd = random.Random(9)
    wanted, files = [], []
    for k in range(3):
        rows = [["".join(rnd.choice(["a", "é", '"', ",", "\n", "\r\n", " ", "x" * 20, ""]) for _ in range(rnd.randint(1, 8))) for _ in range(3)] for _ in range(40)]
        text = io.StringIO()
        csv.writer(text, lineterminator="\r\n" if k else "\n", quoting=csv.QUOTE_ALL).writerows([["p", "q", "s"], *rows])
        body = text.getvalue().replace("s\"\r\n", 's"\r\n\r\n', 1) + ('"open,1\n2' if k == 2 else "")
        (tmp_path / f"{k}.csv").write_text(body, newline="")
        wanted += [[c.replace("\r\n", "\n") or None for c in r] for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [list(r) for r in readers._csv(spark, f"file://{tmp_path}", ("p", "q", "s")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(r[3] for r in got) == 1  # the open quote
    assert sorted((r[:3] for r in got if not r[3]), key=str) == sorted(wanted, key=str)


def test_provenance(spark):
    dropped = spark.createDataFrame([("date",), ("date",), (None,), ("unit",)], "reason string")
    got = {r["key"]: r["value"] for r in writers.provenance(dropped, edition="7").collect()}
    assert json.loads(got["counters"]) == {"date": 2, "kept": 1, "unit": 1} and got["edition"] == "7"


OVERRIDES = "regime string, country string, parameter string, unit string, values array<double>, source string"


@pytest.mark.parametrize(
    "row, problem",
    [
        (("surface", None, "pH", "pH", [8.0], "s"), None), (("surface", "IT", "pH", "pH", [7.0, 8.0], "s"), "number-of-values"), (("drinking", None, "Lead dissolved", "ug/L", [9.0, 4.0], "s"), None), (("drinking", None, "Lead dissolved", "ug/L", [9.0], "s"), None),
        (("drinking", None, "pH", "pH", [8.0], "s"), "number-of-values"), (("drinking", None, "pH", "pH", [9.0, 8.0], "s"), "order-of-values"), (("drinking", "IT", "Nitrate", "mg/L", [9.0], "s"), "country"), (("surface", "it", "Nitrate", "mg/L", [9.0], "s"), "country"),
        (("surface", None, "Nitrate", "mg/L", [0.0], "s"), "value"), (("surface", None, "Gold", "mg/L", [1.0], "s"), "parameter"), (("surface", "GR", L.SATURATION, "%", [15.0], "s"), None), (("drinking", None, L.SATURATION, "%", [15.0], "s"), "no-drinking-limit"), (("surface", None, "Nitrate", "mg/L", [1.0], " "), "source"),
    ],
)
def test_override_rules(spark, row, problem):
    assert L.check_overrides(spark.createDataFrame([row], OVERRIDES)).first()["problem"] == problem


def test_overrides_reach_scores_and_bases(spark, tmp_path):
    def obs(i, code, value, unit, site):
        return {"id": i, "resourceType": "Observation", "status": "final", "meta": {"profile": ["http://x/observation-indicators-guide"]}, "code": {"coding": [{"code": code}]}, "subject": {"reference": f"Location/{site}"}, "effectiveDateTime": "2040-05", "valueQuantity": {"value": value, "code": unit, "system": "http://unitsofmeasure.org"}}

    rows = [obs("a", "nitrate", 4.0, "mg/L", "R"), obs("b", "lead-dissolved", 4.5, "ug/L", "D"), obs("c", "ph", 6.0, "pH", "D"), obs("d", "sulphate", 200.0, "mg/L", "R")]
    for r in rows:
        (tmp_path / f"{r['id']}.json").write_text(json.dumps(r))
    df = readers.read_observations(spark, f"file://{tmp_path}/*.json")
    river = json.dumps([{"coding": [{"code": "420531007"}]}])
    (tmp_path / "places.txt").write_text(f'[{{"id": "R", "description": "x (IT)", "type": {river}}}, {{"id": "D", "description": "y (IT)"}}]')
    places = readers.read_locations(spark, f"file://{tmp_path}/places.txt")
    fixed = L.limit_rows(spark)
    wanted = spark.createDataFrame([("surface", "IT", "Nitrate", "mg/L", [3.0], "study"), ("drinking", None, "Lead dissolved", "ug/L", [9.0, 4.0], "plan"), ("drinking", None, "pH", "pH", [5.0, 9.0], "plant"), ("drinking", None, "Sulphate", "mg/L", [100.0], "plant")], OVERRIDES)
    failed = lambda limits: {r["site"]: r["n_failed"] for r in I.site_index(df, places, limits=limits)[0].collect()}
    assert failed(fixed) == {"R": 0, "D": 1} and failed(L.with_overrides(fixed, wanted)) == {"R": 2, "D": 1}
    signed = spark.createDataFrame([("surface", "IT", "Nitrate", "mg/L", [3.0]), ("drinking", None, "pH", "pH", [6.0, 9.0])], "regime string, country string, parameter string, unit string, values array<double>")
    bases = {r["site"]: r["limit_basis"] for r in I.site_index(df, places, limits=L.with_overrides(fixed, wanted), signatures=signed)[0].collect()}
    assert bases["R"] == {"Nitrate": "override: study; verified", "Sulphate": "override: plant (drinking-water value used on a river site); unverified"}
    assert bases["D"] == {"Lead dissolved": "override: plan; unverified", "pH": "override: plant; stale"}
    with pytest.raises(ValueError, match="1 overrides"):
        L.with_overrides(fixed, wanted.withColumn("unit", F.when(F.col("parameter") == "pH", "x").otherwise(F.col("unit"))))


def test_explicit_reference_types(spark):
    rows = [("Patient/1", None, "Patient"), ("Patient/1", "Location", "Location"), (None, "Group", "Group"), ("Group/_history/2", None, None), ("a//b/", None, "a"), ("?x/y", None, None), ("x/y/_history", None, "x"), ("_history/1/2", None, None)]
    got = spark.createDataFrame([r[:2] for r in rows], "r string, t string").select("r", "t", G.reference_type(F.col("r"), F.col("t")).alias("k")).collect()
    assert [tuple(r) for r in got] == rows


def test_patterns_of_annotations(spark):
    rnd = random.Random(8)
    ann = [(s, f"o{j}", rnd.choice("ab")) for s in range(300) for j in range(3)]
    df = spark.createDataFrame(ann, "spec int, observer string, label string")
    rows, members = R._patterns(df)
    patterns = {}
    for s, o, x in ann:
        patterns.setdefault(s, set()).add((o, x))
    kinds = {frozenset(p) for p in patterns.values()}
    assert rows.select("spec").distinct().count() == len(kinds) and rows.count() == 3 * len(kinds)
    assert all(patterns[r["spec"]] == patterns[r["of"]] for r in members.collect()) and members.count() == 300
    post, _, _ = R.dawid_skene(df, ["a", "b"])
    by = {}
    for r in post.collect():
        by.setdefault(frozenset(patterns[r["spec"]]), set()).add((r["class"], round(r["p"], 12)))
    assert post.count() == 600 and all(len(v) == 2 for v in by.values())
