"""Queries on odd rows against their SQL, and the ways that large tables take, on small ones."""

import glob
import os
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from hydrolake.operators import network as N
from hydrolake.operators import order as O
from hydrolake.operators import text as T
from hydrolake.operators.lineage import shared_dir
from hydrolake.plans.registry import QUERIES, SQL
from hydrolake import plans  # noqa: F401  registers the queries


def both(spark, name, folder, **tables):
    """The rows of a query and of its SQL over the given tables."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()), key=repr)
    return got, sorted(db.execute(SQL[name]).fetchall(), key=repr)


def test_translations_of_odd_texts(spark, tmp_path):
    """Empty texts, other numerals, other invisible characters, long lists of numbers."""
    texts = ["", None, "a", "²", "x½ 5", "Ⅳ", "٣.5 3", "a\u200cb", "a\u200bb", "\ufeff5", "5,5.5 1.,2", "5," * 50_000 + "1", "é" * 400]
    rows = [(6 * k + r, t, len(t or "")) for k, t in enumerate(texts) for r in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got, want = both(spark, "t2_translation_check", tmp_path, documents=docs)
    assert got == want and len(got) == len(rows)
    # By itself the check tells all numerals beyond ASCII and all invisible characters.
    pairs = spark.createDataFrame([("1", "Ⅳ 1", "foreign-numerals"), ("a", "a\u2060", "invisible-characters"), ("", "", "length-ratio"), ("a", None, ""), ("1,2", "2.1", "numbers-differ")], "a string, b string, want string")
    assert all(r["got"] == r["want"] for r in pairs.select("want", F.array_join(T.translation_check(F.col("a"), F.col("b")), ",").alias("got")).collect())


def test_rounds_keep_the_planner_small(spark, monkeypatch):
    """The planner's size of a table that is joined round after round stays that of its rows; a chain and its branch, against a plain walk."""
    bits = []
    settle = N.settle

    def seen(df):
        out = settle(df)
        bits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(N, "settle", seen)
    n = 1500
    rows = [(f"n{k}", f"n{k + 1}", 1.0 + k % 3) for k in range(n)] + [("n700", "m0", 2.0)] + [(f"m{k}", f"m{k + 1}", 1.0) for k in range(40)]
    km = {"n0": 0.0}
    for a, b, d in rows:
        km[b] = km[a] + d
    got = {r["node"]: r["km"] for r in N.river_risk(spark.createDataFrame(rows, "src string, dst string, km double"), "n0", 1.0, 0.001).collect()}
    assert got == km and len(bits) > 10 and max(bits) < 40
    ring = spark.createDataFrame([("s", "a", 1.0), *[(f"r{k}", f"r{(k + 1) % 9}", 1.0) for k in range(9)]], "src string, dst string, km double")
    with pytest.raises(ValueError, match="cycle"):
        N.river_risk(ring, "s", 1.0, 0.001)


def test_observation_lines_take_little_disk(spark):
    """Nested records repeat their names: a few dozen bytes each, not the seven hundred of their lines."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/observations-*"))
    source = "/root/testdata/sf0.01"
    got = {tuple(r) for r in QUERIES["s5_read_observations"](spark, source).collect()}
    (path,) = set(glob.glob(f"{folder}/observations-*")) - before
    written = sum(os.path.getsize(f) for f in glob.glob(f"{path}/part-*"))
    assert written < 100 * spark.read.parquet(f"{source}/lineitem.parquet").count()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{source}/lineitem.parquet'")
    assert got == set(db.execute(SQL["s5_read_observations"]).fetchall())


@pytest.mark.parametrize("written", [10**6, 0])
def test_medians_search_the_middle_bins_only(spark, monkeypatch, written):
    """Digits are searched in the bins that hold the middle; odd groups against plain Python."""
    rnd = random.Random(8)
    even = [rnd.random() for _ in range(4000)]
    odd = {
        "outlier": [*(rnd.random() for _ in range(300)), 1.7e308], "both ends": [-1.7e308, 1.7e308, *(rnd.gauss(0, 1) for _ in range(200))], "same": [4.25] * 300,
        "apart": [*(rnd.random() for _ in range(150)), *(9 + rnd.random() for _ in range(150))], "tiny": [5e-324 * rnd.randint(0, 9) for _ in range(301)], None: [float(rnd.randint(0, 3)) for _ in range(250)], "few": [3.0, 1.0],
    }
    monkeypatch.setattr(O, "WRITTEN", written)
    seen = []
    monkeypatch.setattr(O, "select", lambda df, *more, f=O.select: seen.append(df.count()) or f(df, *more))
    own = lambda groups: spark.createDataFrame([(k, v) for k, x in groups.items() for v in x], "g string, v double").repartition(3)
    got = {r["g"]: r["median"] for r in O.medians(own(odd), ["g"], "v", large=100).collect()}
    assert got == {k: pytest.approx(statistics.median(v), rel=1e-15, abs=0) for k, v in odd.items()}
    seen.clear()
    assert O.medians(own({"e": even}), ["g"], "v", large=100).first()["median"] == pytest.approx(statistics.median(even), rel=1e-15)
    assert 0 < seen[0] < 40
