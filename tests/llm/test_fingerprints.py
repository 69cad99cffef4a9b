"""SimHash fingerprints and near-duplicate groups against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydrolake.llm import buckets, components, simhash, simhash_dedup


def plain_fp(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def closure(pairs, items):
    up = {i: i for i in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\né中 x", max_size=80))
def test_fingerprint_equals_the_contract(text):
    assert simhash_dedup.fingerprint(text) == plain_fp(text)


def test_any_four_positions_hold_a_key():
    keys = simhash_dedup.POSITIONS
    assert len(keys) == 70 and all(any(set(k) <= set(q) for k in keys) for q in combinations(range(8), 4))


def near_copies(prose, n=150):
    rnd = random.Random(5)
    base = prose(1, 300, seed=2)[0].split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    return out


def test_groups_equal_brute_force(spark, docs, prose):
    texts = near_copies(prose) + prose(150, 40, seed=7) + [None, "", "one", "One", "two words"]
    random.Random(1).shuffle(texts)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash_dedup.near_groups(docs(texts).repartition(5)).collect()}
    fps = [plain_fp(t) for t in texts]
    want = closure([(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4], range(len(fps)))
    assert got == {i: (fps[i], want[i]) for i in range(len(fps))}


def test_cells_split_large_buckets(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 62)
    fps = sorted({int(base) ^ sum(1 << int(b) for b in rnd.choice(24, rnd.integers(0, 5), replace=False)) for _ in range(400)})
    index = simhash_dedup.index_rows(spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, id long"))
    sizes = [len(r["members"]) for r in buckets.cells(index, chunk=50).collect()]
    assert max(sizes) < 250
    edges = [tuple(r) for r in simhash_dedup.links(spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, id long")).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 64 for a, b in edges)
    want = closure([(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4], range(len(fps)))
    assert closure(edges, range(len(fps))) == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 100)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90, 200: 90}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_make_no_idle_round_and_no_broadcast(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "cut", lambda df, f=components.cut: written.append(df) or f(df))
    stars = [(k, 3 * (k // 3)) for k in range(30)]
    for edges, rounds in ((stars, 0), ([*stars, (4, 1), (8, 29)], 2)):
        written.clear()
        got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == closure(edges, range(30)) and len(written) <= 1 + rounds
        joins = [x for df in written for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
        assert len(joins) >= 2 * (len(written) - 1) and all("strategy=merge" in x for x in joins)
    rnd = random.Random(3)
    mixed = [(rnd.randrange(-50, 50), rnd.randrange(-50, 50)) for _ in range(60)]
    nodes = sorted({x for u, v in mixed for x in (u, v) if u != v})
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(mixed, "u long, v long")).collect()}
    assert got == closure([e for e in mixed if e[0] != e[1]], nodes)


def test_odd_rows_and_empty_tables(spark, odd):
    assert simhash_dedup.near_groups(odd).count() == odd.count()
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {0, 3, 4, 6, 7, 8, 9, 10, 11}
    assert simhash_dedup.keep_one(odd.limit(0)).count() == 0
    nulls = odd.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert simhash_dedup.near_groups(nulls).count() == odd.count() and simhash_dedup.keep_one(nulls).filter("doc_id IS NULL").count() == 4
    twice = odd.union(odd)
    assert simhash_dedup.keep_one(twice).count() == kept.count()


def test_edits_and_search_equal_brute_force(spark, docs, prose):
    texts = near_copies(prose, 60) + prose(60, 30, seed=3) + ["", None, "a", "words only"]
    out = {r["doc_id"]: r for r in simhash.report(docs(texts).repartition(6), every=5).collect()}
    own = [t or "" for t in texts]
    fps = [simhash.fingerprint(t) for t in own]
    for i, t in enumerate(own):
        after = own[(i + 1) % len(own)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert int(r["fingerprint"], 16) == fps[i] and r["near_next"] == simhash.likeness(fps[i], fps[(i + 1) % len(own)])
        assert r["near_edited"] == simhash.likeness(fps[i], simhash.fingerprint(edited))
        assert r["n_near"] == (sum((fps[i] ^ f).bit_count() <= 3 for f in fps) - 1 if i % 5 == 0 else None)


def test_one_and_no_document(spark, odd):
    one = odd.filter("doc_id = 4")
    r = simhash.report(one).first()
    assert r["near_next"] == 1.0 and simhash.report(odd.limit(0)).count() == 0 and simhash.report(odd).count() == odd.count()
    with pytest.raises(ValueError):
        simhash.tables(5)


def test_stage_links_by_five_word_likeness(spark, docs, prose):
    rnd = random.Random(8)
    texts = prose(40, 80, seed=21) + [None, "", "one", "One", "two words"]
    for t in prose(40, 200, seed=22):
        w = t.split()
        for _ in range(rnd.randint(1, 6)):
            w[rnd.randrange(len(w))] = "edit"
        texts += [t, " ".join(w)]
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    alike = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert any((plain_fp(texts[i]) ^ plain_fp(texts[j])).bit_count() > 4 for i, j in alike)
    want = closure(alike, range(len(texts)))
    kept = {r["doc_id"] for r in simhash_dedup.keep_one(docs(texts).repartition(5)).collect()}
    assert kept == set(want.values())


def test_groups_of_any_ids(spark):
    big = 2**62
    rows = [(big + 5, "one two three four five"), (big + 6, "one two three four five"), (-(2**63), "another text of some words"), (None, "one two three four five"), (None, "alone here"), (2**63 - 1, "another text of some words")]
    got = simhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by == {big + 5: {big + 5}, big + 6: {big + 5}, -(2**63): {-(2**63)}, 2**63 - 1: {-(2**63)}, None: {big + 5, None}}


def test_equal_ids_follow_by_their_texts(spark):
    rows = [(None, f"text {k}") for k in range(30)] + [(5, f"more {k}") for k in range(30)]
    got = simhash.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 60 and {r["n_chars"] for r in got} == {6, 7}


def test_common_hashes_and_links_of_a_cell(monkeypatch):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 62, 300)
    sets = [np.unique(np.concatenate([rnd.choice(base, k, replace=False), rnd.integers(0, 1 << 62, 8)])) for k in rnd.integers(250, 300, 40)]
    monkeypatch.setattr(simhash_dedup, "COLUMNS", 64)
    common = simhash_dedup._common(sets[:15], sets[15:])
    assert all(common[i, j] == len(set(sets[i]) & set(sets[15 + j])) for i in range(15) for j in range(25))
    assert simhash_dedup._common([base[:3]], [base[5:9]]).tolist() == [[0]]
    keys = list(range(100, 140))
    edges = simhash_dedup._linked([0] * 40, keys, keys, sets)
    alike = [(i, j) for i, j in combinations(range(40), 2) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))]
    assert alike and closure([(u - 100, v - 100) for u, v in edges], range(40)) == closure(alike, range(40)) and len(edges) < 40


def test_large_groups_of_near_copies(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CHUNK", 16)
    rnd = random.Random(31)
    base = prose(1, 120, seed=32)[0].split()
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(1000)}"
        texts.append(" ".join(w))
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    want = closure([(i, j) for i, j in combinations(range(120), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])], range(120))
    assert 1 < len(set(want.values())) < 100
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.like_groups(docs(texts)).collect()}
    assert got == want


def test_stage_goes_through_its_index_of_half_bytes(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "COUNTED", 1)
    rnd = random.Random(12)
    texts = prose(150, 60, seed=41)
    for t in prose(30, 100, seed=42):
        w = t.split()
        w[rnd.randrange(len(w))] = "edit"
        texts += [t, " ".join(w)]
    known = simhash_dedup.sketches(docs(texts)).cache()
    fps = {r["node"]: np.frombuffer(bytes(r["fp"]), np.uint8) for r in known.collect()}
    halves = {k: np.stack([f & 15, f >> 4], 1).ravel() for k, f in fps.items()}
    near = []
    for a, b in combinations(fps, 2):
        equal = halves[a] == halves[b]
        differ = int(np.bitwise_count(fps[a][:16] ^ fps[b][:16]).sum())
        if equal[simhash_dedup.LISTS].all(1).any() and equal[:32].sum() >= simhash_dedup.STAGE_SHARED and differ <= simhash_dedup.STAGE_RADIUS:
            near.append((a, b))
    want = closure(near, fps)
    assert len(near) >= 30
    for most in (None, 2):  # lists in one piece, and dealt to cells of two chunks
        got = [tuple(r) for r in simhash_dedup.stage_links(known, most).collect()]
        assert closure(got, fps) == want
    # Without the index no likeness is found.
    monkeypatch.setattr(simhash_dedup, "stage_links", lambda known: spark.createDataFrame([], "u long, v long"))
    assert all(r["doc_id"] == r["component_id"] for r in simhash_dedup.like_groups(docs(texts)).collect())
