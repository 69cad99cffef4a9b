"""Shards, archives, tokens and the pipeline."""

import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydrolake.llm import bpe_automaton, sharding, warc
from hydrolake.llm.queries import tokenizer_path


def plain_shards(rows, limit):
    """Split prefixes until they fit."""
    out, todo = {}, [("", rows)]
    while todo:
        prefix, own = todo.pop()
        if sum(b for _, _, b in own) <= limit or not own:
            out |= {k: prefix for k, _, _ in own}
            continue
        for bit in "01":
            part = [r for r in own if r[1][len(prefix)] == bit]
            if part:
                todo.append((prefix + bit, part))
    return out


def test_shards_equal_splitting(spark):
    rnd = random.Random(4)
    rows = [(i, "x" * rnd.choice([0, 1, 5, 50, 400])) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = sharding.assign(df, F.col("k"), sharding.text_bytes("text"), 2000)
    bits = lambda k: format(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), "060b")
    assert {r["k"]: r["shard"] for r in got.collect()} == plain_shards([(k, bits(k), len(t)) for k, t in rows], 2000)
    assert got.agg(F.max("shard_bytes")).first()[0] <= 2000


def test_one_key_and_odd_rows(spark, odd):
    hot = spark.createDataFrame([(7, "x" * 30)] * 200 + [(k, "y" * 10) for k in range(50)], "k long, text string")
    got = sharding.assign(hot, F.col("k"), sharding.text_bytes("text"), 100)
    sums = got.groupBy("shard").agg(F.sum(F.length("text")).alias("b"), F.first("shard_bytes").alias("s")).collect()
    assert got.count() == 250 and max(r["b"] for r in sums) <= 100 and all(r["b"] == r["s"] for r in sums)
    assert sharding.assign(odd, F.col("doc_id"), sharding.text_bytes("text"), 64).count() == odd.count()
    assert sharding.assign(odd.limit(0), F.col("doc_id"), sharding.text_bytes("text")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return bpe_automaton.Tokenizer.load(tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aeinorst'hlmdv \t.,!?09ñßéΣİſK\x85\xa0", max_size=80))
def test_tokens_equal_the_library(tokenizer, library, text):
    text = text.encode("utf-8", "ignore").decode()
    want = library.encode(text, add_special_tokens=False).ids
    assert tokenizer.encode(text) == want and tokenizer.decode(want) == library.decode(want, skip_special_tokens=False)


def test_special_and_long_words(tokenizer, library):
    for text in ("a<|endoftext|>b<|startoftext|>", "<|endoftext|><|endoftext|>", "aa" * 5000 + "the" * 700, "<|endoftext|", "", "1234 x2"):
        want = library.encode(text, add_special_tokens=False).ids
        assert tokenizer.encode(text) == want and tokenizer.decode(want) == library.decode(want, skip_special_tokens=False)


def test_small_automaton():
    vocab = {t: i for i, t in enumerate(["a", "b", "a</w>", "b</w>", "ab", "aa", "ab</w>", "aab</w>"])}
    auto = bpe_automaton.Automaton(vocab, [("a", "b"), ("a", "a"), ("a", "b</w>"), ("a", "ab</w>")], "</w>")
    back = lambda w: [auto.labels[t] for t in auto.encode(w)]
    assert back("aab") == ["aa", "b</w>"] and back("abb") == ["ab", "b</w>"] and back("aaa") == ["aa", "a</w>"] and back("ab") == ["ab</w>"]


def test_token_rows(spark, odd, tokenizer, library):
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe_automaton.encode(odd, tokenizer, ["doc_id"]).collect()}
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (ids, library.decode(ids, skip_special_tokens=False))
    assert bpe_automaton.encode(odd.limit(0), tokenizer, ["doc_id"]).count() == 0


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    big = "ä" * 600
    rows = [(1, "http://a/ b\r\nX: y", big, 0), (2, None, big, 0), (3, "http://c", big, 0), (3, "http://c", big, 0), (4, "http://d", "small", 0), (5, "http://e", "small", 0), (6, "http://f", None, 0), (None, "http://g", big, 0)]
    rows += [(k, f"http://x/{k}", f"<p>{k}</p>\r\n\r\n" * 80, 0) for k in range(100, 160)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    planned = warc.plan_revisits(pages)
    archives = warc.write_archives(planned, warc.dictionary(warc.sample(pages)))
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows) and archives.count() > 3
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    html = {k: (h or "").encode() for k, _, h, _ in rows}
    for k, own in by.items():
        for r in own:
            assert r["payload_bytes"] == len(html[k]) and r["payload_digest"] == hashlib.sha1(html[k]).hexdigest()
            assert r["payload"] == (html[k] if r["record_type"] == "response" else None)
    assert [by[k][0]["refers_to"] for k in (1, 2, None)] == [3, 3, 3] and all(r["record_type"] == "response" for r in by[3] + by[4] + by[5] + by[6])
    assert warc.read_archives(warc.write_archives(warc.plan_revisits(pages.limit(0)), b"")).count() == 0


def test_bad_archives():
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    good = warc.record(1, "u", b"xyz", hashlib.sha1(b"xyz").hexdigest(), None)
    assert [warc.parse(r)["payload"] for r in warc.frames(struct.pack("<II", warc.DICT_MAGIC, 0) + pack(good) + pack(good))] == [b"xyz", b"xyz"]
    held = pack(b"words of a dictionary that is itself compressed")
    assert len(list(warc.frames(struct.pack("<II", warc.DICT_MAGIC, len(held)) + held + pack(good)))) == 1
    for content in (b"junk", pack(good)[:-3], struct.pack("<II", warc.DICT_MAGIC, 99) + b"x"):
        with pytest.raises(warc.BadRecord):
            list(warc.frames(content))
    for old, new in ((b"WARC/1.1", b"WARC/9"), (b"WARC-Date", b"WARC-Dat"), (b"xyz", b"xy"), (b"xyz", b"xyy"), (b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.BadRecord):
            warc.parse(good.replace(old, new, 1))


def test_pipeline(spark, tmp_path, docs, prose, library):
    pipeline = pytest.importorskip("corpus_pipeline")
    from hydrolake.llm import secret_scan, simhash_dedup

    texts = prose(30, 60, seed=5)
    item = "the quick item of a benchmark has many plain words in it"
    extra = [texts[0], texts[1] + " tail", None, "", "123 456", f"{texts[2]} {item} {texts[3]}", texts[4] + " token = abcdef123456"]
    table = docs(texts + extra).drop("fp", "h")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["ids"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    known = {i: t for i, t in enumerate(texts + extra) if t and any(c.isalpha() for c in t)}
    sets = {i: set(simhash_dedup._sketch_set(t).tolist()) for i, t in known.items()}
    like = lambda i, j: sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    kept = {i: t for i, t in known.items() if not any(j < i and like(i, j) for j in known)}
    scanner = secret_scan.Scanner()
    want = {}
    for i, t in kept.items():
        if item in t:
            continue
        spans = scanner.spans([t])[0]
        for a, b, _ in reversed(spans):
            t = t[:a] + "[SECRET]" + t[b:]
        want[i] = library.encode(t, add_special_tokens=False).ids
    assert got == want and 30 not in got and 35 not in got
    stages = [n for n, _ in pipeline.STAGES]
    assert stages == ["language_id", "simhash_dedup", "decontaminate", "secret_scan", "bpe_automaton"]
    empty = table.limit(0)
    for _, stage in pipeline.STAGES[:4]:
        assert stage(spark, empty, str(tmp_path)).columns == table.columns


def test_shards_of_clashing_columns_and_hot_keys(spark):
    rows = [(7, "x" * 30, "a", 1)] * 5000 + [(k, "y" * 10, "b", 2) for k in range(50)]
    df = spark.createDataFrame(rows, "k long, text string, shard string, depth int")
    got = sharding.assign(df, F.col("k"), sharding.text_bytes("text"), 1000)
    assert got.columns == ["k", "text", "shard", "depth", "shard_bytes", "shard_rows"] and got.count() == 5050
    sums = got.groupBy("shard").agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("n"), F.first("shard_bytes").alias("s"), F.first("shard_rows").alias("r")).collect()
    assert all(r["b"] == r["s"] <= 1000 and r["n"] == r["r"] for r in sums) and len(sums) < 450
    assert sharding.assign(df.limit(0), F.col("k"), sharding.text_bytes("text")).columns == got.columns
