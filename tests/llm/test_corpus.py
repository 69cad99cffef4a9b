"""Collocations, resampling and language-model scores against brute force; near-duplicates by rows; long pseudonyms."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.llm import collocations, language_id, lattice_lm, pii_pseudonyms, resampling, simhash_dedup


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, least, top):
    f = {}
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(v for k, v in own.items() if len(k) == 1)
        found = {k: v for k, v in own.items() if len(k) > 1 and v >= least}
        scored = []
        for p, a in found.items():
            if any(100 * v >= 50 * a for q, v in found.items() if len(q) > len(p) and p in (q[:-1], q[1:])):
                continue
            s, k = min(((10**6 * a * a // (own[p[:k]] * own[p[k:]])), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rnd = random.Random(12)
    words = ["the", "The", "of", "new", "york", "city", "é", "x\x01y", "\x02", "日本", "ab", "abc", "a.b", "q"]
    join = [" ", " ", " ", "\t", "  ", ". ", "\n", ","]
    return ["".join(rnd.choice(words) + rnd.choice(join) for _ in range(rnd.randint(0, 60))) for _ in range(150)]


def test_collocations(spark, docs, phrases, odd):
    texts = [*phrases, None, "", "New York City. " * 40, " ".join(["long"] * 3000)]
    langs = [["en", "fr", None][i % 3] for i in range(len(texts))]
    got = collocations.mine(docs(texts, langs), top=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and [t for c, t in got.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6
    assert sorted(map(tuple, got.collect())) == plain_collocations(zip(langs, texts), 10, 50)
    assert collocations.mine(odd.limit(0)).count() == 0
    bare = collocations.mine(odd.withColumn("lang", F.lit(None).cast("string")), least=2)
    assert {r["lang"] for r in bare.collect()} == {"und"}


def test_collocations_of_small_bounds(spark, docs, phrases, monkeypatch):
    """Tries that burst and spill all the time, texts read in parts and merges of many runs give the same counts."""
    monkeypatch.setattr(collocations, "BURST", 16)
    tally = collocations.Tally("en", frozenset([b"the", b"of"]), 7)
    counts, runs = Counter(), []
    for k, (words, carried) in enumerate(collocations.runs_of(phrases, 50)):
        tally.add(words, carried)
        if k % 5 == 0 and tally.size:
            runs += tally.spill(max(1, tally.size // 2))
        if k % 17 == 0 and tally.size:  # as where words outgrow their numbers: the next run brings its last words along
            runs += tally.spill(tally.size)
            tally.clear()
    runs += tally.spill(tally.size)
    for part, low, block in runs:
        table = collocations.unpack([block]).to_pydict()
        assert table["p"] == sorted(table["p"]) and table["p"][0] == low and 0 <= part < 7
        for p, n in zip(table["p"], table["n"]):
            counts[p.decode()[:-1]] += n
    want = Counter()
    for text in phrases:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
    assert counts == want
    got = collocations.phrase_counts(docs(phrases), {"en": frozenset([b"the"])}, 5, least=3, entries=50, merge=20).collect()
    assert {r["phrase"]: r["n"] for r in got} == {k: v for k, v in want.items() if v >= 3}


def test_texts_in_parts():
    text = "ab cd, e\tf  ghi " * 5
    for chunk in (1, 4, 7, 1000):
        assert [w for some in collocations.words_of(text, chunk) for w in some] == text.replace(",", " .").encode().split()


def test_runs_of_words(monkeypatch):
    monkeypatch.setattr(collocations, "words_of", lambda text: iter([list(text[k : k + 3]) for k in range(0, len(text), 3)]))
    for most in (1, 2, 3, 5, 100):
        seen = []
        for run, carried in collocations.runs_of(["abcdefgh", "", "xy"], most):
            assert run[:carried] == seen[len(seen) - carried :]
            seen += run[carried:]
        assert [x if isinstance(x, str) else x.decode() for x in seen] == list("abcdefgh..xy.")


def test_features_of_texts_in_parts(monkeypatch):
    text = " ".join(f"w{k % 7}x{k % 5}" for k in range(300)) + " é -- A9"
    whole = np.concatenate([p for _, p in resampling.Hasher(1000).of(text)])
    monkeypatch.setattr(resampling, "CHUNK", 40)
    parts = list(resampling.Hasher(1000, kept=3).of(text))
    assert len(parts) > 5 and sorted(np.concatenate([p for _, p in parts])) == sorted(whole) and sum(n for n, _ in parts) == 302


def plain_resampling(docs, target):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, x in found for b in x), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, n, x in found:
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    ranks = {r[0]: k for k, r in enumerate(able[: 25 * len(able) // 100], 1)}
    return sorted((i, n, w, s, ranks.get(i)) for i, _, n, w, s in out)


def test_resampling(spark, docs, prose):
    texts = [*prose(40, 30, seed=3), *prose(40, 25, seed=4, letters="xyzé"), None, "", "A9é-b_c D", "Word " * 19, "Word " * 20, prose(1, 5000)[0]]
    d = docs(texts)
    target = docs([prose(1, 300, seed=3)[0], None]).select("text")
    got = resampling.resample(d, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=lambda r: r[0]) == plain_resampling(list(enumerate(texts)), [prose(1, 300, seed=3)[0]])
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, 21))
    assert resampling.resample(d.limit(0), target.limit(0)).count() == 0
    twice = resampling.resample(d.unionByName(d).withColumn("doc_id", F.expr("nullif(doc_id, 3)")), target).collect()
    assert len(twice) == 2 * len(texts) and sorted(r["rank"] for r in twice if r["rank"]) == list(range(1, 42))


def test_radix_sort(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([rnd.randrange(-(2**63), 2**63), rnd.randrange(-3, 3)]), rnd.randrange(4)) for _ in range(3000)]
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(rows)], "a long, b long, k long").repartition(5)
    got = resampling.radix_places(df, [F.col("b"), F.col("a")], digit=9, block=5).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(3000)) and [(r["b"], r["a"]) for r in got] == sorted((b, a) for a, b in rows)
    same = resampling.radix_places(df.withColumns({"a": F.lit(1), "b": F.lit(2)}), [F.col("b"), F.col("a")]).collect()
    assert sorted(r["place"] for r in same) == list(range(3000))


def segmentations(model, word):
    """The weight of each way through a word's lattice, by recursion."""
    text = lattice_lm.SPACE + word

    def ways(at):
        if at == len(text):
            yield 1.0
        for end in range(at + 1, len(text) + 1):
            w = (model.first if at == 0 else model.inner).get(text[at:end])
            if w is None and end == at + 1 and (at == 0 or text[at] not in model.inner):
                w = sum(model.byte[b] for b in text[at].encode())
            if w is not None:
                yield from (math.exp(w) * x for x in ways(end))

    return list(ways(0))


def toy_pieces():
    words = {"▁a": 4, "▁ab": 3, "▁b": 2}, {"a": 5, "b": 4, "ab": 3, "ba": 2, "bab": 1}
    first, inner = ({k: math.log(v) for k, v in d.items()} for d in words)
    return lattice_lm.Pieces(first, inner, [0.0] * 256, 0.5).normal()


def test_lattice():
    model = toy_pieces()
    assert abs(sum(math.exp(w) for _, w in model.names()) - 1) < 1e-12
    words = ["a", "abab", "babba", "aéb", "▁a", "日", "abbabab"]
    for word, total in zip(words, model.forward(words)):
        ways = segmentations(model, word)
        assert abs(total - math.log(sum(ways))) < 1e-9 and abs(model.forward([word])[0] - total) < 1e-12
        counts = model.expected([word] * 2)
        # Expected lengths of the pieces add up to the word's, whatever the weights; the space may be in bytes.
        size = sum(n * (1 if k[0] == "b" else len(k) - 1) for k, n in counts.items() if k != "e")
        if word.isascii():
            assert abs(size - 2 * (1 + len(word)) - 2 * counts["be2"]) < 1e-9
    together, apart = model.expected(words), Counter()
    for word in words:
        apart.update(model.expected([word]))
    assert together.keys() == apart.keys() and all(math.isclose(together[k], apart[k], rel_tol=1e-9) for k in together)
    assert -1e7 < model.forward(["ab" * 20_000])[0] < -1000 and len(model.forward(["", "a", ""])) == 3  # no underflow
    # Tokens add up to 1: all words over these pieces, by the weights of beginnings and of going on, and the end.
    begins = sum(map(math.exp, model.first.values()))
    assert begins / (1 - model.inside) + math.exp(model.forward([""])[0]) <= 1 + 1e-9


def test_scores(spark, docs, prose, odd):
    texts = [*prose(60, 50, seed=8, letters="ab"), *prose(3, 40, seed=9, letters="abé"), None, "", "  \n", "Unseen wörd " + "zq" * 3000, prose(1, 4000, seed=8, letters="ab")[0]]
    d = docs(texts)
    held = language_id.fold(F.col("doc_id"), 10) == 0
    model = toy_pieces()
    got = lattice_lm.score(d, held, model, block=700)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r["doc_id"]: r for r in got.collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), ""] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d_ = once / (once + 2 * twice) if once and twice else 0.5
    fitted = model
    for _ in range(lattice_lm.ROUNDS):
        fitted = model.with_counts(fitted.expected(list(c)))
    p = lambda w: max(c[w] - d_, 0) / n + d_ * v / n * math.exp(fitted.forward([w])[0])
    assert len(rows) == len(texts)
    for i, t in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        if max(map(len, t)) < 100:
            assert math.isclose(r["score"], sum(math.log10(p(w)) for w in t), rel_tol=1e-6)
    assert lattice_lm.score(d.limit(0), held, model).count() == 0 and lattice_lm.score(odd, F.lit(True).alias("held"), model).count() == odd.count()


def test_rows_are_dropped_and_not_ids(spark, prose):
    a, b, c = prose(3, 60, seed=21)
    rows = [(3, a, {"k": 1}), (5, a, {"k": 2}), (5, b, {"k": 3}), (7, c, {"k": 4}), (7, f"{c} x", {"k": 5}), (8, b + " y", {"k": 6}), (9, c, {"k": 7}), (9, c, {"k": 8}), (None, a, {"k": 9})]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    kept = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in simhash_dedup.keep_one(df).collect()), key=str)
    least = min([c, f"{c} x"], key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    assert kept == sorted([(False, 3, a), (False, 5, b), (False, 7, least), (True, None, a)], key=str)
    again = spark.createDataFrame([(1, a, {"k": 1})] * 3 + [(2, b, {"k": 2})], df.schema)
    assert sorted(r["doc_id"] for r in simhash_dedup.keep_one(again).collect()) == [1, 2]
    assert simhash_dedup.keep_one(df).columns == df.columns


@pytest.mark.parametrize("n", [49, 64, 100, 300, 100_000])
def test_long_local_parts(n):
    rnd = np.random.default_rng(n)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    local = "".join(rnd.choice(letters, n))
    there, back = pii_pseudonyms.Pseudonyms(b"k"), pii_pseudonyms.Pseudonyms(b"k", back=True)
    new = there.email(f"{local}@example.org")
    stay = sum(x == y for x, y in zip(local, new))
    assert stay < n / 26 + 5 * math.sqrt(n / 26) and len(new) == n + 12 and back.email(new) == f"{local}@example.org"
    other = there.email(f"{local[:-1]}{'a' if local[-1] != 'a' else 'b'}@example.org")
    assert sum(x == y for x, y in zip(other, new[:n])) < n / 26 + 5 * math.sqrt(n / 26)  # the last letter bears on all


def test_columns_of_any_name(spark, prose):
    """Extra columns named like inner ones pass every stage untouched."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from hydrolake.llm import decontaminate

    texts = prose(6, 40, seed=31)
    names = ["__h1", "__h2", "__text", "__lang", "__score", "__f1", "tk", "id", "key", "part", "text_", "h"]
    rows = [(k, t, "en", "s", len(t), *(f"{n}{k}" for n in names)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` string" for n in names)]))
    bench = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect()) == [0, 1, 3, 4, 5]
    for stage in (pipeline.known_language, pipeline.one_of_each_group):
        got = stage(spark, df, "").orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == rows
    found = language_id.identify(df, language_id.fit(df), df.columns)
    assert set(found.columns) == {*df.columns, "lang_pred", "score"}


def test_many_languages_share_the_letters(spark):
    """The driver gets a bounded number of letters, and the model is that of the samples cut by it."""
    rows = [(chr(0x4E00 + k) * 50 + f" {k}", f"l{k:03d}") for k in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(df, letters=3000)
    whole = language_id.Model({lang: [t] for t, lang in rows}, letters=3000)
    assert model.langs == whole.langs == [lang for _, lang in rows] and list(model.alphabet) == list(whole.alphabet)
    texts = [t for t, _ in rows[:20]]
    assert model.predict(texts) == whole.predict(texts)


def test_learned_exceptions(spark, docs):
    """A phrase with an entry that only clean documents have doesn't count."""
    from hydrolake.llm import toxicity

    filler = ["".join(random.Random(k).choices("bcdfg", k=5)) for k in range(60)]
    texts, labels = [], []
    for k in range(400):
        words = random.Random(k).sample(filler, 12)
        if k % 4 == 0:
            words.insert(3, "vilezor")
        elif k < 12:
            words.insert(3, "garden vilezor")
        texts.append(" ".join(words))
        labels.append((k, int(k % 4 == 0)))
    d = docs(texts)
    lexicon = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "garden vilezor" in lexicon.exceptions and any("vilezor" in e for e in lexicon.weights)
    a, b = lexicon.score("bbb garden vilezor ddd"), lexicon.score("bbb ccc vilezor ddd")
    assert a < 0.5 < b and a == lexicon.score("bbb ccc ddd eee")
