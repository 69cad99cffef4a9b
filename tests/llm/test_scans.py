"""Secrets, benchmark passages, personal data, toxicity and languages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hydrolake.llm import decontaminate, language_id, pii_pseudonyms, secret_scan, toxicity

BASE = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def plain_spans(text):
    out = []
    for n, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_trigram_queries():
    assert secret_scan.trigram_query(r"[0-9a-f]+") == secret_scan.ANY
    tri = lambda s: ("tri", s[0] << 16 | s[1] << 8 | s[2])
    assert secret_scan.trigram_query("AKIA[A-Z]+") == ("and", tri(b"aki"), tri(b"kia"))
    assert secret_scan.trigram_query("(abc|xyz)?") == secret_scan.ANY
    assert secret_scan.trigram_query("(abc|wxyz)q*") == ("or", tri(b"abc"), ("and", tri(b"wxy"), tri(b"xyz")))


def test_every_match_fulfils_its_query():
    rnd = random.Random(2)
    parts = ["PassWord", "token", "api_key", "apikey", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "é", "\n", "secret", "ſecret", "x1/y+z=", "AKIAAKIA"]
    scanner = secret_scan.Scanner()
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(600)]
    for text, spans in zip(texts, scanner.spans(texts)):
        assert [(scanner.rules[n].kind, a, b) for a, b, n in spans if scanner.rules[n].base] == plain_spans(text)


def test_secret_rows(spark, odd, docs):
    assert secret_scan.digest(secret_scan.scan(odd)).count() == odd.count() and secret_scan.scan(odd.limit(0)).count() == 0
    d = docs(['é token = "abcdef12" x', "ghp_" + "a" * 36 + " eyJabcdefgh.eyJabcdefgh.abcdefgh", None])
    rows = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(d)).collect()}
    assert rows[0]["spans"] == "assign:2:19" and rows[1]["n_hex"] == 1 and "github:0:40" in rows[1]["spans"] and "jwt" in rows[1]["spans"] and rows[2]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(d).collect()}
    assert clean[0] == 'é [SECRET]" x' and clean[1] == "[SECRET] [SECRET]" and clean[2] is None
    assert secret_scan.redact(odd).columns == odd.columns


def test_redact_leaves_no_key_material(spark, docs):
    rnd = random.Random(4)
    line = lambda n: "".join(rnd.choice("ABCDxyz0189+/") for _ in range(n))
    lines = [line(64), line(64), line(64), line(23) + "="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD\n\n"
    bodies = ["\n".join(lines), "\r\n".join(lines), "\\n".join(lines), " ".join(lines), head + "\n".join(lines)]
    texts = [f"see {begin}\n{b}\n{end} after" for b in bodies] + [f"see {begin}\n{b}\n\n- after" for b in bodies]
    texts += [f"see {begin}\n{bodies[0]}\n\n- and {begin}\n{bodies[0]}\n{end} after"]
    texts += [f"see {p}{'a1B2' * 100} after" for p in ("ghp_", "xoxb-", "AIza", "sk_live_")]
    got = [r["text"] for r in secret_scan.redact(docs(texts)).orderBy("doc_id").collect()]
    clean = [" ".join(x.split()) for x in got]
    assert clean == ["see [SECRET] after"] * 5 + ["see [SECRET] - after"] * 5 + ["see [SECRET] - and [SECRET] after"] + ["see [SECRET] after"] * 4
    assert len(secret_scan.Scanner().spans([begin + "\n" + "- text " * 50_000])[0]) == 1


@pytest.fixture
def bench(spark):
    items = [(1, "A farmer named Tom has 12 apples and gives 5 kg of them to Anna before he walks 3 miles home with Tom."), (2, "short item words here"), (3, None), (4, "two words")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_benchmark_passages(spark, docs, bench, odd):
    noise = "unrelated words come first and then "
    texts = [
        noise + "A farmer named Tom has 12 apples and gives 5 kg of them to Anna before he walks 3 miles home with Tom. The end",
        noise + "A farmer named Bob has 40 apples and gives 7 g of them to Eve before he walks 9 miles home with Bob. The end",
        noise + "A farmer named Bob has 40 apples and gives 7 g of them to Eve before he walks 9 miles home with Max. The end",
        "a farmer has apples and walks home before he gives them",
        noise + "SHORT no; short item words here, yes",
        None,
    ]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find(docs(texts), bench).collect()}
    assert got == {(0, 1): "copy", (1, 1): "re-parameterised", (4, 2): "copy"}
    assert [r["doc_id"] for r in decontaminate.clean(docs(texts), bench).orderBy("doc_id").collect()] == [2, 3, 5]
    assert decontaminate.find(odd, bench.limit(0)).count() == 0 and decontaminate.find(odd.limit(0), bench).count() == 0
    assert decontaminate.clean(odd, bench).count() == odd.count()
    many = docs(texts * 30)
    assert decontaminate.find(many, bench).count() == 90


def test_benchmark_join_without_broadcast(spark, docs, bench, monkeypatch):
    texts = ["x A farmer named Tom has 12 apples and gives 5 kg of them to Anna before he walks 3 miles home with Tom."]
    want = decontaminate.find(docs(texts), bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert decontaminate.find(docs(texts), bench).collect() == want


def test_benchmark_passages_in_other_case(spark, docs):
    items = [(1, "A farmer named Tom has 12 apples and gives 5 kg of them to Anna before he walks 3 miles home with Tom."), (2, "Anna Berg Carl Dorn Eva Falk Greta Hahn Ida Jung Karl"), (3, "1 2 4 8 16 32 64 128 256 512 1024"), (4, "Die Straße nach Ulm ist heute wieder den ganzen Tag gesperrt")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["words before " + t.upper() + " words after" for _, t in items] + ["so " + items[0][1].lower(), "so " + items[0][1].replace("12", "40").upper(), "it counts 2 3 5 7 11 13 17 19 23 29 31", "Max Berg Kurt Dorn Lea Falk Nina Hahn Ute Jung Karl", items[3][1].lower()]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find(docs(texts), bench).collect()}
    assert got == {(0, 1): "copy", (1, 2): "copy", (2, 3): "copy", (3, 4): "copy", (4, 1): "copy", (5, 1): "re-parameterised", (8, 4): "copy"}
    assert [r["doc_id"] for r in decontaminate.clean(docs(texts), bench).orderBy("doc_id").collect()] == [6, 7]


def test_permutations():
    f = pii_pseudonyms.Feistel(b"k")
    for n in (1, 2, 10, 73049 // 100, 1000):
        image = [f.permute("x", n, x) for x in range(n)]
        assert sorted(image) == list(range(n)) and [f.permute("x", n, y, back=True) for y in image] == list(range(n))
    assert pii_pseudonyms.Feistel(b"l").permute("x", 10**15, 7) != f.permute("x", 10**15, 7)


def test_pseudonyms(spark, docs, odd):
    values = ["4432507379035540", "4432 5073 7903 5540", "+1 (988) 555-2485", "192.168.10.7", "2024-02-29", "29.02.2024", "078-05-1120", "bosbt.42@mail8.example.com"]
    text = "; ".join(values) + "; 4432507379035541 300.1.1.1 2023-02-29 000-12-1234 version 1.2"
    d = docs([text, "again 4432507379035540 and 192.168.10.7", None])
    out = pii_pseudonyms.pseudonymise(d, b"key")
    rows = {r["doc_id"]: r for r in out.collect()}
    new = rows[0]["text"].split("; ")
    assert all(a != b and len(a) == len(b) or "." in a for a, b in zip(values, new))
    assert pii_pseudonyms.luhn(new[0]) == 0 and new[1].replace(" ", "") == new[0] and new[7].endswith("@mail8.example.com")
    assert rows[0]["text"].endswith("4432507379035541 300.1.1.1 2023-02-29 000-12-1234 version 1.2")
    assert rows[1]["text"] == f"again {new[0]} and {new[3]}" and rows[2]["text"] is None
    assert (rows[0]["n_card"], rows[0]["n_date"], rows[0]["n_ip"], rows[0]["n_email"], rows[0]["n_ssn"], rows[0]["n_phone"]) == (2, 2, 1, 1, 1, 1)
    back = pii_pseudonyms.pseudonymise(out.select(*d.columns), b"key", back=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {0: text, 1: "again 4432507379035540 and 192.168.10.7", 2: None}
    assert pii_pseudonyms.pseudonymise(odd, b"k").count() == odd.count()
    again = pii_pseudonyms.pseudonymise(out, b"k")
    assert again.columns == out.columns and again.count() == 3


def test_folding():
    assert toxicity.fold("Ιdі0t!! tr4sh") == toxicity.fold("idiot trash") == " idiot trash "
    assert toxicity.fold(None) == toxicity.fold(" \n") == " "
    assert toxicity.fold("in 2024 at 10:30").split() == ["in", "2024", "at", "10", "30"]


def test_toxicity(spark, docs, prose, odd):
    rnd = random.Random(3)
    texts, labels = [], []
    for i, t in enumerate(prose(400, 40, seed=11)):
        toxic = i % 4 == 0
        words = t.split()
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["vilezor", "gr0tmuk", "Snarfel!!"])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    d = docs(texts + [None, ""])
    lex = toxicity.learn(d, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, lex).collect()}
    held = [i for i, _ in labels if i % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) / len(held) > 0.95 and got[400] == got[401] < 0.5
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, lex).collect())
    none = toxicity.learn(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.0}


def test_exceptions_do_not_count():
    lex = toxicity.Lexicon({" trash ": 5.0})
    assert lex.features("a trash can")[0] == 0 and lex.features("such trash you are")[0] == 5.0


def plain_phrases(text, sample):
    n = at = 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at += max(k, 1)
        n += 1
    return n


def test_phrases_equal_plain_parsing():
    model = language_id.Model({"a": ["abra cadabra abracad"], "b": ["banana bandana"]})
    for text in ("abracadabra", "bananabandana xyz", "dab", "zzz"):
        for k, sample in enumerate(("abra cadabra abracad", "banana bandana")):
            assert model.phrases([text])[0][k] == plain_phrases(text, sample), (text, sample)


def test_languages(spark, docs, prose, odd):
    langs = ["x", "y", "z"]
    texts = [t for k, letters in enumerate(("abcdefg", "defghij", "ghijklm")) for t in prose(40, 40, seed=k, letters=letters)]
    labels = [langs[i // 40] for i in range(120)]
    d = docs(texts, labels)
    model = language_id.fit(d.filter("doc_id % 3 <> 1"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(d, model, ["doc_id"]).collect()}
    assert all(got[i][0] == labels[i] for i in range(120)) and all(0 <= s <= 1 for _, s in got.values())
    rows = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, model, ["doc_id"]).collect()}
    assert [rows[k] for k in (0, 1, 2)] == ["und"] * 3 and len(rows) == odd.count()
    empty = language_id.fit(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.identify(odd, empty, ["doc_id"]).collect()} == {"und"}


def test_phrases_of_long_texts(monkeypatch):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    samples = [" ".join(rnd.choice(words[a:]) for _ in range(300)) for a in (0, 30)]
    texts = [" ".join(rnd.choice(words) for _ in range(1200)), "abab" * 700, "zz" * 300 + samples[0], "q", samples[1] * 4]
    want = [[plain_phrases(t, s) for s in samples] for t in texts]
    assert min(map(len, texts[:2])) > language_id.SEGMENT * 10
    model = language_id.Model({"a": samples[:1], "b": samples[1:]})
    assert model.phrases(texts).tolist() == want
    monkeypatch.setattr(language_id, "BLOCK_LETTERS", 1024)
    assert model.phrases(texts).tolist() == want


def test_automata_are_small_for_any_alphabet():
    rnd = random.Random(7)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    sample = "".join(rnd.choice(letters) for _ in range(40_000))
    model = language_id.Model({"zh": [sample], "en": ["plain words of another language"]})
    assert sum(a.nbytes for a in model.automata) < 4 << 20
    text = sample[100:160] + sample[7:9] + "".join(rnd.choice(letters) for _ in range(400))
    assert model.langs == ["en", "zh"] and model.phrases([text])[0][1] == plain_phrases(text, sample)


def test_sample_is_shared_among_documents():
    assert language_id.shares([5, 1000, 100], 300) == [5, 195, 100] and language_id.shares([3], 9) == [3] and language_id.shares([], 9) == []


def test_every_label_is_learned_and_names_may_clash(spark, docs):
    texts = [f"{chr(0x4E00 + k) * 2} {chr(0x4E00 + k)} abc" for k in range(90)]
    d = docs(texts, [f"l{k}" for k in range(90)])
    got = language_id.identify(d.withColumnRenamed("fp", "lang_pred"), language_id.fit(d), ["doc_id", "lang", "lang_pred"])
    assert got.columns == ["doc_id", "lang", "lang_pred", "score"] and got.filter("lang = lang_pred").count() == 90
    assert language_id.identify(d.limit(0), language_id.fit(d.limit(0)), ["doc_id"]).count() == 0


def test_stage_keeps_columns_of_any_name(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = docs(["plain words", None, "12"]).withColumnRenamed("fp", "lang_pred").withColumnRenamed("h", "score")
    got = pipeline.known_language(spark, d, "")
    assert got.columns == d.columns and [(r["lang_pred"], r["score"]) for r in got.collect()] == [("x", "y")]


def test_benchmark_passages_without_or_with_equal_ids(spark, bench):
    item = "A farmer named Tom has 12 apples and gives 5 kg of them to Anna before he walks 3 miles home with Tom."
    half = item.split()
    rows = [(None, "x " + item, 1), (None, "clean text", 2), (7, "y " + item, 3), (7, "clean as well", 4), (8, " ".join(half[:9]), 5), (8, " ".join(half[9:]), 6), (9, None, 7), (7, "y " + item, 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(d, bench).collect()}
    assert {(None, 1), (7, 1)} <= found
    kept = decontaminate.clean(d, bench)
    assert kept.columns == d.columns and {2, 4, 7} <= {r["item_id"] for r in kept.collect()} and not {1, 3, 8} & {r["item_id"] for r in kept.collect()}
    alone = decontaminate.clean(d.filter("doc_id = 8").limit(1), bench).count()
    assert kept.filter("doc_id = 8").count() in (alone, 2 * alone)


def test_short_items_are_found_word_by_word(spark, docs):
    items = spark.createDataFrame([(1, "Yes"), (2, "forty two"), (3, "The red fox"), (4, "..."), (3, "The red fox")], "item_id long, text string")
    texts = ["oh YES, it is", "forty-two of them", "forty of two", "a quick red fox, the Red Fox", "redfox", "eyes"]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find(docs(texts), items).collect()}
    assert got == {(0, 1): "copy", (1, 2): "copy", (3, 3): "copy"}
    assert [r["doc_id"] for r in decontaminate.clean(docs(texts), items).orderBy("doc_id").collect()] == [2, 4, 5]


def test_toxicity_of_repeated_rows(spark, docs, prose):
    texts = [t + (" vilezor" if i % 4 == 0 else "") for i, t in enumerate(prose(160, 20, seed=12))]
    d = docs(texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    once = toxicity.learn(d, labels, train_rows=120)
    often = toxicity.learn(d.union(d).union(d).union(d), labels, train_rows=120)
    assert often.weights == once.weights and often.coefficients == once.coefficients and once.score("such a vilezor") > 0.5
    assert toxicity.score(d.limit(0), once).count() == 0
    long = toxicity.Lexicon({" " + "x" * 60 + " ": 4.0})
    assert long.features("so " + "x" * 60)[0] == 4.0


def plain_score(lex, text):
    """The score by looking at every entry and place."""
    folded = toxicity.fold(text)
    covered = [(i, i + len(toxicity.fold(p))) for p in lex.exceptions for i in range(len(folded)) if folded.startswith(toxicity.fold(p), i)]
    found = {}
    for entry, w in lex.weights.items():
        for i in range(len(folded)):
            if folded.startswith(entry, i) and not any(a <= i and i + len(entry) <= b for a, b in covered):
                word = folded[i : folded.index(" ", i + 1) + 1]
                found[word] = max(found.get(word, 0.0), w)
    total = sum(found.values())
    a, b, c = lex.coefficients
    import math

    return 1 / (1 + math.exp(-(a + b * total + c * total / math.log(math.e + folded.count(" ")))))


def test_scores_equal_plain_search(spark, docs):
    rnd = random.Random(13)
    lex = toxicity.Lexicon({" trash ": 3.0, " tra": 3.5, " idi": 4.0, " idiot ": 5.0, " can ": 3.1}, coefficients=(-3.0, 0.5, 0.4))
    parts = ["trash", "can", "tr4sh", "idiot", "ідіоt", "trash can", "not stupid", "traffic", "and", "bin", "IDI0T!!", "x"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(150)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(texts), lex).collect()}
    assert all(abs(got[i] - plain_score(lex, t)) < 1e-12 for i, t in enumerate(texts))


def plain_permuted(key, kind, n, x):
    """The keyed permutation once more, written from its description."""
    import hashlib
    import math

    secret = hashlib.blake2b(key, digest_size=32).digest()
    base = math.ceil(math.sqrt(n))
    while True:
        left, right = x // base, x % base
        for k in range(8):
            mixed = hashlib.blake2b(f"{kind}:{n}:{k}:{right}".encode(), key=secret, digest_size=32).hexdigest()
            left, right = right, (left + int(mixed, 16)) % base
        x = left * base + right
        if x < n:
            return x


def test_pseudonyms_equal_brute_force(spark, docs):
    import datetime

    rnd = random.Random(14)
    first = datetime.date(1900, 1, 1)
    days = (datetime.date(2099, 12, 31) - first).days + 1
    texts, want = [], []
    for _ in range(60):
        day = first + datetime.timedelta(rnd.randrange(days))
        new = first + datetime.timedelta(plain_permuted(b"k", "date", days, (day - first).days))
        ip = [rnd.randrange(256) for _ in range(4)]
        n = plain_permuted(b"k", "ip", 256**4, int.from_bytes(bytes(ip), "big"))
        body = [rnd.randrange(10) for _ in range(15)]
        check = next(c for c in range(10) if pii_pseudonyms.luhn("".join(map(str, [*body, c]))) == 0)
        card = plain_permuted(b"k", "card", 10**15, int("".join(map(str, body))))
        card = next(f"{card:015d}{c}" for c in range(10) if pii_pseudonyms.luhn(f"{card:015d}{c}") == 0)
        texts.append(f"on {day:%Y-%m-%d}, {day:%d.%m.%Y} from {'.'.join(map(str, ip))} by {''.join(map(str, body))}{check}, 12 of 99999")
        want.append(f"on {new:%Y-%m-%d}, {new:%d.%m.%Y} from {'.'.join(map(str, n.to_bytes(4, 'big')))} by {card}, 12 of 99999")
    got = [r["text"] for r in pii_pseudonyms.pseudonymise(docs(texts), b"k").orderBy("doc_id").collect()]
    assert got == want


def test_pseudonyms_of_other_shapes(spark, docs, odd):
    values = ["03/25/1990", "3/25/1990", "5/3/1990", "415 555 2671", "078 05 1120", "+44 20 7946 0958", "+4930901820", "a" * 80 + "@example.org", "7.4.1999"]
    clean = ["31/31/1990", "+44 20", "--@example.org", "111 555 2671"]
    d = docs(["; ".join(values + clean)])
    out = pii_pseudonyms.pseudonymise(d, b"key")
    new = out.first()["text"].split("; ")
    assert all(a != b and len(a) == len(b) for a, b in zip(values, new)) and new[len(values) :] == clean
    assert new[0][3:5] > "12" and new[5].startswith("+44 ") and new[6].startswith("+49") and new[7][:16] != "a" * 16
    assert pii_pseudonyms.pseudonymise(out.select(*d.columns), b"key", back=True).first()["text"] == d.first()["text"]
    assert pii_pseudonyms.pseudonymise(odd.limit(0), b"k").count() == 0


def test_runs_of_token_beginnings_take_linear_time():
    import time

    scanner = secret_scan.Scanner()
    start = time.perf_counter()
    assert scanner.spans(["eyJ" * 200_000, "." + "eyJ" * 200_000]) == [[], []]
    assert time.perf_counter() - start < 5
    (span,) = scanner.spans(["see eyJeyJabcdefgh.eyJabcdefgh.abcdefgh"])[0]
    assert span[:2] == (4, 39)
