"""Benchmark decontamination by template windows, with DataFrame operations only.

A text becomes words of letters and digits. Numbers, the units behind them and capitalised words are
slots and are written as typed placeholders; the rest is lower-cased. Windows of `WINDOW` words of a
document's template are hash-joined with those of the benchmark's items. Matched windows of a document
and an item that keep the same distance are one alignment; it counts if its slots are consistent, that
is if each of the item's values stands for one value of the document throughout. A document whose
alignment covers half of an item's windows, or `ENOUGH` of them, has the item: as a copy, or
re-parameterised where slots differ.

A second kind of windows has all capitals folded, keeps names as plain words and types numbers and
units only; it finds copies in another case and, word by word, items of many numbers or names. It is
judged by the same alignment and reported for pairs that typed windows do not find.

Items shorter than a window are one window as long as they are. Windows with fewer than `LITERALS`
plain words (of short items: fewer than half) say too little and are left out as typed windows. Items
of fewer than `LITERALS` words are looked for word by word, whatever their case.

Positions of documents first meet the items' anchors, the first `LITERALS` words of their windows (all
words of shorter items); only where an anchor is met, windows of every size are made and joined. The
benchmark's windows are broadcast only after their number was found to be at most `BROADCAST_WINDOWS`;
beyond it both joins shuffle.

Cases: null and empty texts and items have no windows; documents are told apart by their texts, so
null and equal ids don't mix: `find` returns for each id the best alignment of its texts, null ids
being one id, and `clean` judges each text by itself; items are told apart by id and text, and
repeated rows of an item are one; an empty table on either side gives no rows; other columns are not
looked at by `find` and kept by `clean`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import cut

WINDOW, LITERALS, SHARE, ENOUGH = 8, 4, 0.5, 12
BROADCAST_WINDOWS = 200_000
# The units.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "inch", "inches", "feet", "foot", "ft", "yards", "miles", "mile", "meters", "metres", "meter", "kilometers", "kilometres", "grams", "kilograms", "liters", "litres", "pounds", "lb", "ounces", "oz", "dollars", "dollar", "cents", "euros", "euro", "percent", "degrees", "mph", "kmh", "watts", "volts")
#: The forms of a text's words; they have equally many words.
FORMS = ("plain", "typed", "folded", "literal")
MARKS = ("<num>", "<unit>")


def plain_text(text: Column) -> Column:
    """The words of letters and digits, one blank between two: separators inside numbers are dropped, units are parted from their numbers."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"([0-9])[.,]([0-9])", "$1$2")
    return F.regexp_replace(F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}]+", " ")), r"([0-9])(\p{L})", "$1 $2")


def _marked(plain: Column) -> Column:
    """Numbers, and units behind them, as placeholders."""
    units = F.regexp_replace(plain, rf"(^| )[0-9][^ ]* (?i:{'|'.join(UNITS)})(?= |$)", "$1<num> <unit>")
    return F.regexp_replace(units, r"(^| )[0-9][^ ]*", "$1<num>")


def _fold(text: Column) -> Column:
    return F.lower(F.upper(text))


def _forms(df: DataFrame, text: str, *keep: Column | str) -> DataFrame:
    """The words of each text as they are, typed, folded (numbers and units typed) and literal (folded, nothing typed); texts without words are left out."""
    # The filter reads the text itself: one on a form would be pushed below and make the form twice.
    out = df.filter(F.col(text).rlike(r"[\p{L}\p{N}]")).select(*keep, plain_text(F.col(text)).alias("__plain"))
    out = out.withColumn("__marked", _marked(F.col("__plain")))
    names = F.regexp_replace("__marked", r"(^| )[\p{Lu}\p{Lt}][^ ]*", "$1<name>")
    made = {"plain": F.col("__plain"), "typed": F.lower(names), "folded": _fold(F.col("__marked")), "literal": _fold(F.col("__plain"))}
    return out.select(*[c for c in out.columns if c not in ("__plain", "__marked")], *[F.split(made[c], " ").alias(c) for c in FORMS])


def _few(size: Column) -> Column:
    """The plain words that a window of `size` words needs."""
    return F.least(F.lit(LITERALS), F.ceil(size / 2).cast("int"))


def _window(size: Column, folded: bool) -> Column:
    """Of the first `size` words of the forms: struct (folded, size, words, slots); slots are the words behind placeholders, else null."""
    part = {c: F.slice(c, 1, size) for c in FORMS}
    if not folded:
        slots = F.transform(part["plain"], lambda x, i: F.when(F.get(part["typed"], i).startswith("<"), x))
        return F.struct(F.lit(False).alias("folded"), size.alias("size"), part["typed"].alias("words"), slots.alias("slots"))
    plain = F.size(F.array_remove(F.array_remove(part["folded"], MARKS[0]), MARKS[1]))
    literal = (size < LITERALS) | (plain < _few(size))
    slots = F.transform(part["literal"], lambda x, i: F.when(~literal & F.get(part["folded"], i).isin(*MARKS), x))
    return F.struct(F.lit(True).alias("folded"), size.alias("size"), F.when(literal, part["literal"]).otherwise(part["folded"]).alias("words"), slots.alias("slots"))


def _hash(w: str) -> Column:
    return F.xxhash64(f"{w}.folded", f"{w}.size", f"{w}.words")


def _anchor(words: Callable[[int], Column], size: int) -> Column:
    return F.xxhash64(F.lit(size), *[words(k) for k in range(size)])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, size, pos, folded, hash, words, slots, n): the telling windows of each item and how many of their kind it has."""
    rows = _forms(benchmark.select("item_id", "text").distinct(), "text", "item_id", F.xxhash64("text").alias("item"))
    rows = rows.withColumn("size", F.least(F.lit(WINDOW), F.size("literal")))
    at = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("literal") - F.col("size")))).withColumns({c: F.slice(c, F.col("pos") + 1, F.col("size")) for c in FORMS})
    kinds = F.array(*[_window(F.col("size"), folded) for folded in (False, True)])
    each = at.select("item_id", "item", "pos", F.explode(kinds).alias("w"))
    plain = F.size(F.filter("w.words", lambda x: ~x.startswith("<")))
    telling = F.col("w.folded") | ((F.col("w.size") >= LITERALS) & (plain >= _few(F.col("w.size"))))
    each = each.filter(telling).select("item_id", "item", "pos", _hash("w").alias("hash"), "w.*")
    counts = each.groupBy("item_id", "item", "folded").agg(F.count("*").alias("n"))
    same = (each["item"] == counts["item"]) & (each["folded"] == counts["folded"]) & each["item_id"].eqNullSafe(counts["item_id"])
    return each.join(counts, same).select(each["*"], "n")


def _met(docs: DataFrame, items: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """The windows of documents that equal one of an item: the columns of `docs` but its text, `at`, `held` (slots) and those of `items`."""
    keep = [c for c in docs.columns if c != "text"]
    held = F.broadcast if small else (lambda df: df)
    lengths = sorted({min(k, LITERALS) for k in sizes})
    anchors = items.select(F.when(F.col("size") >= LITERALS, _anchor(lambda k: F.get("words", F.lit(k)), LITERALS)).otherwise(F.coalesce(*[F.when(F.col("size") == k, _anchor(lambda j: F.get("words", F.lit(j)), k)) for k in range(1, LITERALS)])).alias("anchor")).distinct()
    at = lambda form: lambda k: F.get(form, F.col("at") + k)
    own = [F.when(F.col("at") <= F.size("literal") - k, _anchor(at(form), k)) for k in lengths for form in (FORMS[1:] if k == LITERALS else ("literal",))]
    windowed = {c: F.slice(c, F.col("at") + 1, WINDOW) for c in FORMS}
    places = _forms(docs, "text", *keep).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("literal") - 1)))
    # A shuffled join gets the window's words, a broadcast one has the whole text's at hand and cuts windows where an anchor was met.
    if not small:
        places = places.withColumn("anchor", F.explode(F.array_compact(F.array_distinct(F.array(*own))))).withColumns(windowed)
    else:
        places = places.withColumn("anchor", F.explode(F.array_distinct(F.array(*own))))
    places = places.join(held(anchors), "anchor", "left_semi")
    if small:
        places = places.withColumns(windowed)
    windows = [F.when(F.size("literal") >= k, _window(F.lit(k), folded)) for k in sizes for folded in ((False, True) if k >= LITERALS else (True,))]
    found = places.select(*keep, "at", F.explode(F.array_compact(F.array(*windows))).alias("w"))
    found = found.select(*keep, "at", _hash("w").alias("hash"), F.col("w.words").alias("held_words"), F.col("w.slots").alias("held"))
    return found.join(held(items), "hash").filter(F.col("words") == F.col("held_words"))


def _alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row key of `docs` (its columns but text) and each item in it, the best alignment: item_id and r, where a greater r is better."""
    keep = [c for c in docs.columns if c != "text"]
    items = cut(item_windows(benchmark))
    known = items.groupBy("size").count().collect()  # eight rows at most
    small = sum(r["count"] for r in known) <= BROADCAST_WINDOWS
    met = _met(docs, items, sorted(r["size"] for r in known) or [WINDOW], small)
    pairs = F.filter(F.transform(F.arrays_zip("slots", "held"), lambda p: F.struct(p["slots"].alias("item"), p["held"].alias("doc"))), lambda p: p["item"].isNotNull())
    runs = met.groupBy(*keep, "item_id", "item", "folded", (F.col("at") - F.col("pos")).alias("shift")).agg(
        F.size(F.collect_set("pos")).cast("long").alias("n_windows"), F.max("n").alias("item_windows"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))
    enough = (F.col("n_windows") >= SHARE * F.col("item_windows")) | (F.col("n_windows") >= ENOUGH)
    changed = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"])).cast("long")
    rank = F.struct((~F.col("folded")).alias("typed"), "n_windows", (-changed).alias("same"), "item_windows", F.size("pairs").cast("long").alias("n_slots"))
    return runs.filter(consistent & enough).select(*keep, "item_id", rank.alias("r"))


def _text_keys(text: str = "text") -> list[Column]:
    """Two hashes that stand for a text; null is the empty text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("__h1"), F.xxhash64(F.lit(1), whole).alias("__h2")]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document id and item in it: doc_id, item_id, n_windows, item_windows, n_slots, n_changed, kind.

    An alignment of typed windows goes before one of folded windows.
    """
    best = _alignments(docs.select("doc_id", *_text_keys(), "text"), benchmark).groupBy("doc_id", "item_id").agg(F.max("r").alias("r"))
    kind = F.when(F.col("r.same") == 0, "copy").otherwise("re-parameterised")
    return best.select("doc_id", "item_id", "r.n_windows", "r.item_windows", "r.n_slots", (-F.col("r.same")).alias("n_changed"), kind.alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose text has no item, all columns kept. Texts are judged, so null and equal ids need no care."""
    h1, h2 = _text_keys()
    found = _alignments(docs.select(h1, h2, "text"), benchmark).select("__h1", "__h2").distinct()
    own = [f"h{k}_{uuid.uuid4().hex}" for k in (1, 2)]  # names that no column has
    keyed = docs.withColumns(dict(zip(own, (h1, h2))))
    return keyed.join(found.toDF(*own), own, "left_anti").select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for `find` over documents and benchmark."""
    units = ", ".join(f"'{u}'" for u in UNITS)

    def tokens(table: str, key: str) -> str:
        split = r"list_filter(string_split(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])[.,]([0-9])', '\1\2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), '([0-9])(\p{L})', '\1 \2', 'g'), ' '), lambda x: x <> '')"
        number = "WHEN regexp_matches(w[i], '^[0-9]') THEN '<num>' WHEN i > 1 AND regexp_matches(w[i - 1], '^[0-9]') AND lower(w[i]) IN (" + units + ") THEN '<unit>'"
        folded = "lower(upper(replace(w[i], 'ß', 'ss')))"
        name = r"WHEN regexp_matches(w[i], '^[\p{Lu}\p{Lt}]') THEN '<name>'"
        return f"""(SELECT {key}, r, w, [CASE {number} {name} ELSE lower(w[i]) END FOR i IN range(1, len(w) + 1)] AS t, [CASE {number} ELSE {folded} END FOR i IN range(1, len(w) + 1)] AS f, [{folded} FOR i IN range(1, len(w) + 1)] AS l
          FROM (SELECT {key}, row_number() OVER () AS r, {split} AS w FROM (SELECT DISTINCT {key}, text FROM {table})))"""

    def windows(key: str, size: str) -> str:
        """Typed and folded windows of `size`, a table with k words wanted."""
        part = f"(SELECT {key}, r, k, p, w[p + 1:p + k] AS w, t[p + 1:p + k] AS t, f[p + 1:p + k] AS f, l[p + 1:p + k] AS l FROM (SELECT *, unnest(range(0, (len(t) - k + 1)::BIGINT)) AS p FROM {size} WHERE len(t) >= k))"
        few = f"k < {LITERALS} OR len(list_filter(f, lambda x: x[1:1] <> '<')) < least({LITERALS}, ceil(k / 2.0))"
        return f"""SELECT {key}, r, k, p AS pos, false AS folded, t AS win, [w[i] FOR i IN range(1, k + 1) IF t[i][1:1] = '<'] AS slots FROM {part}
          UNION ALL SELECT {key}, r, k, p, true, CASE WHEN {few} THEN l ELSE f END, CASE WHEN {few} THEN [] ELSE [l[i] FOR i IN range(1, k + 1) IF f[i][1:1] = '<'] END FROM {part}"""

    return f"""
    WITH it AS {tokens("benchmark", "item_id")}, dt AS {tokens("documents", "doc_id")},
    iw AS (SELECT * FROM ({windows("item_id", f"(SELECT *, least({WINDOW}, len(t))::BIGINT AS k FROM it WHERE len(t) > 0)")}) WHERE folded OR (k >= {LITERALS} AND len(list_filter(win, lambda x: x[1:1] <> '<')) >= least({LITERALS}, ceil(k / 2.0)))),
    iwn AS (SELECT *, count(*) OVER (PARTITION BY r, folded) AS n FROM iw),
    dw AS ({windows("doc_id", "(SELECT dt.*, s.k FROM dt, (SELECT DISTINCT k FROM iw) s)")}),
    met AS (SELECT doc_id, dw.r AS d, item_id, iwn.r AS i, iwn.folded, dw.pos - iwn.pos AS shift, iwn.pos AS pos, n, list_zip(iwn.slots, dw.slots) AS z FROM dw JOIN iwn ON dw.win = iwn.win AND dw.folded = iwn.folded),
    runs AS (SELECT doc_id, d, item_id, i, folded, shift, count(DISTINCT pos) AS n_windows, max(n) AS item_windows, list_distinct(flatten(list(z))) AS pairs FROM met GROUP BY ALL),
    ok AS (SELECT *, len(list_filter(pairs, lambda x: x[1] <> x[2])) AS changed, len(pairs) AS slots FROM runs WHERE len(pairs) = len(list_distinct([x[1] FOR x IN pairs])) AND (n_windows >= {SHARE} * item_windows OR n_windows >= {ENOUGH})),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY folded, n_windows DESC, changed, item_windows DESC, slots DESC) AS k FROM ok)
    SELECT doc_id, item_id, n_windows, item_windows, slots::BIGINT AS n_slots, changed::BIGINT AS n_changed, CASE WHEN changed = 0 THEN 'copy' ELSE 're-parameterised' END AS kind FROM best WHERE k = 1"""
