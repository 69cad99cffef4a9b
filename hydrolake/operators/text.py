"""Checks of texts against tables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.functions import scalars as S

# Number words, numbers that need no evidence, units with their spellings (lower case, no blanks), and nouns that writers count their own points by.
ONES = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
LARGE = {"hundred": 100, "thousand": 1000, "million": 1_000_000}
WORDS = ONES | TENS | LARGE
FREE = (0.0, 1.0, 100.0)
UNITS = {
    "mg/L": ("mg/l", "milligramperliter", "milligramsperliter", "milligramperlitre"), "ug/L": ("ug/l", "microgramperliter", "microgramsperliter", "microgramperlitre"), "ng/L": ("ng/l",), "g/L": ("g/l",), "uS/cm": ("us/cm",), "mS/cm": ("ms/cm",), "ug/m3": ("ug/m3",), "mg/m3": ("mg/m3",),
    "Cel": ("cel", "°c", "celsius", "degreescelsius", "degc"), "degF": ("°f", "fahrenheit", "degreesfahrenheit", "degf"), "%": ("%", "percent", "percentage", "percentagepoints"), "NTU": ("ntu",),
}
POINTS = ("points", "things", "reasons", "steps", "options", "caveats", "notes", "questions", "kinds", "types", "parts", "sections", "items", "categories")

NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[eE][+~]?[0-9]+)?"
_ANY = "(?:" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")"
_ONE = "(?:" + "|".join(w for w, k in ONES.items() if k < 10) + ")"
#: Number words in a row, and spoken decimals behind them.
RUN = rf"\b{_ANY}(?:[- ]{_ANY})*\b(?:\s+point(?:\s+{_ONE})+\b)?"
UNIT = "|".join(r"\s*".join(x) + (r"\b" if x[-1].isalnum() else "") for x in sorted((y for v in UNITS.values() for y in v), key=lambda y: (-len(y), y)))
#: A match: sign, number in digits or words, and behind it a unit or one of the nouns.
MENTION = rf"(?i)(-?)({NUMBER}|{RUN})(?:(\s*(?:{UNIT}))|(\s+(?:{'|'.join(POINTS)})\b))?"
#: Characters that compatibility composition may change: those of the first 768 that it does, and all behind.
CHANGED = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x300) if unicodedata.normalize("NFKC", chr(c)) != chr(c)) + r"\x{300}-\x{10ffff}]"


def composed(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts in compatibility composition. Only texts with a character that it may change leave the JVM."""
    odd = F.coalesce(F.col(text_col).rlike(CHANGED), F.lit(False))

    @F.pandas_udf("string")
    def compose(column: pd.Series) -> pd.Series:
        return column.map(lambda t: unicodedata.normalize("NFKC", t))

    return texts.filter(~odd).unionByName(texts.filter(odd).withColumn(text_col, compose(text_col)))


def plain_marks(text: Column) -> Column:
    """The text with one form of minus signs and micro signs and plain cubes; a hyphen behind a letter, digit or bracket is a blank, that of an exponent a tilde."""
    one = F.translate(F.coalesce(text, F.lit("")), "\u2212\u00b5\u03bc\u00b3", "-uu3")
    return F.regexp_replace(F.regexp_replace(one, r"([0-9][eE])-([0-9])", "$1~$2"), r"([\p{L}\p{N}_)])-", "$1 ")


def spoken(words: Column) -> Column:
    """Number words in a row as numbers: a word below hundred takes the digit behind it, all else stands alone."""

    def step(groups: Column, word: Column) -> Column:
        last = F.element_at(groups, -1)
        small = S.lookup(F.lower(word), ONES).between(1, 9)
        open_ = (F.size(groups) > 0) & ~F.contains(F.coalesce(last, F.lit("")), F.lit(" ")) & ~F.lower(F.coalesce(last, F.lit(""))).isin(*LARGE)
        joined = F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, word)))
        return F.when(S.holds(small & open_), joined).otherwise(F.concat(groups, F.array(word)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def _numbers(match: Column) -> Column:
    """The numbers of one match, as (sign, raw, tail, unit, counts_points): a row of words can hold several."""
    part = lambda k: F.regexp_extract(match, MENTION, k)
    token, tail = part(2), r"(?i)(?<!hundred|thousand|million)(\s+point\s.*)$"
    said = F.regexp_extract(token, tail, 1)
    heads = F.when(token.rlike("^[0-9]"), F.array(token)).otherwise(spoken(F.split(F.regexp_replace(token, r"(?i)\s+point\s.*$", ""), "[- ]")))
    # Decimals behind hundred, thousand or million are numbers of their own.
    loose = F.when((said == "") & token.rlike(r"(?i)\spoint\s"), spoken(F.split(F.regexp_extract(token, r"(?i)\s+point\s+(.*)$", 1), r"\s+"))).otherwise(F.array().cast("array<string>"))
    both = F.concat(heads, loose)
    end = F.size(both) - 1
    at_end = lambda i, c, other: F.when(i == end, c).otherwise(F.lit(other))
    return F.transform(both, lambda w, i: F.struct(F.when(i == 0, part(1)).otherwise("").alias("sign"), w.alias("raw"), at_end(i, said, "").alias("tail"), at_end(i, part(3), "").alias("unit"), at_end(i, part(4), "").alias("noun")))


def mentions(texts: DataFrame, id_col: str = "id") -> DataFrame:
    """Numbers of texts (id, text), in digits or words: (id, place, raw, value, decimals, unit, counts_points).

    Texts are read in compatibility composition. `decimals` is how many the text writes, less an exponent; `unit` is
    the known unit behind the number.
    """
    matches = F.regexp_extract_all(plain_marks(F.col("text")), F.lit(MENTION), F.lit(0))
    found = composed(texts.select(id_col, "text")).select(id_col, F.posexplode(F.flatten(F.transform(matches, _numbers))).alias("place", "m")).select(id_col, "place", "m.*")
    digits = F.col("raw").rlike("^[0-9]")
    written = F.translate(F.regexp_replace("raw", ",", ""), "~", "-")
    mantissa, power = F.regexp_extract(written, r"\.([0-9]+)", 1), F.coalesce(F.regexp_extract(written, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    said = F.filter(F.split(F.lower("tail"), r"\s+"), lambda w: w.isin(*ONES))
    decimals = F.when(digits, F.greatest(F.length(mantissa) - power, F.lit(0))).otherwise(F.size(said))
    whole = F.aggregate(F.split(F.lower("raw"), " "), F.lit(0), lambda x, w: x + F.coalesce(S.lookup(w, WORDS), F.lit(0)))
    behind = F.array_join(F.transform(said, lambda w: S.lookup(w, ONES).cast("string")), "")
    spelled = F.concat_ws(".", whole.cast("string"), F.nullif(behind, F.lit(""))).cast("double")
    value = F.when(digits, written.try_cast("double")).otherwise(spelled) * F.when(F.col("sign") == "-", -1.0).otherwise(1.0)
    unit = S.lookup(F.regexp_replace(F.lower("unit"), r"\s+", ""), {x: u for u, v in UNITS.items() for x in v})
    raw = F.concat("sign", F.translate("raw", "~", "-"), "tail")
    return found.select(id_col, "place", raw.alias("raw"), value.alias("value"), decimals.cast("int").alias("decimals"), unit.alias("unit"), (F.col("noun") != "").alias("counts_points")).filter("value IS NOT NULL")


def ungrounded(texts: DataFrame, evidence: DataFrame, id_col: str = "id", counts: DataFrame | None = None) -> DataFrame:
    """Mentions of texts (id, text) that evidence (id, value, unit) of the same id does not bear out: (id, place, raw, value, unit, problem).

    A number with d decimals is borne out by a value within half of its last digit: `ungrounded` without one,
    `unit-mismatch` if all such values have other units. A percentage is also borne out by a fraction without a
    unit. 0, 1, 100, counts of the writer's own points (2 to 10) and the sizes of lists in `counts` (id, n) are free.

    Mentions meet values by an equi-join on id, decimals and the cell of the last digit. Each value is put into the
    one or two cells of every number of decimals that its id's texts use, so an id's mentions and values never form
    a product.
    """
    found = mentions(texts, id_col).withColumn("cell", F.round(F.col("value") * F.pow(F.lit(10.0), "decimals")))
    own = evidence.select(F.col(id_col), F.col("value").alias("known"), (F.col("unit") if "unit" in evidence.columns else F.lit(None).cast("string")).alias("known_unit"))
    fraction = F.col("known_unit").isNull() & F.col("known").between(0, 1)
    forms = F.filter(F.array(F.struct(F.col("known").alias("x"), F.lit(False).alias("fraction")), F.when(fraction, F.struct((F.col("known") * 100).alias("x"), F.lit(True).alias("fraction")))), lambda s: s.isNotNull())
    scaled = own.select("*", F.explode(forms).alias("f")).join(found.select(id_col, "decimals").distinct(), id_col).withColumn("y", F.col("f.x") * F.pow(F.lit(10.0), "decimals"))
    # A value half between two cells bears out both.
    near = F.array_distinct(F.array(F.floor(F.col("y") + 0.5 + 1e-9).cast("double"), F.ceil(F.col("y") - 0.5 - 1e-9).cast("double")))
    none, plain = F.col("known_unit").isNull(), ~F.col("f.fraction")
    held = scaled.select("*", F.explode(near).alias("cell")).groupBy(id_col, "decimals", "cell").agg(
        F.max(plain).alias("any"), F.max(plain & none).alias("bare"), F.collect_set(F.when(plain, F.col("known_unit"))).alias("units"),
        F.max(F.col("f.fraction") | (plain & S.holds(F.col("known_unit") == "%")) | (plain & none & (F.col("known") > 1))).alias("percent"),
    )
    met = found.join(held, [id_col, "decimals", "cell"], "left")
    whole = F.col("value") == F.floor("value")
    free = F.col("value").isin(*FREE) | (F.col("counts_points") & whole & F.col("value").between(2, 10))
    if counts is not None:
        met = met.join(counts.select(id_col, F.col("n").cast("double").alias("value"), F.lit(True).alias("listed")).distinct(), [id_col, "value"], "left")
        free = free | S.holds(F.col("listed"))
    fits = S.holds(F.col("bare")) | S.holds(F.array_contains("units", F.col("unit")))
    problem = F.when(F.col("unit") == "%", F.when(~S.holds(F.col("percent")), "ungrounded")).when(~S.holds(F.col("any")), "ungrounded").when(F.col("unit").isNotNull() & ~fits, "unit-mismatch")
    return met.filter(~free).withColumn("problem", problem).filter("problem IS NOT NULL").select(id_col, "place", "raw", "value", "unit", "problem")


def translation_check(source: Column, target: Column, numerals: str = r"(?![0-9])\p{N}", invisible: str = r"[\u200b-\u200f\u202a-\u202e\u2060\ufeff]") -> Column:
    """What is wrong with a translation: numbers differ, numerals beyond ASCII, invisible characters, odd length.

    `numerals` and `invisible` are patterns of the characters that are told. Any translation of an empty text has an odd length.
    """
    # Possessive, so that no list of numbers is too long for the pattern's stack.
    tokens = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"\d++(?:[.,]\d++)*+"), F.lit(0)))
    ratio = F.try_divide(F.length(target).cast("double"), F.length(source).cast("double"))
    odd = (ratio < 0.4) | (ratio > 3.0) | ((F.length(source) == 0) & target.isNotNull())
    return S.flags(numbers_differ=tokens(source) != tokens(target), foreign_numerals=target.rlike(numerals), invisible_characters=target.rlike(invisible), length_ratio=odd)


def partial_time(text: Column, zone: str) -> Column:
    """A struct (start, end, precision, issue) of year, month, day or second text: a half-open UTC interval.

    Days begin at local midnight of `zone`, so a day can have 23 or 25 hours. A local second that the
    clocks skip or repeat has an issue and no interval, as has a text of another form.
    """
    t = F.trim(text)
    utc = lambda local: F.to_utc_timestamp(local, zone)
    forms = {"year": (r"^\d{4}$", F.concat(t, F.lit("-01-01")), "interval 1 year"), "month": (r"^\d{4}-\d{2}$", F.concat(t, F.lit("-01")), "interval 1 month"), "day": (r"^\d{4}-\d{2}-\d{2}$", t, "interval 1 day")}
    precision = F.when(t.rlike(r"^\d{4}$"), "year").when(t.rlike(r"^\d{4}-\d{2}$"), "month").when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})?$"), "second")
    start = end = F.lit(None).cast("timestamp")
    for name, (_, day, span) in forms.items():
        local = F.when(precision == name, F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
        start, end = F.coalesce(utc(local), start), F.coalesce(utc(local + F.expr(span)), end)
    offset = t.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    plain = F.when((precision == "second") & ~offset, F.try_to_timestamp(F.regexp_replace(t, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))
    at = utc(plain)
    skipped = F.from_utc_timestamp(at, zone) != plain
    hour = F.expr("interval 1 hour")
    repeated = (F.from_utc_timestamp(at + hour, zone) == plain) | (F.from_utc_timestamp(at - hour, zone) == plain)
    fixed = F.when((precision == "second") & offset, F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    issue = F.when(precision.isNull(), "form").when(skipped, "skipped-local-time").when(repeated, "repeated-local-time").when(F.coalesce(start, at, fixed).isNull(), "no-such-time")
    second = F.coalesce(fixed, at)
    clear = lambda c: F.when(issue.isNull(), c)
    return F.struct(clear(F.coalesce(start, second)).alias("start"), clear(F.coalesce(end, second + F.expr("interval 1 second"))).alias("end"), precision.alias("precision"), issue.alias("issue"))
