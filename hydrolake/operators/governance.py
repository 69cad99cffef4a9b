"""Audit chains, review queue, consent, privacy and quality rules."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.functions import scalars as S


def chain_hash(previous: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), content), 256)


def verify_chain(events: DataFrame) -> DataFrame:
    """Per chain of (chain, seq, content, prev_hash, hash): ok, events checked before the first bad one, its seq.

    Each link is checked by itself: an equi-join on the stored hash finds the event before, which has a smaller
    seq and of which this is the first follower. So no task reads a chain in order, and the first bad event is the
    one that a walk would find. Rows without a hash are skipped, and a chain whose head was pruned starts at its
    first prev_hash.
    """
    rows = events.filter("hash IS NOT NULL").select("chain", "seq", "content", "prev_hash", "hash")
    heads = rows.groupBy("chain").agg(F.min("seq").alias("head"))
    before = rows.groupBy("chain", F.col("hash").alias("prev_hash")).agg(F.min("seq").alias("before"))
    followed = rows.filter("prev_hash IS NOT NULL").groupBy("chain", "prev_hash").agg(F.min("seq").alias("follower"))
    links = before.join(followed, ["chain", "prev_hash"])
    linked = S.holds((F.col("before") < F.col("seq")) & (F.col("follower") == F.col("seq")))
    own = S.holds(F.col("hash") == chain_hash(F.col("prev_hash"), F.col("content")))
    judged = rows.select("chain", "seq", "prev_hash", own.alias("own")).join(heads, "chain").join(links, ["chain", "prev_hash"], "left")
    judged = judged.withColumn("good", F.col("own") & ((F.col("seq") == F.col("head")) | linked)).select("chain", "seq", "good")
    bad = judged.groupBy("chain").agg(F.count("*").alias("n"), F.min(F.when(~F.col("good"), F.col("seq"))).alias("first_bad"))
    sound = judged.join(bad.filter("first_bad IS NOT NULL").select("chain", "first_bad"), "chain").filter("seq < first_bad").groupBy("chain").agg(F.count("*").alias("sound"))
    out = bad.join(sound, "chain", "left")
    checked = F.when(F.col("first_bad").isNull(), F.col("n")).otherwise(F.coalesce("sound", F.lit(0)))
    return out.select("chain", F.col("first_bad").isNull().alias("ok"), checked.alias("checked"), "first_bad")


def append_chain(events: DataFrame) -> DataFrame:
    """(chain, seq, content) with prev_hash and hash: each chain is hashed in order, in one pass over its rows."""
    kind = events.select("chain", "seq", "content").schema

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        before, prev, own = "", [], []
        for content in pdf["content"]:
            prev.append(before or None)
            before = hashlib.sha256(f"{before}|{content}".encode()).hexdigest()
            own.append(before)
        return pdf.assign(prev_hash=prev, hash=own)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields)
    return events.select("chain", "seq", "content").groupBy("chain").applyInPandas(link, fields + ", prev_hash string, hash string")


def review_queue(events: DataFrame) -> DataFrame:
    """Events (item, seq, action, label, classes, override) with `outcome`, in order per item.

    A submission needs other than one class and no earlier decision; a decision needs a submission, a
    label of its classes or 'other', and an override where one was accepted before.
    """
    upto = W.partitionBy("item").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    submit, decide = F.col("action") == "submit", F.col("action") == "decide"
    open_ = submit & (F.size("classes") != 1)
    classes = F.last(F.when(open_, F.col("classes")), ignorenulls=True).over(upto)
    rows = events.withColumn("known", classes)
    valid = decide & F.col("known").isNotNull() & ((F.col("label") == "other") | F.array_contains("known", F.col("label")))
    rows = rows.withColumn("valid", S.holds(valid)).withColumn("decided", F.coalesce(F.max("valid").over(upto), F.lit(False)))
    outcome = (
        F.when(submit & (F.size("classes") == 1), "refused-singleton").when(submit & F.col("decided"), "refused-decided").when(submit, "pending")
        .when(F.col("known").isNull(), "refused-unknown-item").when(F.col("decided") & ~S.holds(F.col("override")), "refused-decided").when(~F.col("valid"), "refused-label").otherwise("decided")
    )
    return rows.withColumn("outcome", outcome).drop("known", "valid", "decided")


def review_state(queue: DataFrame) -> DataFrame:
    """Per item the latest accepted event."""
    ok = queue.filter(F.col("outcome").isin("pending", "decided"))
    return ok.groupBy("item").agg(F.max_by("outcome", "seq").alias("status"), F.max_by("label", "seq").alias("label"), F.count("*").alias("n_accepted"))


def consent_active(records: DataFrame, consents: DataFrame) -> DataFrame:
    """Records (subject, scope, at) under a consent granted by then and not revoked; raises on revocations before grants.

    A sweep: grants open and revocations close, and a record is covered while more were opened than closed by then.
    Running sums go over months first and over the events of a month after, so a subject with very many events is
    spread over tasks by month, and the cost is that of ordering events, not of pairs.
    """
    if not consents.filter("revoked_at < granted_at").isEmpty():
        raise ValueError("a consent was revoked before it was granted")
    key = ["subject", "scope"]
    event = lambda df, at, step, row: df.filter(F.col(at).isNotNull()).select(*key, F.col(at).cast("timestamp").alias("__at"), F.lit(step).cast("long").alias("__step"), row.alias("__row"))
    row = F.struct(*records.columns)
    none = F.lit(None).cast(records.select(row.alias("r")).schema["r"].dataType)
    known = consents.filter("subject IS NOT NULL AND scope IS NOT NULL AND granted_at IS NOT NULL")
    events = event(known, "granted_at", 1, none).unionByName(event(known, "revoked_at", -1, none)).unionByName(event(records, "at", 0, row))
    events = events.withColumn("__month", F.date_trunc("month", "__at"))
    months = events.groupBy(*key, "__month").agg(F.sum("__step").alias("__net"))
    before = F.sum("__net").over(W.partitionBy(*key).orderBy("__month")) - F.col("__net")
    opened = months.withColumn("__open", before).drop("__net")
    # Of one instant, grants and revocations come before records.
    within = W.partitionBy(*key, "__month").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    placed = events.withColumn("__own", F.sum("__step").over(within)).join(opened, [*key, "__month"])
    return placed.filter(F.col("__row").isNotNull() & (F.col("__open") + F.col("__own") > 0)).select("__row.*")


def k_anonymity(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Groups of the quasi-identifiers, nulls as values, with fewer than k rows."""
    return df.groupBy(*quasi).agg(F.count("*").alias("n")).filter(F.col("n") < k)


def findings(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row for each rule that a row breaks: `keep` and `finding`. One pass, no shuffle."""
    return df.select(*keep, F.explode(F.array_compact(F.array(*[F.when(S.holds(c), F.lit(k)) for k, c in rules.items()]))).alias("finding"))


def range_rules(value: Column, low: Column, high: Column, system: Column, code: Column, allowed: list[str]) -> dict[str, Column]:
    return {"physical-range": (value < low) | (value > high), "ucum-system": system != "http://unitsofmeasure.org", "ucum-unit": ~code.isin(allowed)}


def statistics_rules() -> dict[str, Column]:
    """Rules over columns minimum, median, average, maximum."""
    low, mid, avg, high = map(F.col, ("minimum", "median", "average", "maximum"))
    return {"min-above-max": low > high, "median-outside": (mid < low) | (mid > high), "average-outside": (avg < low) | (avg > high)}


def report(found: DataFrame, by: list[str], id_col: str, examples: int = 20) -> DataFrame:
    """Findings by code and `by`, with the `examples` smallest ids.

    Ranks are limited within tasks before the shuffle.
    """
    w = W.partitionBy("finding", *by).orderBy(id_col)
    first = found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= examples).groupBy("finding", *by).agg(F.array_join(F.array_sort(F.collect_list(id_col)).cast("array<string>"), ",").alias("examples"))
    return found.groupBy("finding", *by).agg(F.count("*").alias("n")).join(first, ["finding", *by])


def profile_rules() -> dict[str, Column]:
    """Structural rules over nested observations (see index.OBSERVATION)."""
    return {
        "status-not-final": F.col("status") != "final", "code-missing": F.size(F.coalesce("code.coding", F.array().cast("array<struct<system: string, code: string, display: string>>"))) == 0,
        "subject-missing": F.col("subject.reference").isNull(), "effective-missing": F.col("effectiveDateTime").isNull() & F.col("effectivePeriod").isNull(), "performer-missing": F.coalesce(F.size("performer"), F.lit(0)) <= 0,
        "value-missing": F.col("valueQuantity").isNull() & (F.coalesce(F.size("component"), F.lit(0)) <= 0), "component-value-missing": F.exists("component", lambda c: c["valueQuantity"]["value"].isNull() & c["valueQuantity"]["comparator"].isNull()),
    }


def reference_type(reference: Column, explicit: Column | None = None) -> Column:
    """The type of resource that a reference names: its own `type`, else the part before the id of a path; null where neither tells."""
    path = F.regexp_replace(reference, r"(?:^|/+)_history(?:[/?].*)?$|\?.*$", "")
    named = F.nullif(F.regexp_extract(path, r"([^/]+)/+[^/]+/*$", 1), F.lit(""))
    told = F.when(~reference.rlike("^(urn:|#)"), named)
    return told if explicit is None else F.coalesce(explicit, told)


# The members that may hold a value.
VALUE_KEYS, COMPONENT_VALUE_KEYS = ("valueCodeableConcept", "valueQuantity"), ("valueCodeableConcept", "valueString", "valueQuantity")


def indicator_rules(profile: str, explicit: bool = False) -> dict[str, Column]:
    """Rules of the profiles `indicators` and `health-measure` over rows of members.

    Rows have status, codes, subject_reference, effective_keys, n_performers, value_keys, specimen, focus and
    component_keys: the names of members of one kind, and of each component, as arrays. With `explicit` they also
    have what references say of their type: subject_type, specimen_type, and focus_types beside focus.
    """
    said = (lambda c: F.col(c)) if explicit else (lambda c: None)
    other = lambda ref, kind, own=None: S.holds(reference_type(ref, own) != kind)
    beyond = lambda keys, known: F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0
    rules = {
        "status": ~F.col("status").eqNullSafe("final"), "code": F.size("codes") == 0, "subject": F.col("subject_reference").isNull(), "subject-type": other(F.col("subject_reference"), "Location", said("subject_type")),
        "effective": F.size("effective_keys") == 0, "value-type": beyond(F.col("value_keys"), VALUE_KEYS),
    }
    if profile == "indicators":
        first = lambda keys: F.get(keys, F.lit(0))
        rules |= {
            "performer": F.col("n_performers") == 0, "specimen-type": other(F.col("specimen"), "Specimen", said("specimen_type")), "component-value": F.exists("component_keys", lambda k: F.size(k) == 0),
            "component-value-type": F.exists("component_keys", lambda k: S.holds(~first(k).isin(*COMPONENT_VALUE_KEYS))),
        }
    else:
        types = F.col("focus_types") if explicit else F.transform("focus", lambda r: F.lit(None).cast("string"))
        rules |= {"focus-type": F.exists(F.zip_with("focus", types, lambda r, t: other(r, "Group", t)), lambda wrong: wrong)}
    return {f"{profile}-{k}": c for k, c in rules.items()}


def component_rules() -> dict[str, Column]:
    """Rules of the profile of observations that hold components only, over rows with value_keys and component_keys."""
    return {"observation-value": F.size("value_keys") > 0, "observation-component": F.coalesce(F.size("component_keys"), F.lit(0)) <= 0}


def location_rules() -> dict[str, Column]:
    """Rules over places (n_identifiers, name, mode)."""
    return {"location-identifier": F.col("n_identifiers") == 0, "location-name": ~S.holds(F.trim("name") != ""), "location-mode": ~F.col("mode").eqNullSafe("instance")}


def observation_findings(obs: DataFrame, allowed: list[str]) -> DataFrame:
    """(id, site, profile, finding): a row for each rule that a nested observation breaks, and for each of its quantities.

    Statistics have to be in order, the quantities of statistics in allowed units, and a quantity with a
    comparator is a bound and not a value.
    """
    names = ("minimum", "median", "average", "maximum")
    coded = F.transform("component", lambda c: F.struct(F.get(F.filter(F.transform(c["code"]["coding"], lambda x: x["code"]), lambda x: x.isin(*names)), F.lit(0)).alias("k"), c["valueQuantity"].alias("q")))
    rows = obs.select("id", F.element_at(F.split("subject.reference", "/"), -1).alias("site"), F.coalesce(F.get("meta.profile", F.lit(0)), F.lit("no profile")).alias("profile"), "valueQuantity", "component", F.filter(F.coalesce(coded, F.array().cast(_CODED)), lambda s: s["k"].isNotNull() & s["q"]["value"].isNotNull()).alias("s"))
    last = lambda k: F.element_at(F.filter("s", lambda x: x["k"] == k), -1)["q"]["value"]
    some = lambda k: F.when(F.exists("s", lambda x: x["k"] == k), last(k))
    low, mid, avg, high = map(some, names)
    order = {"statistical-bounds": low > high, "statistical-order": ~mid.between(low, high), "mean-range": ~avg.between(low, high)}
    units = F.transform("s", lambda x: F.when(~x["q"]["system"].eqNullSafe("http://unitsofmeasure.org"), "ucum-system").when(~S.holds(x["q"]["code"].isin(allowed)), "ucum-unit"))
    bounds = F.transform(F.concat(F.array("valueQuantity"), F.coalesce(F.transform("component", lambda c: c["valueQuantity"]), F.array().cast(_QUANTITIES))), lambda q: F.when(S.holds(q["comparator"] != ""), "censored-quantity"))
    found = F.array_compact(F.concat(F.array(*[F.when(S.holds(c), F.lit(k)) for k, c in order.items()]), units, bounds))
    return rows.select("id", "site", "profile", F.explode(found).alias("finding"))


_QUANTITY = "struct<value: double, comparator: string, unit: string, system: string, code: string>"
_QUANTITIES, _CODED = f"array<{_QUANTITY}>", f"array<struct<k: string, q: {_QUANTITY}>>"


def observation_counts(obs: DataFrame, review: list[str]) -> DataFrame:
    """(what, name, n): observations by profile, site and origin, quantities of components by code, those without a code, and those to review.

    All of it is one aggregation over rows that name what they count.
    """
    ucum = F.filter(F.coalesce(F.transform("component", lambda c: c["valueQuantity"]), F.array().cast(_QUANTITIES)), lambda q: S.holds(q["system"] == "http://unitsofmeasure.org"))
    row = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    one = F.array(row("profile", F.coalesce(F.get("meta.profile", F.lit(0)), F.lit("no profile"))), row("site", F.coalesce(F.element_at(F.split("subject.reference", "/"), -1), F.lit("unknown"))), row("origin", F.when(official_reason().isNull(), "official").otherwise("other")))
    codes = F.transform(ucum, lambda q: F.when(q["code"].isNull(), row("without-code", F.lit("quantity"))).otherwise(row("code", q["code"])))
    again = F.transform(F.filter(ucum, lambda q: S.holds(q["code"].isin(review))), lambda q: row("review", q["code"]))
    return obs.select(F.explode(F.concat(one, codes, again)).alias("r")).select("r.*").groupBy("what", "name").agg(F.count("*").alias("n"))


def official_reason(third_party: tuple[str, ...] = ("sl-", "third-party"), guide: str = "guide") -> Column:
    """The first rule by which a nested observation is not official; null if it is.

    `guide` is the short name that ends the names of official profiles.
    """
    tag = lambda t: S.holds(F.exists("meta.tag", lambda x: x["code"] == t))
    marked = lambda x: F.lit(False) if not third_party else F.array_contains(F.transform(F.array(*map(F.lit, third_party)), lambda m: F.when(m == "sl-", F.startswith(x, m)).otherwise(F.contains(x, m))), True)
    other = S.holds(F.exists("meta.profile", lambda p: marked(F.element_at(F.split(p, "/"), -1)))) | S.holds(F.exists("code.coding", lambda c: marked(F.coalesce(c["code"], F.lit(""))) | marked(F.coalesce(c["system"], F.lit("")))))
    return (
        F.when(tag("simulated"), "tag-simulated").when(tag("demo"), "tag-demo").when(tag("synthetic"), "tag-synthetic").when(other, "third-party")
        .when(F.coalesce(F.size("meta.profile"), F.lit(0)) <= 0, "no-profile").when(~S.holds(F.exists("meta.profile", lambda p: F.endswith(p, F.lit(guide)))), "other-profile")
    )


def label_origin(df: DataFrame, default: str | None) -> DataFrame:
    """Rows with (tag) and `origin`: synthetic if tagged so, else the declared default, else an error."""
    out = df.withColumn("origin", F.when(F.col("tag") == "synthetic", "synthetic").otherwise(F.lit(default)))
    if default is None and not out.filter("origin IS NULL").isEmpty():
        raise ValueError("untagged rows need a declared origin")
    return out


def assert_single_origin(df: DataFrame) -> None:
    if df.select("origin").distinct().limit(2).count() > 1:
        raise ValueError("the batch mixes origins")


def classify_by_prefix(ids: Column, prefixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | ids.startswith(p)
    return F.when(hit, "official").otherwise("other")


def combine_freshness(df: DataFrame, by: list[str]) -> DataFrame:
    """Worst status and oldest time."""
    rank = S.lookup(F.col("status"), {"live": 0, "snapshot": 1, "snapshot-stale": 2, "unknown": 3}, F.lit(3))
    return df.groupBy(*by).agg(F.max_by("status", rank).alias("status"), F.min("as_of").alias("as_of"))
