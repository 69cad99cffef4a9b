"""Queries over season classifications and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolake.functions import scalars as S
from hydrolake.operators import bathing as B
from hydrolake.operators import samples as X
from hydrolake.operators.lineage import shared_path
from hydrolake.plans.registry import Tables, query
from hydrolake.plans.views import COUNTRY_SQL, select
from hydrolake.sources import readers

CLASSES = [
    "CASE WHEN o_orderkey % 53 = 0 THEN 'FR' WHEN o_custkey % 3 = 0 THEN 'IT' WHEN o_custkey % 3 = 1 THEN 'EL' WHEN o_orderkey % 31 = 0 THEN 'IT' ELSE 'NO' END AS country_code",
    "CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE 'W' || CAST(o_custkey AS STRING) END AS bw_id",
    "CASE WHEN o_orderkey % 89 = 0 THEN '1998.5' ELSE CAST(year(o_orderdate) AS STRING) END AS season",
    "CASE o_orderpriority WHEN '1-URGENT' THEN '1 - Excellent' WHEN '2-HIGH' THEN '2 - Good' WHEN '3-MEDIUM' THEN '3 - Sufficient' WHEN '4-NOT SPECIFIED' THEN '4 - Poor' ELSE CASE WHEN o_orderkey % 2 = 0 THEN '0 - Not classified' END END AS quality",
    "o_orderstatus AS calendar", "CASE WHEN o_orderkey % 2 = 0 THEN 'm' END AS management",
    "CAST(o_totalprice / 5000 AS STRING) AS lat", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey / 10.0 AS STRING) END AS lon",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'https://example.org/' || CAST(o_orderkey AS STRING) ELSE 'ftp://x' END AS profile",
    "'G' || CAST(o_custkey % 7 AS STRING) AS group_id", "CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'Beach ' || CAST(o_orderkey AS STRING) END AS name", "CASE WHEN o_custkey % 2 = 0 THEN 'coastal' ELSE 'lake' END AS type", "CASE WHEN o_orderkey % 6 = 0 THEN 'closed' END AS `constraint`",
]
CLEAN = f"""raw AS {select(CLASSES, "orders").replace("`", chr(34))},
typed AS (SELECT {COUNTRY_SQL.format(c="country_code")} AS country, trim(bw_id) AS bw_id, CASE WHEN TRY_CAST(season AS DOUBLE) = floor(TRY_CAST(season AS DOUBLE)) AND TRY_CAST(season AS DOUBLE) BETWEEN 1900 AND 2100 THEN CAST(TRY_CAST(season AS DOUBLE) AS INT) END AS season, trim(quality) AS quality, calendar, management,
  CASE WHEN TRY_CAST(lat AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(lon AS DOUBLE) BETWEEN -180 AND 180 THEN TRY_CAST(lat AS DOUBLE) END AS lat, CASE WHEN TRY_CAST(lat AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(lon AS DOUBLE) BETWEEN -180 AND 180 THEN TRY_CAST(lon AS DOUBLE) END AS lon,
  CASE WHEN regexp_matches(trim(profile), '^(?i)https?://[^ ]+$') THEN trim(profile) END AS profile, nullif(trim(group_id), '') AS group_id, nullif(trim(name), '') AS name, nullif(trim(type), '') AS type, nullif(trim("constraint"), '') AS "constraint" FROM raw),
clean AS (SELECT *, CASE WHEN country IS NULL THEN 'country' WHEN coalesce(bw_id, '') = '' THEN 'id' WHEN season IS NULL THEN 'season' END AS reason FROM typed),
deduped AS (SELECT * FROM (SELECT bw_id, season, country, quality, calendar, management, lat, lon, profile, group_id, name, type, "constraint", row_number() OVER (PARTITION BY bw_id, season ORDER BY quality NULLS FIRST, calendar NULLS FIRST, management NULLS FIRST, lat NULLS FIRST, lon NULLS FIRST, profile NULLS FIRST, group_id NULLS FIRST, name NULLS FIRST, type NULLS FIRST, "constraint" NULLS FIRST) AS k FROM (SELECT *, min(country) OVER (PARTITION BY bw_id) AS own FROM clean WHERE reason IS NULL) WHERE country = own) WHERE k = 1)"""
LABEL = "CASE WHEN regexp_matches(quality, '^[0-9]+ ?- ?.+$') THEN trim(regexp_extract(quality, '^[0-9]+ ?- ?(.+)$', 1)) END"
RANK = "CASE {c} WHEN '1 - Excellent' THEN 0 WHEN '2 - Good' THEN 1 WHEN '3 - Sufficient' THEN 2 WHEN '4 - Poor' THEN 3 END"


def classes(t: Tables):
    return B.clean(t.view("orders", CLASSES))


def deduped(t: Tables):
    return B.dedupe(classes(t).filter("reason IS NULL"))


@query(f"WITH {CLEAN} SELECT * FROM clean")
def s3_read_classifications(t: Tables):
    return classes(t)


@query(f"WITH {CLEAN} SELECT * FROM clean")
def s3_classification_files(t: Tables):
    """The rows land as CSV under their thirteen names once, and are read by their header."""
    path = shared_path(t.spark, "classifications")
    raw = t.view("orders", CLASSES).select(*[F.col(v).alias(k) for k, v in readers.CLASSIFICATION_NAMES.items()])
    raw.select(*reversed(raw.columns)).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return B.clean(readers.read_classifications(t.spark, path))


PAGES = ["CASE event_id % 3 WHEN 0 THEN 'IT' WHEN 1 THEN 'GR' ELSE 'NO' END AS prefix", "event_id + 1 AS uid", "CAST(floor(event_id / 3000) AS INT) + 1 AS seq", "value", "event_type", "user_id", "ts"]


@query(f"""WITH raw AS {select(PAGES, "events")}
SELECT prefix, seq, count(*) AS n, min(uid) AS first_uid, max(uid) AS last_uid, count(*) FILTER (WHERE event_type = 'error') AS n_limits, count(DISTINCT user_id) AS n_waters FROM raw WHERE prefix <> 'NO' OR seq < 3 GROUP BY 1, 2""")
def s4_page_files(t: Tables):
    """Pages land as files; of one prefix the third page has a wrong link, so it and all behind it are left."""
    raw = t.view("events", PAGES)
    row = F.struct(
        F.col("uid").alias("UID"), F.date_format("ts", "yyyy").alias("season"), F.concat("prefix", F.col("user_id").cast("string")).alias("bathingWaterIdentifier"), F.date_format("ts", "yyyy-MM-dd").alias("sampleDate"),
        F.floor("value").cast("string").alias("escherichiaColiValue"), F.when(F.col("event_type") == "error", "limitOfDetectionValue").alias("escherichiaColiStatus"),
    )
    pages = raw.groupBy("prefix", "seq").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("uid").alias("last_uid"))
    before = pages.select("prefix", (F.col("seq") + 1).alias("seq"), F.col("last_uid").alias("after_uid"))
    wrong = (F.col("prefix") == "NO") & (F.col("seq") == 3)
    linked = pages.join(before, ["prefix", "seq"], "left").withColumn("after_uid", F.coalesce("after_uid", F.lit(0)) - wrong.cast("int"))
    path = shared_path(t.spark, "pages")
    linked.select(F.lit(1).alias("format"), "*", F.col("prefix").alias("p"), F.col("seq").alias("s")).repartition("p", "s").write.partitionBy("p", "s").json(path)
    expected = raw.filter("prefix <> 'NO'").groupBy("prefix").agg(F.count("*").alias("n"))
    rows = readers.samples_of(X.page_chain(readers.read_sample_pages(t.spark, path), 1, 0), expected)
    return rows.groupBy("prefix", "seq").agg(F.count("*").alias("n"), F.min("uid").alias("first_uid"), F.max("uid").alias("last_uid"), F.count_if(F.col("ec_status") == "limitOfDetectionValue").alias("n_limits"), F.countDistinct("bw_id").alias("n_waters"))


@query(f"WITH {CLEAN}, c AS (SELECT bw_id, season, count(*) AS n_rows, count(DISTINCT (country, quality, calendar, management)) AS n_variants FROM (SELECT *, min(country) OVER (PARTITION BY bw_id) AS own FROM clean WHERE reason IS NULL) WHERE country = own GROUP BY 1, 2) SELECT d.* EXCLUDE (k), n_rows, n_variants FROM deduped d JOIN c USING (bw_id, season)")
def w2_dedupe_site_season(t: Tables):
    return deduped(t)


@query(f"""WITH {CLEAN}, x AS (SELECT bw_id, min(country) AS country, arg_max_null(quality, season) AS latest_quality, arg_max_null(group_id, season) AS group_id, arg_max_null(name, season) AS name, arg_max_null(type, season) AS type, arg_max_null("constraint", season) AS "constraint", arg_max_null(profile, season) AS profile, arg_max(lat, season) FILTER (WHERE lat IS NOT NULL) AS lat, arg_max(lon, season) FILTER (WHERE lat IS NOT NULL) AS lon, min(season) AS first_season, max(season) AS last_season, count(DISTINCT season) AS n_seasons FROM deduped GROUP BY 1) SELECT x.*, {LABEL.replace('quality', 'latest_quality')} AS latest_class FROM x""")
def a15_bathing_rollup(t: Tables):
    return B.rollup(deduped(t))


@query(f"WITH {CLEAN} SELECT country, season, coalesce(quality, '(blank)') AS quality, count(*) AS n FROM deduped GROUP BY ALL")
def a16_season_class_counts(t: Tables):
    return B.season_counts(deduped(t))


@query(f"WITH {CLEAN}, g AS (SELECT country, count(DISTINCT bw_id) AS n_waters, count(*) AS n_rows, count(DISTINCT season) AS n_seasons, max(season) AS latest FROM deduped GROUP BY 1) SELECT g.*, (SELECT count(*) FROM deduped d WHERE d.country = g.country AND d.season = g.latest) AS n_latest FROM g")
def a16_bathing_country_summary(t: Tables):
    return B.country_summary(deduped(t))


@query(f"WITH {CLEAN} SELECT a.country, coalesce(a.quality, '(blank)') AS quality_a, coalesce(b.quality, '(blank)') AS quality_b, count(*) AS n FROM deduped a JOIN deduped b ON a.bw_id = b.bw_id AND a.season = 1997 AND b.season = 1999 GROUP BY ALL")
def j5_season_pairs(t: Tables):
    return B.season_pairs(deduped(t), 1997, 1999)


@query(f"""WITH {CLEAN}, p AS (SELECT coalesce(a.country, b.country) AS country, a.bw_id AS ia, b.bw_id AS ib, {RANK.format(c='a.quality')} AS ra, {RANK.format(c='b.quality')} AS rb FROM (SELECT * FROM deduped WHERE season = 1997) a FULL JOIN (SELECT * FROM deduped WHERE season = 1999) b ON a.bw_id = b.bw_id)
SELECT country, count(*) FILTER (WHERE ia IS NOT NULL AND ib IS NOT NULL) AS n_paired, count(*) FILTER (WHERE rb < ra) AS moved_up, count(*) FILTER (WHERE rb > ra) AS moved_down, count(*) FILTER (WHERE rb = ra) AS unchanged, count(*) FILTER (WHERE ia IS NOT NULL AND ib IS NOT NULL AND (ra IS NULL OR rb IS NULL)) AS not_comparable, count(*) FILTER (WHERE ib IS NULL) AS only_in_a, count(*) FILTER (WHERE ia IS NULL) AS only_in_b FROM p GROUP BY 1""")
def a22_compare_seasons(t: Tables):
    return B.compare_seasons(deduped(t), 1997, 1999)


@query(f"WITH {CLEAN} SELECT bw_id, place, season, quality FROM (SELECT *, row_number() OVER (PARTITION BY bw_id ORDER BY season) AS place FROM deduped) WHERE place <= 200")
def k2_history(t: Tables):
    return B.history(deduped(t))


SAMPLES = [
    "CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 50 = 0 THEN event_id + 1 ELSE event_id END AS uid", "event_id AS place",
    "CASE user_id % 4 WHEN 0 THEN 'IT' WHEN 1 THEN 'GR' WHEN 2 THEN 'NO' ELSE 'IT' END AS prefix",
    "CASE WHEN event_id % 199 = 0 THEN 'X' ELSE CASE user_id % 4 WHEN 0 THEN 'IT' WHEN 1 THEN 'GR' WHEN 2 THEN 'NO' ELSE CASE WHEN event_id % 37 = 0 THEN 'GR' ELSE 'IT' END END || CAST(user_id AS STRING) END AS bw_id",
    "CASE WHEN event_id % 193 = 0 THEN '1800' WHEN event_id % 17 = 0 THEN '2020' ELSE CAST(2020 + CAST(event_id % 1461 AS INT) / 366 AS STRING) END AS season",
    "CASE WHEN event_id % 191 = 0 THEN '2021-02-30' ELSE CAST(DATE '2020-01-01' + CAST(event_id % 1461 AS INT) AS STRING) END AS sample_date",
    "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST(value AS STRING) WHEN event_id % 7 = 0 THEN '-4' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS ec_value",
    "CASE event_type WHEN 'click' THEN 'confirmedValue' WHEN 'error' THEN 'limitOfDetectionValue' WHEN 'signup' THEN CASE WHEN event_id % 9 = 0 THEN 'odd' END WHEN 'purchase' THEN CASE WHEN event_id % 10 = 0 THEN 'missingValue' END END AS ec_status",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 400 AS STRING) END AS ie_value", "CASE WHEN event_id % 15 = 0 THEN 'missingValue' WHEN event_id % 6 = 0 THEN ' ' END AS ie_status",
    "CASE WHEN event_id % 21 = 0 THEN 1 ELSE 0 END AS has_remarks",
]
SAMPLES[4] = SAMPLES[4].replace("CAST(2020 + CAST(event_id % 1461 AS INT) / 366 AS STRING)", "CAST(CAST(2020 + floor(CAST(event_id % 1461 AS INT) / 366.0) AS INT) AS STRING)")


def _kind(i: str) -> str:
    blank = f"coalesce(trim({i}_status), '') = ''"
    code = f"CASE {i}_status WHEN 'confirmedValue' THEN 'C' WHEN 'limitOfDetectionValue' THEN 'D' WHEN 'missingValue' THEN 'M' ELSE 'U' END"
    number = f"TRY_CAST({i}_value AS DOUBLE)"
    return f"CASE WHEN {i}_value IS NULL AND {blank} THEN 'M' WHEN NOT ({blank}) AND {code} = 'M' THEN 'M' WHEN NOT ({blank}) AND {i}_value IS NULL THEN CASE WHEN {code} = 'U' THEN 'U' ELSE 'M' END WHEN NOT coalesce({number} >= 0 AND {number} = floor({number}), false) THEN 'I' WHEN {blank} THEN 'Q' ELSE {code} END"


SAMPLED = f"""raw AS {select(SAMPLES, "events")},
kinds AS (SELECT *, {_kind("ec")} AS ec_kind, {_kind("ie")} AS ie_kind, CAST(try_strptime(sample_date, '%Y-%m-%d') AS DATE) AS date, TRY_CAST(season AS INT) AS s, CASE WHEN substr(trim(bw_id), 1, 2) IN ('IT', 'GR', 'NO') THEN substr(trim(bw_id), 1, 2) END AS country FROM raw),
normal AS (SELECT uid, place, prefix, country, trim(bw_id) AS bw_id, s AS season, date, ec_kind, ie_kind, list_filter([CASE WHEN month(date) = 1 AND day(date) = 1 THEN 'new-year' END, CASE WHEN year(date) <> s THEN 'other-season' END, CASE WHEN has_remarks > 0 THEN 'remarks' END], lambda x: x IS NOT NULL) AS row_flags,
  CASE WHEN uid IS NULL THEN 'uid' WHEN length(trim(bw_id)) < 3 THEN 'id' WHEN substr(trim(bw_id), 1, 2) <> prefix THEN 'prefix' WHEN date IS NULL THEN 'date' WHEN NOT s BETWEEN 1900 AND 2100 THEN 'season' END AS reason,
  CASE WHEN ec_kind <> 'I' THEN TRY_CAST(ec_value AS DOUBLE) END AS ec_value, CASE WHEN ie_kind <> 'I' THEN TRY_CAST(ie_value AS DOUBLE) END AS ie_value FROM kinds),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY prefix, place) AS k, count(*) OVER (PARTITION BY uid) AS n_rows FROM normal WHERE reason IS NULL) WHERE k = 1),
long AS (SELECT bw_id, country, season, date, (year(date) * 12 + month(date) - 1)::INT AS pos, i.ind AS indicator, CASE i.ind WHEN 'ec' THEN ec_kind ELSE ie_kind END AS kind, CASE i.ind WHEN 'ec' THEN ec_value ELSE ie_value END AS value FROM kept, (VALUES ('ec'), ('ie')) AS i(ind)),
l AS (SELECT *, CASE WHEN kind IN ('Q', 'C') THEN value END AS q FROM long)"""
KIND_FLAGS = "CASE WHEN n_detection_limit{w} > 0 THEN 'detection-limit-values-excluded' END, CASE WHEN n_missing{w} > 0 THEN 'missing-values-excluded' END, CASE WHEN n_unrecognised{w} > 0 THEN 'unrecognised-status-values-excluded' END, CASE WHEN n_confirmed_high{w} > 0 THEN 'confirmed-high-values-included' END"
KIND_SQL = {"n_confirmed_high": "kind = 'C'", "n_detection_limit": "kind = 'D'", "n_missing": "kind = 'M'", "n_unrecognised": "kind IN ('U', 'I')"}
A, B2 = ("a", 2020 * 12, 2021 * 12 + 8), ("b", 2021 * 12 + 6, 2023 * 12 + 11)
DEALT = f'{SAMPLED}, dealt AS (SELECT l.*, w."window" FROM l JOIN (VALUES (\'a\', {A[1]}, {A[2]}), (\'b\', {B2[1]}, {B2[2]})) AS w("window", fp, lp) ON pos BETWEEN fp AND lp), scan AS (SELECT country, bw_id, indicator, "window", count(*) AS n_rows, count(q) AS n, sum(q) AS total, min(q) AS low, max(q) AS high, count(DISTINCT CASE WHEN q IS NOT NULL THEN pos END) AS months, median(q) AS median, ' + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in KIND_SQL.items()) + " FROM dealt GROUP BY ALL)"


def kept(t: Tables):
    raw = t.view("events", SAMPLES)
    placed = X.normalise(raw.withColumn("uid", F.when(F.col("uid").isNotNull(), F.struct("uid", "place"))))
    rows = placed.filter("reason IS NULL").select(F.col("uid.uid").alias("uid"), F.col("uid.place").alias("place"), *[c for c in placed.columns if c not in ("uid", "reason")])
    return X.dedupe_uid(rows, ["prefix", "place"])


@query(f"WITH {SAMPLED} SELECT uid, prefix, country, bw_id, season, date, ec_kind, ie_kind, row_flags, reason, ec_value, ie_value FROM normal", dates=("date",), lists=("row_flags",))
def p5_normalise_samples(t: Tables):
    return X.normalise(t.view("events", SAMPLES))


@query(f"WITH {SAMPLED} SELECT ec_kind AS kind, ec_status AS status, count(*) AS n, round(sum(CASE WHEN ec_kind <> 'I' THEN TRY_CAST(ec_value AS DOUBLE) END), 4) AS total FROM kinds GROUP BY 1, 2")
def p4_value_kind(t: Tables):
    raw = t.view("events", SAMPLES).withColumn("kind", X.value_kind(F.col("ec_value"), F.col("ec_status")))
    return raw.groupBy("kind", F.col("ec_status").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("kind") != "I", F.col("ec_value").try_cast("double"))), 4).alias("total"))


@query(f"WITH {SAMPLED} SELECT * EXCLUDE (k, reason) FROM kept", dates=("date",), lists=("row_flags",))
def w1_dedupe_uid(t: Tables):
    return kept(t)


@query(f"WITH {SAMPLED} SELECT bw_id, indicator, pos, count(*) AS n, sum(q) AS sum_value, min(q) AS min, max(q) AS max FROM l WHERE q IS NOT NULL GROUP BY 1, 2, 3")
def a10_sample_month_cells(t: Tables):
    return X.month_cells(kept(t))


@query(f'WITH {DEALT} SELECT country, indicator, "window", kind, count(*) AS n FROM dealt GROUP BY ALL')
def a11_kind_counts(t: Tables):
    return X.kind_counts(kept(t), [A, B2])


FROM, TO = "2022-03-01", "2022-04-15"
STATS = f"""g AS (SELECT bw_id, indicator, count(*) FILTER (WHERE i) AS n_rows, count(q) FILTER (WHERE i) AS n, min(q) FILTER (WHERE i) AS min, max(q) FILTER (WHERE i) AS max, round(avg(q) FILTER (WHERE i), 6) AS mean, median(q) FILTER (WHERE i) AS median, {", ".join(f"count(*) FILTER (WHERE i AND {c}) AS {k}" for k, c in KIND_SQL.items())}, min(date) AS first_date, max(date) AS last_date FROM (SELECT *, {{inside}} AS i FROM l) GROUP BY 1, 2)
SELECT * EXCLUDE (first_date, last_date), array_to_string(list_sort(list_filter([CASE WHEN n_rows = 0 THEN 'no-samples-in-range' END, CASE WHEN n_rows = 0 AND ({{outside}}) THEN 'range-outside-data' END, CASE WHEN n_rows > {{limit}} THEN 'truncated' END, {KIND_FLAGS.format(w="")}], lambda x: x IS NOT NULL)), ',') AS flags FROM g"""


@query(f"WITH {SAMPLED}, {STATS.format(inside='true', outside='false', limit=200)}")
def a12_indicator_stats(t: Tables):
    return X.indicator_stats(kept(t))


@query(f"WITH {SAMPLED}, {STATS.format(inside=f"date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND season = 2022", outside=f"DATE '{FROM}' > last_date OR DATE '{TO}' < first_date", limit=2)}")
def a12_indicator_stats_in_range(t: Tables):
    """The samples of some weeks of a season; a listing of two would be cut short where there are more."""
    return X.indicator_stats(kept(t), FROM, TO, 2022, limit=2)


@query(f"WITH {DEALT} SELECT * FROM scan")
def a13_sample_window_scan(t: Tables):
    return X.window_scan(kept(t), [A, B2])


@query(f"WITH {SAMPLED} SELECT bw_id, count(*) AS n, min(date) AS first_date, max(date) AS last_date, min(season) AS first_season, max(season) AS last_season FROM kept GROUP BY 1", dates=("first_date", "last_date"))
def a14_sample_site_summary(t: Tables):
    return X.site_summary(kept(t))


@query(f"WITH {SAMPLED} SELECT country, indicator, count(DISTINCT bw_id) AS n_waters, count(q) AS n, min(date) FILTER (WHERE q IS NOT NULL) AS first_date, max(date) FILTER (WHERE q IS NOT NULL) AS last_date FROM l GROUP BY 1, 2", dates=("first_date", "last_date"))
def a14_quantified_range(t: Tables):
    return X.quantified_range(kept(t))


@query(f"WITH {SAMPLED} SELECT bw_id, date, count(*) AS n FROM kept GROUP BY 1, 2 HAVING count(*) > 1", dates=("date",))
def a14_repeated_days(t: Tables):
    return X.repeated_days(kept(t))


COUNTS = ("n", "n_rows", "months", *KIND_SQL)
SPAN = {"a": A[2] - A[1] + 1, "b": B2[2] - B2[1] + 1}


def _list(flags: str) -> str:
    return f"list_filter([{flags}], lambda x: x IS NOT NULL)"


SIDE_FLAGS = {w: f"CASE WHEN first_pos IS NULL OR last_pos < {p[2]} THEN 'period-outside-data' END, CASE WHEN first_pos > {p[2]} THEN 'period-before-data' END, CASE WHEN months_{w} > 0 AND months_{w} < {SPAN[w]} THEN 'partial-period' END, {KIND_FLAGS.format(w='_' + w)}" for w, p in (("a", A), ("b", B2))}
TOP_FLAGS = "'periods-overlap', CASE WHEN first_pos IS NULL THEN 'no-data-for-scope' END, CASE WHEN relative_percent_note IN ('baseline-zero', 'baseline-missing', 'comparison-missing') THEN 'relative-change-undefined' END"


def _change(a: str, b: str, prefix: str = "") -> str:
    return f"""CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN round({b} - {a}, 6) + 0.0 END AS {prefix}absolute, CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND round({a}, 6) <> 0 THEN round(100 * ({b} - {a}) / abs({a}), 4) + 0.0 END AS {prefix}relative_percent,
  CASE WHEN {a} IS NULL THEN 'baseline-missing' WHEN {b} IS NULL THEN 'comparison-missing' WHEN round({a}, 6) = 0 THEN 'baseline-zero' END AS {prefix}relative_percent_note, CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN round({a}, 6) = round({b}, 6) THEN 'no-change' WHEN {b} > {a} THEN 'increased' ELSE 'decreased' END AS {prefix}direction"""


COMPARED = f"""{DEALT}, wide AS (SELECT country, bw_id, indicator, {", ".join(f"coalesce(max({c}) FILTER (WHERE \"window\" = '{k}'), 0) AS {c}_{k}" for k in "ab" for c in COUNTS)}, {", ".join(f"max(total / nullif(n, 0)) FILTER (WHERE \"window\" = '{k}') AS mean_{k}, max(median) FILTER (WHERE \"window\" = '{k}') AS median_{k}, max(low) FILTER (WHERE \"window\" = '{k}') AS low_{k}, max(high) FILTER (WHERE \"window\" = '{k}') AS high_{k}" for k in "ab")} FROM scan GROUP BY ALL),
range AS (SELECT country, bw_id, indicator, min(pos) AS first_pos, max(pos) AS last_pos FROM l WHERE q IS NOT NULL GROUP BY ALL),
ch AS (SELECT wide.*, first_pos, last_pos, {_change("mean_a", "mean_b")}, {_change("median_a", "median_b", "median_")} FROM wide LEFT JOIN range USING (country, bw_id, indicator)),
compared AS (SELECT *, CASE WHEN n_a >= 3 AND n_b >= 3 THEN 'ok' ELSE 'insufficient-data' END AS status, CASE WHEN n_a = 0 THEN 'absent-in-period-a' WHEN n_b = 0 THEN 'absent-in-period-b' WHEN n_a < 3 OR n_b < 3 THEN 'insufficient-samples' END AS reason, {_list(SIDE_FLAGS["a"])} AS la, {_list(SIDE_FLAGS["b"])} AS lb, {_list(TOP_FLAGS)} AS lt FROM ch)"""


@query(f"""WITH {COMPARED} SELECT * EXCLUDE (la, lb, lt, first_pos, last_pos, reason) REPLACE (round(mean_a, 9) AS mean_a, round(mean_b, 9) AS mean_b), array_to_string(list_sort(la), ',') AS flags_a, array_to_string(list_sort(lb), ',') AS flags_b, array_to_string(list_sort(list_distinct(la || lb || lt)), ',') AS flags FROM compared""")
def a21_compare_samples_site(t: Tables):
    return X.compare(kept(t), A, B2).drop("reason").withColumns({c: F.round(c, 9) for c in ("mean_a", "mean_b")})


def _country_side(w: str, p: tuple) -> str:
    return f"CASE WHEN first_pos IS NULL OR last_pos < {p[2]} THEN 'period-outside-data' END, CASE WHEN first_pos > {p[2]} THEN 'period-before-data' END, CASE WHEN n_months_{w} > 0 AND n_months_{w} < {SPAN[w]} THEN 'partial-period' END, {KIND_FLAGS.format(w='_' + w)}"


@query(f"""WITH {COMPARED}, rel AS (SELECT *, CASE WHEN round(mean_a, 6) <> 0 THEN 100 * (mean_b - mean_a) / abs(mean_a) END AS rel, reason IS NULL AS ok FROM compared), mm AS (SELECT l.country, l.indicator, {", ".join(f"count(DISTINCT pos) FILTER (WHERE pos BETWEEN {p[1]} AND {p[2]}) AS n_months_{w}" for w, p in (("a", A), ("b", B2)))} FROM l JOIN compared c ON c.country = l.country AND c.bw_id = l.bw_id AND c.indicator = l.indicator AND c.reason IS NULL WHERE q IS NOT NULL GROUP BY ALL),
dr AS (SELECT country, indicator, min(pos) AS first_pos, max(pos) AS last_pos FROM l WHERE q IS NOT NULL GROUP BY ALL),
g AS (SELECT country, indicator, count(*) FILTER (WHERE n_a > 0 OR n_b > 0) AS n_considered, count(*) FILTER (WHERE ok) AS n_paired, count(*) FILTER (WHERE reason = 'absent-in-period-a' AND n_b > 0) AS n_absent_a, count(*) FILTER (WHERE reason = 'absent-in-period-b') AS n_absent_b, count(*) FILTER (WHERE reason = 'insufficient-samples') AS n_insufficient,
  avg(mean_a) FILTER (WHERE ok) AS ma, avg(mean_b) FILTER (WHERE ok) AS mb, median(median_a) FILTER (WHERE ok) AS median_a, median(median_b) FILTER (WHERE ok) AS median_b, round(median(rel) FILTER (WHERE ok), 4) AS median_site_relative_percent, count(*) FILTER (WHERE ok AND direction = 'increased') AS n_increased, count(*) FILTER (WHERE ok AND direction = 'decreased') AS n_decreased, count(*) FILTER (WHERE ok AND direction = 'no-change') AS n_unchanged, count(*) FILTER (WHERE ok AND rel IS NULL) AS n_undefined,
  {", ".join(f"coalesce(sum(n_{w}) FILTER (WHERE ok), 0)::BIGINT AS n_samples_{w}" for w in "ab")}, {", ".join(f"sum({c}_{w})::BIGINT AS {c}_{w}" for w in "ab" for c in KIND_SQL)} FROM rel GROUP BY 1, 2),
h AS (SELECT g.*, coalesce(n_months_a, 0) AS n_months_a, coalesce(n_months_b, 0) AS n_months_b, first_pos, last_pos, {_change("ma", "mb")}, {_change("median_a", "median_b", "median_")} FROM g LEFT JOIN mm USING (country, indicator) LEFT JOIN dr USING (country, indicator))
SELECT * EXCLUDE (ma, mb, first_pos, last_pos), round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, n_considered - n_paired AS n_excluded, CASE WHEN n_paired > 0 THEN 'ok' ELSE 'insufficient-data' END AS status, array_to_string(list_sort(list_distinct({_list(_country_side("a", A))} || {_list(_country_side("b", B2))} || {_list(TOP_FLAGS + ", CASE WHEN n_paired BETWEEN 1 AND 4 THEN 'few-sites' END")})), ',') AS flags FROM h""")
def a21_compare_samples_country(t: Tables):
    return X.compare_country(X.compare(kept(t), A, B2, everywhere=True), ["country", "indicator"], A, B2)


@query(f"WITH {SAMPLED}, k AS (SELECT bw_id, count(*) AS n, min(date) AS first_date, max(date) AS last_date, min(season) AS first_season, max(season) AS last_season FROM kept GROUP BY 1), w AS (SELECT DISTINCT 'IT' || CAST(o_custkey AS STRING) AS bw_id, 'IT' AS own FROM orders WHERE o_custkey % 4 = 0) SELECT bw_id, own, n, first_date, last_date, first_season, last_season, k.n IS NOT NULL AS has_samples FROM w FULL JOIN k USING (bw_id)", dates=("first_date", "last_date"))
def j14_samples_link(t: Tables):
    waters = t.view("orders", ["'IT' || CAST(o_custkey AS STRING) AS bw_id", "'IT' AS own"], "o_custkey % 4 = 0").distinct()
    return X.link(waters, kept(t))


@query(f"""WITH p AS (SELECT conv_id AS prefix, turn AS seq, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 - CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN 5 ELSE 0 END END AS after_uid, conv_id * 100 + turn AS last_uid, count(*) OVER (PARTITION BY conv_id, turn) AS c FROM conversations),
g AS (SELECT *, coalesce(seq = row_number() OVER w - 1 AND after_uid IS NOT DISTINCT FROM lag(last_uid) OVER w, false) AS good FROM p WINDOW w AS (PARTITION BY prefix ORDER BY seq)) SELECT prefix, seq, min(good) OVER (PARTITION BY prefix ORDER BY seq ROWS UNBOUNDED PRECEDING) AS valid FROM g""")
def s4_page_chain(t: Tables):
    pages = t.view("conversations", ["conv_id AS prefix", "turn AS seq", "CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 - CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN 5 ELSE 0 END END AS after_uid", "conv_id * 100 + turn AS last_uid", "array(conv_id * 100 + turn) AS uids"])
    return X.page_chain(pages).select("prefix", "seq", "valid")


@query(f"WITH {SAMPLED} SELECT bw_id, date, indicator, CASE kind {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in X.KINDS.items())} END AS kind, q AS value, CASE WHEN kind NOT IN ('I', 'M') THEN value END AS reported_value FROM l", dates=("date",))
def p16_sample_view(t: Tables):
    return X.view(kept(t))


@query(f"SELECT bw_id, {LABEL} AS label, CASE WHEN regexp_matches(trim(profile), '^(?i)https?://[^ ]+$') THEN trim(profile) END AS url FROM {select(CLASSES, 'orders')}")
def f13_quality_class_safe_url(t: Tables):
    return t.view("orders", CLASSES).select("bw_id", S.quality_class(F.col("quality")).alias("label"), S.safe_url(F.col("profile")).alias("url"))


@query(f"WITH {CLEAN}, x AS (SELECT bw_id, min(country) AS country, arg_max_null(quality, season) AS quality, count(lat) AS located, min(season) AS a, max(season) AS b FROM deduped GROUP BY 1) SELECT bw_id, country, coalesce({LABEL}, '(blank)') AS shown_class, CASE WHEN located > 0 THEN 'located' ELSE 'no-location' END AS location_status, a || '-' || b AS seasons FROM x")
def p16_bathing_view(t: Tables):
    return B.view(B.rollup(deduped(t)))
