"""Season classifications of bathing waters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.functions import scalars as S

#: What a season's row says of the water beside its quality.
ATTRIBUTES = ("group_id", "name", "type", "constraint")
RANKS = {"Excellent": 0, "Good": 1, "Sufficient": 2, "Poor": 3}


def clean(raw: DataFrame) -> DataFrame:
    """Typed rows and `reason`, the first rule that drops one: country, id, season. Coordinates are both or none."""
    season = F.col("season").try_cast("double")
    whole = S.holds((season == F.floor(season)) & season.between(1900, 2100))
    lat, lon = S.finite(F.col("lat").try_cast("double")), S.finite(F.col("lon").try_cast("double"))
    both = S.holds(lat.between(-90, 90) & lon.between(-180, 180))
    country = S.normalise_country(F.col("country_code"))
    reason = F.when(country.isNull(), "country").when(~S.holds(F.trim("bw_id") != ""), "id").when(~whole, "season")
    return raw.select(
        country.alias("country"), F.trim("bw_id").alias("bw_id"), F.when(whole, season.cast("int")).alias("season"), F.trim("quality").alias("quality"), "calendar", "management",
        F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"), S.safe_url(F.col("profile")).alias("profile"), *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ATTRIBUTES], reason.alias("reason"),
    )


def dedupe(rows: DataFrame) -> DataFrame:
    """One row per (bw_id, season): the smallest by (country, quality, calendar, management), of the id's smallest country.

    `n_rows` and `n_variants` count the repeats and their distinct contents. Nulls sort first.
    """
    key = ["country", "quality", "calendar", "management"]
    own = rows.groupBy("bw_id").agg(F.min("country").alias("country"))
    best = rows.join(own, ["bw_id", "country"]).groupBy("bw_id", "season").agg(F.min(F.struct(*key, "lat", "lon", "profile", *ATTRIBUTES)).alias("r"), F.count("*").alias("n_rows"), F.countDistinct(F.struct(*key)).alias("n_variants"))
    return best.select("bw_id", "season", "r.*", "n_rows", "n_variants")


def rollup(rows: DataFrame) -> DataFrame:
    """Per water: attributes, quality and class of the latest season, coordinates of the latest one that has them, seasons."""
    located = F.when(F.col("lat").isNotNull(), F.col("season"))
    out = rows.groupBy("bw_id").agg(F.min("country").alias("country"), F.max_by(F.struct(*ATTRIBUTES, "profile", F.col("quality").alias("latest_quality")), "season").alias("latest"), F.max_by(F.struct("lat", "lon"), located).alias("p"), F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.countDistinct("season").alias("n_seasons"))
    out = out.select("*", "latest.*")
    return out.select("bw_id", "country", *ATTRIBUTES, "profile", "latest_quality", S.quality_class(F.col("latest_quality")).alias("latest_class"), "p.lat", "p.lon", "first_season", "last_season", "n_seasons")


def season_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("country", "season", F.coalesce("quality", F.lit("(blank)")).alias("quality")).agg(F.count("*").alias("n"))


def country_summary(rows: DataFrame) -> DataFrame:
    """Per country: waters, rows, seasons, and the rows of its latest season."""
    latest = rows.groupBy("country").agg(F.countDistinct("bw_id").alias("n_waters"), F.count("*").alias("n_rows"), F.countDistinct("season").alias("n_seasons"), F.max("season").alias("latest"))
    n = rows.groupBy("country", F.col("season").alias("latest")).agg(F.count("*").alias("n_latest"))
    return latest.join(n, ["country", "latest"])


def season_pairs(rows: DataFrame, a: int, b: int) -> DataFrame:
    """Waters by their qualities in two seasons; both seasons of a water meet in one aggregation, without a self-join."""
    pick = lambda s: F.max(F.when(F.col("season") == s, F.coalesce("quality", F.lit("(blank)"))))
    both = rows.filter(F.col("season").isin(a, b)).groupBy("country", "bw_id").agg(pick(a).alias("quality_a"), pick(b).alias("quality_b"))
    return both.filter("quality_a IS NOT NULL AND quality_b IS NOT NULL").groupBy("country", "quality_a", "quality_b").agg(F.count("*").alias("n"))


def compare_seasons(rows: DataFrame, a: int, b: int) -> DataFrame:
    """Per country: waters that moved up or down a class, stayed, can't be compared, or are in one season only."""
    pick = lambda s: F.max(F.when(F.col("season") == s, F.coalesce("quality", F.lit("(blank)"))))
    both = rows.filter(F.col("season").isin(a, b)).groupBy("country", "bw_id").agg(pick(a).alias("a"), pick(b).alias("b"))
    rank = lambda c: S.lookup(S.quality_class(F.col(c)), RANKS)
    ra, rb = rank("a"), rank("b")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    n = lambda c: F.count_if(S.holds(c))
    return both.groupBy("country").agg(
        n(paired).alias("n_paired"), n(paired & (rb < ra)).alias("moved_up"), n(paired & (rb > ra)).alias("moved_down"), n(paired & (rb == ra)).alias("unchanged"),
        n(paired & (ra.isNull() | rb.isNull())).alias("not_comparable"), n(F.col("b").isNull()).alias("only_in_a"), n(F.col("a").isNull()).alias("only_in_b"),
    )


def history(rows: DataFrame, limit: int = 200) -> DataFrame:
    """The first `limit` seasons of each water, ascending."""
    w = W.partitionBy("bw_id").orderBy("season")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("bw_id", "place", "season", "quality")


def view(rollup: DataFrame) -> DataFrame:
    """Display rows of waters: the class behind the latest quality, (blank) without one; located or no-location."""
    return rollup.select("bw_id", "country", F.coalesce("latest_class", F.lit("(blank)")).alias("shown_class"), F.when(F.col("lat").isNotNull(), "located").otherwise("no-location").alias("location_status"), F.concat_ws("-", "first_season", "last_season").alias("seasons"))
