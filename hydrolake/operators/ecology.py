"""Diversity and biotic indices over counts of taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPT = ("Ephemeroptera", "Plecoptera", "Trichoptera")


def diversity(counts: DataFrame, by: str, taxon: str, n: str) -> DataFrame:
    """Per sample: richness, Shannon (natural log), Simpson, Pielou (two taxa or more) and Chao1. Zero counts are ignored.

    One shuffle by sample and taxon and one by sample; Shannon needs only the sums of n and n ln n.
    """
    per = counts.groupBy(by, taxon).agg(F.sum(n).cast("double").alias("__c")).filter("__c > 0")
    c = F.col("__c")
    g = per.groupBy(by).agg(F.count("*").alias("__s"), F.sum(c).alias("__t"), F.sum(c * F.ln(c)).alias("__l"), F.sum(c * c).alias("__q"), F.count_if(c == 1).alias("__1"), F.count_if(c == 2).alias("__2"))
    taxa, total, once = F.col("__s"), F.col("__t"), F.col("__1")
    h = F.ln(total) - F.col("__l") / total
    chao = taxa + once * (once - 1) / (2.0 * (F.col("__2") + 1))
    return g.select(by, taxa.alias("richness"), F.round(h, 6).alias("shannon"), F.round(1 - F.col("__q") / (total * total), 6).alias("simpson"), F.round(F.when(taxa >= 2, h / F.ln(taxa)), 6).alias("pielou"), F.round(chao, 6).alias("chao1"))


def biotic(families: DataFrame, scores: DataFrame, by: str) -> DataFrame:
    """BMWP, ASPT and the share of three orders, from present families (by, family, order) and their scores 1 to 10.

    A dimension of families; each family counts once a sample.
    """
    present = families.select(by, "family", "order").distinct().join(scores, "family", "left")
    g = present.groupBy(by).agg(F.sum("score").alias("bmwp"), F.count("score").alias("__k"), F.count_if(F.col("order").isin(*EPT)).alias("__e"), F.count("*").alias("__n"))
    return g.select(by, "bmwp", F.round(F.try_divide(F.col("bmwp").cast("double"), F.col("__k").cast("double")), 6).alias("aspt"), F.round(F.col("__e") / F.col("__n"), 6).alias("ept_ratio"))


def reach(km: Column, k: Column, u: Column, d: Column, decay_per_km: Column) -> dict[str, Column]:
    """Closed forms of one-dimensional advection, dispersion and decay over a reach."""
    rate = 1000 * 2 * k / (u + F.sqrt(u * u + 4 * k * d))
    proxy = 1000 * k / u
    return {"decay_rate": rate, "proxy_rate": proxy, "implied_per_day": decay_per_km / 1000 * u * 86400, "steady_ratio": F.exp(-rate * km), "proxy_error": F.exp(-(proxy - rate) * km) - 1}


def pulse(distance_m: Column, seconds: Column, k: Column, u: Column, d: Column) -> Column:
    spread = 4 * d * seconds
    return F.when((seconds > 0) & (d > 0), 1 / F.sqrt(F.lit(3.141592653589793) * spread) * F.exp(-F.pow(distance_m - u * seconds, F.lit(2)) / spread - k * seconds))
